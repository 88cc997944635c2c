"""Exact pieces of a tokenizer file, found once per distinct pre-token.

Meant for files whose pre-tokens never reach across white space (such as
word_bpe_49k.json): a text is cut at its special strings and at white space, and
each remaining chunk is normalised and split into pre-tokens on its own.  A
pre-token is kept in the byte-level spelling the model reads, so its pieces
depend on nothing around it.
"""

from __future__ import annotations

import functools
import re

from tokenizers import Tokenizer, pre_tokenizers

#: Chunks made of these need no Unicode tables: their normal form is their lower case.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PLAIN_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: Python counts these as white space, the tokenizer does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPACES = re.compile("[^\\S\x1c-\x1f]+")


class WordPieces:
    """``held`` bounds each cache.  A full cache stays as it is: what came first is mostly frequent."""

    def __init__(self, path: str, held: int = 200_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.held = held
        added = self.tokenizer.get_added_tokens_decoder()
        self.specials = {token.content: number for number, token in added.items()}
        self._at_specials = re.compile(
            "(" + "|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")"
        ) if self.specials else None
        self._bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._plain_spelling: dict[str, str] = {}
        self._pieces: dict[str, bytes] = {}
        self._chunks: dict[str, bytes] = {}

    def sections(self, text: str) -> tuple[list[str], list[str]]:
        """White-space chunks of the text, and the special strings between them."""
        if self._at_specials is None or not any(s in text for s in self.specials):
            return self.chunks(text), []
        parts = self._at_specials.split(text)
        return [c for part in parts[::2] for c in self.chunks(part)], parts[1::2]

    def chunks(self, text: str) -> list[str]:
        if _SEPARATORS.search(text) is None:
            return text.split()
        return [c for c in _SPACES.split(text) if c]

    def pre_tokens(self, chunk: str) -> list[str]:
        """Pre-tokens of one chunk, in the spelling of the model."""
        if _PLAIN.fullmatch(chunk):
            return [self._spelled(part) for part in _PLAIN_PARTS.findall(chunk.lower())]
        normal = self.tokenizer.normalizer.normalize_str(chunk)
        return [part for part, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def _spelled(self, part: str) -> str:
        if part.isascii():
            return part
        spelling = self._plain_spelling.get(part)
        if spelling is None:
            spelling = self._bytes.pre_tokenize_str(part)[0][0]
            if len(self._plain_spelling) < self.held:
                self._plain_spelling[part] = spelling
        return spelling

    def count(self, pre_token: str) -> int:
        return len(self.tokenizer.model.tokenize(pre_token))

    def _ids_of(self, pre_token: str) -> bytes:
        found = self._pieces.get(pre_token)
        if found is None:
            found = b"".join([
                p.id.to_bytes(4, "little") for p in self.tokenizer.model.tokenize(pre_token)
            ])
            if len(self._pieces) < self.held:
                self._pieces[pre_token] = found
        return found

    def _chunk_ids(self, chunk: str) -> bytes:
        found = b"".join(map(self._ids_of, self.pre_tokens(chunk)))
        if len(self._chunks) < self.held:
            self._chunks[chunk] = found
        return found

    def _section_ids(self, text: str) -> bytes:
        get, make = self._chunks.get, self._chunk_ids
        return b"".join([
            ids if (ids := get(c)) is not None else make(c) for c in self.chunks(text)
        ])

    def ids(self, text: str) -> bytes:
        """All ids of the text as little-endian unsigned 32-bit numbers."""
        if self._at_specials is None or not any(s in text for s in self.specials):
            return self._section_ids(text)
        parts = self._at_specials.split(text)
        return b"".join(
            self.specials[part].to_bytes(4, "little") if i % 2 else self._section_ids(part)
            for i, part in enumerate(parts)
        )


@functools.lru_cache(maxsize=1)
def word_pieces(path: str) -> WordPieces:
    """One per worker process."""
    return WordPieces(path)


def pieces_of_task(path: str, held: int | None) -> WordPieces:
    """With ``held`` caches of so many entries that go with the task; else those the worker keeps."""
    return word_pieces(path) if held is None else WordPieces(path, held)
