"""Token counts and packing against the tokenizer library itself."""

import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm.conftest import EDGES, frame
from logvigil.llm.packing import pack_documents
from logvigil.llm.token_counts import token_counts
from logvigil.llm.wordpieces import pieces_of_task, word_pieces

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    (1, "plain <|endoftext|> and <|startoftext|><|endoftext|>x <|endof text|>"),
    (2, "It's we'LL they've İstanbul ǅ é ½² ٠ _under_ don’t 'S"),
    (3, "a\x1cb\x1d \x1e\x1f c d e​f　g\x85h"),
    (4, "́lone 가가 你好！ \U0001f468‍\U0001f469 ΑΣ ΣΑΣ."),
    (5, "x" * 5000 + " " + "!" * 3000 + " " + "7" * 200),
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("hot", [1 << 18, 5])
def test_counts_match_the_library(spark, documents, rows, library, hot):
    found = {r.doc_id: r for r in token_counts(documents, PATH, hot=hot).collect()}
    assert len(found) == len(rows)
    for r in rows:
        n = len(ids_of(library, r.text))
        assert (found[r.doc_id].n_tokens, found[r.doc_id].n_bytes) == (n, len(r.text.encode()))
        assert found[r.doc_id].over_limit == (n > 2048)


@pytest.mark.parametrize("cases", [ODD, EDGES])
def test_odd_texts(spark, library, cases):
    found = Counter(tuple(r) for r in token_counts(frame(spark, cases), PATH, hot=3).collect())
    expected = Counter()
    for i, t in cases:
        n = len(ids_of(library, t))
        expected[i, len((t or "").encode()), n, n > 2048] += 1
    assert found == expected


def test_empty_table(nothing):
    assert token_counts(nothing, PATH).collect() == []
    assert pack_documents(nothing, PATH).collect() == []


def check_packing(pieces, texts, library):
    """Every id once, sequences without holes, and none that needs padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for doc_id, text in texts.items():
        ids, at = [*ids_of(library, text), 1], 0
        for p in sorted(by_doc[doc_id], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{p.length}I", *ids[at:at + p.length]))
            at += p.length
        assert at == len(ids)
    for sequence in by_sequence.values():
        at = 0
        for p in sorted(sequence, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048 and at & (at - 1) == 0
        assert {p.sequence_tokens for p in sequence} == {at}


def test_packing(documents, rows, library):
    pieces = pack_documents(documents, PATH).collect()
    check_packing(pieces, {r.doc_id: r.text for r in rows}, library)
    assert Counter(p.sequence_tokens for p in pieces)[2048] > 0


def test_packing_is_the_same_again(documents):
    assert sorted(pack_documents(documents, PATH).collect()) == sorted(pack_documents(documents, PATH).collect())


def test_packing_keeps_steps_even(documents):
    sequences = {(r.sequence_id, r.sequence_tokens, r.step_id) for r in pack_documents(documents, PATH).collect()}
    per_step = Counter()
    for _, tokens, step in sequences:
        per_step[step] += tokens
    assert max(per_step.values()) <= 16_384


def test_packing_odd_texts(spark, library):
    check_packing(pack_documents(frame(spark, ODD), PATH).collect(), dict(ODD), library)
    once = [(i, t) for n, (i, t) in enumerate(EDGES) if i != 5]
    check_packing(pack_documents(frame(spark, once), PATH).collect(), dict(once), library)
    repeated = pack_documents(frame(spark, [(5, "one two"), (5, "one two")]), PATH).collect()
    assert sum(p.length for p in repeated) == 2 * (len(ids_of(library, "one two")) + 1)


def test_a_task_may_drop_its_pieces(spark, edges):
    """Caches of a given size stay within it and are not the worker's; the pieces are the same."""
    path = public_tokenizers.path("word_bpe_49k.json")
    kept, before = word_pieces(path), word_pieces.cache_info().currsize
    own = pieces_of_task(path, 3)
    assert own is not kept and own.ids("a few words of one text") == kept.ids("a few words of one text")
    assert max(map(len, (own._chunks, own._pieces, own._plain_spelling))) <= 3
    assert word_pieces.cache_info().currsize == before
    one = edges.coalesce(1)
    assert pack_documents(one, path, held=3).collect() == pack_documents(one, path).collect()
