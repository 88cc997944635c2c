"""Hierarchical packing of documents into sequences of several lengths.

Each document becomes ids plus one end id.  Whole windows of the longest tier
are cut off first; the rest is routed to the shortest tier that holds it.  The
tiers are packed from long to short: a document opens a sequence of its tier,
and the gap behind it is filled from shorter tiers, first with the largest
documents that fit, then with the head of one more.  Sequences of a tier make up
step groups of ``step_tokens`` tokens, so every training step does equal work.
Packing is local to a task, on buffers of bounded size: nothing is shuffled.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from logvigil.llm.stages import emit
from logvigil.llm.wordpieces import pieces_of_task

TIERS = (256, 512, 1024, 2048)
#: Rests of documents that are packed together; each has less than a longest tier of ids.
BUFFER = 4096

_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
    ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()),
    ("offset", pa.int64()), ("sequence_tokens", pa.int64()), ("step_id", pa.int64()),
])
COLUMNS = ", ".join(f"{f.name} long" for f in _SCHEMA)


class Packer:
    """Packs the rests handed to it; yields piece rows.

    A rest is (length, number, doc_id, start, ids, doc_tokens); ``number`` keeps
    the order total, so a task run again packs the same way.
    """

    def __init__(self, tiers: tuple[int, ...], first: int, step_tokens: int):
        self.tiers, self.step_tokens = sorted(tiers), step_tokens
        self.first, self.sequences = first, 0
        self.per_tier: dict[int, int] = {}
        self.number = 0
        self.pool: list[tuple] = []

    def sequence(self, pieces: list[tuple]) -> Iterator[tuple]:
        tokens, offset = sum(p[0] for p in pieces), 0
        tier = self.tiers[min(bisect.bisect_left(self.tiers, tokens), len(self.tiers) - 1)]
        nth = self.per_tier[tier] = self.per_tier.get(tier, -1) + 1
        group = nth // max(1, self.step_tokens // tier)
        step = self.first + group * len(self.tiers) + self.tiers.index(tier)
        for length, _, doc_id, start, ids, doc_tokens in pieces:
            yield (doc_id, start, length, zlib.crc32(ids), doc_tokens,
                   self.first + self.sequences, offset, tokens, step)
            offset += length
        self.sequences += 1

    def document(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        """Full windows at once; the rest waits in the pool."""
        total, longest = len(ids) // 4, self.tiers[-1]
        for start in range(0, total - longest + 1, longest):
            part = ids[4 * start:4 * (start + longest)]
            yield from self.sequence([(longest, 0, doc_id, start, part, total)])
        if rest := total % longest:
            self.number += 1
            at = total - rest
            bisect.insort(self.pool, (rest, self.number, doc_id, at, ids[4 * at:], total))
        if len(self.pool) >= BUFFER:
            yield from self.pack(last=False)

    def _head(self, piece: tuple, size: int) -> tuple:
        """The first ``size`` ids of a rest; what is left of it goes back to the pool."""
        length, number, doc_id, start, ids, total = piece
        if length > size:
            bisect.insort(
                self.pool, (length - size, number, doc_id, start + size, ids[4 * size:], total))
        return size, number, doc_id, start, ids[:4 * size], total

    def pack(self, last: bool) -> Iterator[tuple]:
        """Fill sequences, longest tier first, as long as the pool can fill one."""
        left = sum(p[0] for p in self.pool)
        for tier, below in reversed(list(zip(self.tiers, [0, *self.tiers], strict=False))):
            while left >= tier and self.pool[-1][0] > below:
                pieces = [self.pool.pop()]
                gap = tier - pieces[0][0]
                while gap:
                    fits = bisect.bisect_right(self.pool, gap, key=lambda p: p[0])
                    piece = self.pool.pop(fits - 1) if fits else self._head(self.pool.pop(0), gap)
                    pieces.append(piece)
                    gap -= piece[0]
                yield from self.sequence(pieces)
                left -= tier
            if self.pool and self.pool[-1][0] > below:
                break  # too few ids for a sequence of this tier: they wait for more
        if last:
            yield from self._powers()

    def _powers(self) -> Iterator[tuple]:
        """The last ids of a task, cut at powers of two so that nothing is padded."""
        left = sum(p[0] for p in self.pool)
        while left:
            size = gap = min(1 << (left.bit_length() - 1), self.tiers[-1])
            pieces = []
            while gap:
                piece = self.pool.pop()
                pieces.append(self._head(piece, min(gap, piece[0])))
                gap -= pieces[-1][0]
            yield from self.sequence(pieces)
            left -= size


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS,
                   step_tokens: int = 16_384, held: int | None = None) -> DataFrame:
    """One row per piece; tiers must be powers of two.

    A null or empty text is a document of the end id alone.  Every row of
    ``docs`` is a document of its own, also when doc_id repeats or is null.
    sequence_tokens is the sequence's number of tokens (always a power of two, so
    there is no padding), step_id its step group.  Ids of sequences and groups
    are unique over all tasks but not consecutive.  An empty table gives no rows;
    columns other than doc_id and text are not read.  With ``held`` a task's caches
    have so many entries and go with it; else they stay with the worker.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            pieces, end = pieces_of_task(path, held), end_id.to_bytes(4, "little")
            packer = Packer(tiers, TaskContext.get().partitionId() << 36, step_tokens)
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    yield from packer.document(doc_id, pieces.ids(text or "") + end)
            yield from packer.pack(last=True)

        return emit(rows(), _SCHEMA)

    return docs.select("doc_id", "text").mapInArrow(pack, COLUMNS)
