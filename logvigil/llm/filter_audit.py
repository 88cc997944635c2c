"""How document filters interact, over every order of applying them.

Four filters judge a text by itself, the fifth finds repeated texts with radix tries.
Each task first puts its own texts into a trie: of equal texts only the smallest id stays
open, the others are repeats already.  Open texts are then range-partitioned by adaptive
prefixes: a prefix that starts more text than one trie should hold is prolonged, step by
step, until it is light.  Each prefix gets a compressed trie with the smallest id at
each text's end; a walk over it flags all others.  From there on a document is a mask of the
filters it fails; masks are counted, and all orders are computed from the counts.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logvigil.llm.stages import Stages, emit, texts_of

FILTERS = "ABCDE"
A, B, C, D, E = (1 << i for i in range(5))
#: Text a task holds before it writes what it has, and text one trie holds, in bytes.
HELD = 16 << 20
#: At most so many prefixes are prolonged at a step (hashes, so 16 MB); on tables above HELD times
#: this number the bound on a trie grows with the table.
LONGER = 1_000_000
#: Text in a range partition, in bytes.
PARTITION = 64 << 20
#: Prefix lengths in code points; no prefix is longer than the last but a whole text.
STEPS = tuple(8 * 4 ** i for i in range(9))

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUATION = bytes(range(0x80, 0xC0))
_SIGNS = b"#$%&*|"


def failures(text: bytes) -> int:
    """Mask of the filters A to D that a text fails."""
    words = text.split()
    upper = len(text) - len(text.translate(None, _UPPER))
    points = len(text.translate(None, _CONTINUATION))
    return (
        A * (len(words) < 200) | B * (100 * len(set(words)) < 50 * len(words))
        | C * (100 * upper > 3 * points) | D * (len(text.translate(None, _SIGNS)) < len(text))
    )


class _Node:
    __slots__ = ("label", "children", "least", "rows")

    def __init__(self, label: bytes):
        self.label, self.children = label, {}
        self.least, self.rows = None, None


def _common(a: bytes, b: bytes) -> int:
    """Length of the common start of two byte strings, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class RadixTrie:
    """Compressed trie of texts with the smallest id and the rows of each text at its end."""

    def __init__(self):
        self.root = _Node(b"")
        self.held = 0

    def _end(self, text: bytes) -> _Node:
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = _Node(text[at:])
                return child
            if text.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            cut = _common(child.label, text[at:at + len(child.label)])
            upper = _Node(child.label[:cut])
            child.label = child.label[cut:]
            upper.children[child.label[0]] = child
            node.children[text[at]] = node = upper
            at += cut
        return node

    def insert(self, text: bytes, row: tuple, copies: int = 1) -> None:
        """Add ``copies`` rows (id, ...) of one text."""
        end = self._end(text)
        if end.rows is None:
            end.rows, end.least = {}, row[0]
            self.held += len(text)
        end.least = min(end.least, row[0])
        end.rows[row] = end.rows.get(row, 0) + copies

    def walk(self) -> Iterator[tuple[bytes, tuple, int, bool]]:
        """(text, row, copies, whether an equal text has a smaller id)."""
        waiting = [(self.root, b"")]
        while waiting:
            node, before = waiting.pop()
            text = before + node.label
            for row, copies in (node.rows or {}).items():
                yield text, row, copies, row[0] > node.least
            waiting += [(child, text) for child in node.children.values()]


_ROWS = [("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("copies", pa.int64())]


def _sift(docs: DataFrame, part: str) -> DataFrame:
    """(doc_id, part, mask, copies, text): text only where a smaller id elsewhere may have it too."""
    schema = pa.schema([*_ROWS, ("text", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, without_id = RadixTrie(), Counter()
        for batch in batches:
            ids, parts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, p, text in zip(ids, parts, texts_of(batch), strict=True):
                mask = failures(text)
                if i is None:
                    without_id[p, mask] += 1
                    continue
                trie.insert(text, (i, p, mask))
                if trie.held >= HELD:
                    yield from emit(settled(trie), schema)
                    trie = RadixTrie()
        yield from emit(settled(trie), schema)
        yield from emit(((None, p, mask, n, None) for (p, mask), n in without_id.items()), schema)

    def settled(trie: RadixTrie) -> Iterator[tuple]:
        for text, row, copies, repeated in trie.walk():
            i, p, mask = row
            yield (i, p, mask | E, copies, None) if repeated else (i, p, mask, copies, text)

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).mapInArrow(rows, "doc_id long, part string, mask int, copies long, text string")


def _prefixed(open_rows: DataFrame) -> DataFrame:
    """Add ``prefix``: the shortest of the step lengths that starts no more text than a trie should hold."""
    weight = F.octet_length("text").cast("long")
    steps = F.array(*[
        F.when(F.length("text") > n, F.struct(F.lit(n).alias("step"), F.xxhash64(F.substring("text", 1, n)).alias("start")))
        for n in STEPS
    ])
    weights = (
        open_rows.select(weight.alias("bytes"), F.explode(F.array_compact(steps)).alias("at"))
        .groupBy("at.step", "at.start").agg(F.sum("bytes").alias("bytes"))
    )
    total = open_rows.agg(F.sum(weight)).first()[0] or 0
    heavy = Stages(open_rows.sparkSession).keep(
        weights.where(F.col("bytes") > max(HELD, total // LONGER)).select("step", "start"), "heavy-prefixes")
    length = F.lit(STEPS[0])
    for i, row in enumerate(sorted(r[0] for r in heavy.select("step").distinct().collect())):
        longer = F.broadcast(heavy.where(F.col("step") == row).select(F.col("start").alias(f"_start{i}")))
        open_rows = open_rows.join(longer, F.xxhash64(F.substring("text", 1, row)) == F.col(f"_start{i}"), "left")
        following = next((n for n in STEPS if n > row), (1 << 31) - 1)
        length = F.when(F.col(f"_start{i}").isNotNull() & (F.length("text") > row), following).otherwise(length)
    parts = max(int(open_rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // PARTITION)
    return (
        open_rows.withColumn("_n", length)
        .select("doc_id", "part", "mask", "copies", "text", F.expr("substring(text, 1, _n)").alias("prefix"))
        .repartitionByRange(parts, "prefix").sortWithinPartitions("prefix")
    )


def _repeats(prefixed: DataFrame) -> DataFrame:
    """(doc_id, part, mask, copies) with E settled, one trie a prefix."""
    schema = pa.schema(_ROWS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        trie, current = RadixTrie(), None
        for batch in batches:
            fixed = (batch.column(i).to_pylist() for i in range(4))
            prefixes = batch.column(5).to_pylist()
            for *row, copies, prefix, text in zip(*fixed, prefixes, texts_of(batch), strict=True):
                if prefix != current:
                    yield from settled(trie)
                    trie, current = RadixTrie(), prefix
                trie.insert(text, tuple(row), copies)
        yield from settled(trie)

    def settled(trie: RadixTrie) -> Iterator[tuple]:
        for _, (i, p, mask), copies, repeated in trie.walk():
            yield i, p, mask | E * repeated, copies

    return prefixed.mapInArrow(lambda batches: emit(rows(batches), schema),
                               "doc_id long, part string, mask int, copies long")


def failed_filters(docs: DataFrame, part: str = "lang") -> DataFrame:
    """(doc_id, part, mask, copies): the filters each document fails, as bits of A to E.

    Null texts are empty ones, a null ``part`` is the empty string.  Rows that repeat
    id, part and text are one row with their number in ``copies``, which may also come in several
    rows.  A text fails E if a smaller doc_id holds the same text, whatever its part; rows without
    doc_id neither fail E nor make others fail it.  Texts of any length are compared
    whole.  Columns other than doc_id, text and ``part`` are not read.
    """
    sifted = Stages(docs.sparkSession).keep(_sift(docs, part), "sifted")
    settled = sifted.where("text is null").drop("text")
    return settled.unionByName(_repeats(_prefixed(sifted.where("text is not null"))))


def filter_orders() -> list[tuple[str, list[tuple[int, int]]]]:
    """Every order of the filters with (its bit, the bits before it) of each step."""
    out = []
    for order in itertools.permutations(FILTERS):
        bits = [1 << FILTERS.index(f) for f in order]
        out.append(("".join(order), [(bit, sum(bits[:i])) for i, bit in enumerate(bits)]))
    return out


def interactions(tallies: DataFrame) -> DataFrame:
    """All orders and steps of every part, from (part, mask, n, good, toxic) with one row a mask.

    A part's counts are 32 rows at most, so one task computes all orders of it.
    """
    fields = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()),
                        *[(f, pa.int64()) for f in fields]])

    def audit(part: str, masks: list[dict]) -> list[tuple]:
        out, by_filter = [], {}
        for order, steps in filter_orders():
            for step, (bit, before) in enumerate(steps, 1):
                here = [m for m in masks if m["mask"] & bit and not m["mask"] & before]
                removed = sum(m["n"] for m in here)
                by_filter[bit] = by_filter.get(bit, 0) + removed
                out.append((bit, part, order, step,
                            sum(m["n"] for m in masks if not m["mask"] & (bit | before)), removed,
                            sum(m["n"] for m in masks if m["mask"] & bit and m["mask"] & before),
                            sum(m["n"] for m in masks if m["mask"] == bit),
                            sum(m["good"] for m in here), sum(m["toxic"] for m in here)))
        return [(*row, by_filter[bit]) for bit, *row in out]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for part, masks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from audit(part, masks)

    per_part = tallies.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    return per_part.mapInArrow(
        lambda batches: emit(rows(batches), schema),
        "part string, filter_order string, step int, " + ", ".join(f"{f} long" for f in fields))


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step, zeros included.

    ``labels`` has doc_id, quality and toxic; several rows of a document count as one that
    holds each mark any of them has, and documents without labels or without id have none.
    An empty table has no parts and so no rows.  See ``failed_filters`` for the documents.
    """
    found = failed_filters(docs, part).groupBy("doc_id", "part", "mask").agg(F.sum("copies").alias("n"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    tallies = (
        found.join(marks, "doc_id", "left")
        .groupBy("part", "mask").agg(
            F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
            F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))
    )
    return interactions(tallies)
