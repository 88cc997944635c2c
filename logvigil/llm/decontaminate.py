"""Benchmark decontamination: a broadcast set of test n-grams scans the training words.

A word is a run of ASCII letters and digits and of all characters beyond ASCII,
with A-Z in lower case.  Each benchmark item is cut into windows of ``n`` words
(one shorter window when it has fewer words).  Windows are found in a document
by a rolling hash over its words and confirmed word by word.

The set of windows is broadcast in slices of at most ``slice_windows`` windows,
each scanned in its own pass; a benchmark of up to that many windows needs one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logvigil.llm.stages import Stages, batches_of, texts_of

WINDOW = 13
#: Bounds a broadcast slice to some hundred MB of window texts and their item lists.
SLICE_WINDOWS = 200_000
#: Separators become spaces, A-Z become a-z; bytes beyond ASCII stay.
_TO_WORDS = bytes(
    b if b >= 0x80 or chr(b).isdigit() or chr(b).isalpha() and chr(b).islower()
    else b + 32 if chr(b).isalpha() else 0x20
    for b in range(256)
)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TO_WORDS).split()


def _rolled(ids: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of ``size`` ids."""
    total = np.zeros(len(ids) - size + 1, np.uint64)
    for i in range(size):
        total *= _FACTOR
        total += ids[i:i + len(total)]
    return total


class WindowSet:
    """Windows of one slice, ready for scanning.

    ``windows`` maps the words of a window, joined by spaces, to its item ids.
    """

    def __init__(self, windows: dict[bytes, list]):
        self.windows = windows
        self.ids: dict[bytes, int] = {}
        by_size: dict[int, list[bytes]] = defaultdict(list)
        for window in windows:
            words = window.split()
            by_size[len(words)].append(window)
            for word in words:
                self.ids.setdefault(word, len(self.ids) + 1)
        self.hashes = {
            size: np.unique(np.concatenate([_rolled(self.numbers(w.split()), size) for w in group]))
            for size, group in by_size.items()
        }

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Word numbers, spread over 64 bits; 0 for words no window has."""
        get = self.ids.get
        found = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        found *= np.uint64(0xD6E8FEB86659FD93)
        found ^= found >> np.uint64(32)
        return found

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit spans (start, end) in words, merged and in order, and the items found."""
        spans, items = [], set()
        numbers = self.numbers(words)
        for size, hashes in self.hashes.items():
            if len(words) < size:
                continue
            unknown = np.concatenate([[0], np.cumsum(numbers == 0)])
            starts = np.flatnonzero(unknown[size:] == unknown[:-size])
            if not len(starts):
                continue
            rolled = _rolled(numbers, size)[starts]
            at = np.minimum(np.searchsorted(hashes, rolled), len(hashes) - 1)
            for start in starts[hashes[at] == rolled].tolist():
                found = self.windows.get(b" ".join(words[start:start + size]))
                if found is not None:
                    spans.append((start, start + size))
                    items.update(found)
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """(window, items): each distinct window once, with the ids of the items that hold it."""
    schema = pa.schema([("window", pa.binary()), ("item", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {"window": [], "item": []}
            for item, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                words = words_of(text)
                windows = {b" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))}
                rows["window"] += windows - {b""}
                rows["item"] += [item] * len(windows - {b""})
            yield batches_of(rows, schema)

    cut_up = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    return cut_up.mapInArrow(cut, "window binary, item string").groupBy("window").agg(
        F.collect_set("item").alias("items")
    )


_HITS = (
    "doc_id long, key long, n_words long, "
    "spans array<struct<start:int,end:int>>, items array<string>"
)


def find_hits(docs: DataFrame, windows: dict[bytes, list]) -> DataFrame:
    """One row per row of ``docs``: its words, hit spans in words, and items found.

    ``key`` is Spark's xxhash64 of the text and tells texts of one doc_id apart.
    """
    fields = pa.schema([
        ("doc_id", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ("items", pa.list_(pa.string())),
    ])
    sent = docs.sparkSession.sparkContext.broadcast(windows)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = WindowSet(sent.value)
        for batch in batches:
            rows: dict[str, list] = {f.name: [] for f in fields}
            rows["doc_id"], rows["key"] = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for text in texts_of(batch):
                words = words_of(text)
                spans, items = windows.scan(words)
                rows["n_words"].append(len(words))
                rows["spans"].append([{"start": a, "end": b} for a, b in spans])
                rows["items"].append(sorted(items))
            yield batches_of(rows, fields)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))
    return rows.mapInArrow(scan, _HITS)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, one_in: int = 20,
                  slice_windows: int = SLICE_WINDOWS) -> DataFrame:
    """Digest of the benchmark windows in each document: one row per row of ``docs``.

    Columns: doc_id, n_words, n_hit (words inside any window found), n_items,
    items_sha256, contaminated (n_hit > 0 and one_in * n_hit >= n_words), spans
    (merged hit spans in words), items, key.

    A null or empty text has no words and no hits, a null or empty benchmark text
    no window; items without an id still make hits but are in no list.  Rows that
    repeat a doc_id are judged each on its own text.  Columns other than doc_id,
    item_id and text are not read.
    """
    stages = Stages(docs.sparkSession)
    windows = stages.keep(benchmark_windows(benchmark, n), "windows")
    slices = max(1, -(-windows.count() // slice_windows))
    hits = []
    for i in range(slices):
        part = windows.where(F.pmod(F.xxhash64("window"), F.lit(slices)) == i).collect()
        hits.append(find_hits(docs, {bytes(r.window): [x for x in r["items"] if x is not None] for r in part}))
    found = hits[0]
    if slices > 1:
        for other in hits[1:]:
            found = found.unionByName(other)
        # equal rows of one slice are counted, and given back after the slices have met
        found = (
            found.groupBy("doc_id", "key", "n_words")
            .agg(F.flatten(F.collect_set("spans")).alias("spans"),
                 F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
                 (F.count(F.lit(1)) / slices).cast("int").alias("rows"))
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("rows"))))
            .drop("rows", "_copy")
            .withColumn("spans", _merge_spans(F.array_sort("spans")))
        )
    n_hit = F.aggregate("spans", F.lit(0).cast("long"),
                        lambda total, s: total + s["end"] - s["start"])
    return found.withColumn("n_hit", n_hit).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "spans", "items", "key",
    )


def _merge_spans(spans):
    """Overlapping spans of a sorted array made one."""
    kind = "array<struct<start:int,end:int>>"
    last = lambda kept: F.element_at(kept, -1)
    return F.aggregate(
        spans, F.array().cast(kind),
        lambda kept, s: F.when(
            (F.size(kept) > 0) & (s["start"] <= last(kept)["end"]),
            F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(F.struct(
                last(kept)["start"].alias("start"),
                F.greatest(last(kept)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(kept, F.array(s))),
    )

