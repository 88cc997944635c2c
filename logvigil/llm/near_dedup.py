"""Near-duplicate documents by circulant MinHash.

Two permutations make the whole signature: ``sigma`` scatters a shingle over a
universe of D places, ``pi`` ranks the places, and coordinate k is the smallest
rank among the document's places after a circular shift by k.  A shingle's ranks for
all shifts are one run of ``pi``, so a signature is an element-wise minimum of
runs.  Bands of coordinates are buckets; what meets in a bucket is a candidate,
and every link is confirmed on full shingle sets.

Documents with equal sets are one class from the start.  The classes of a bucket are settled as
``links`` says; the hub of a bucket is the class that meets most others in all its buckets, as the text
does that copies were made from.  So no link between components that meet in a bucket is missed, and
large groups of copies cost a few rows per copy.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from logvigil.functions.skew import balanced_join
from logvigil.llm.components import components
from logvigil.llm.links import PACKED, UNIT, confirmed, hub_pairs, links_that_remain, part_counts
from logvigil.llm.stages import Stages, short_lived_shuffles, texts_of
from logvigil.llm.words import WordHashes, mixed, shingles, words_of

#: 32 bands of 5: at a similarity of 0.8 a pair meets in no band once in 300,000 times.
BANDS, ROWS = 32, 5
#: Places of the universe, as a power of two; beyond some million shingles a text
#: saturates it and its coordinates say little, which costs comparisons, not results.
UNIVERSE = 22
#: Ids that may be broadcast: 32 MB.
BROADCAST_IDS = 4_000_000


@functools.cache
def _runs(coordinates: int) -> np.ndarray:
    """Row p holds ``pi`` at p, p + 1, ... p + coordinates - 1, circularly; a view, not a copy."""
    pi = np.random.default_rng(5).permutation(1 << UNIVERSE).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:coordinates]]), coordinates)


def _sigma(found: np.ndarray) -> np.ndarray:
    """Places of shingles: a fixed permutation of the universe over their lowest bits."""
    mask = np.uint64((1 << UNIVERSE) - 1)
    x = (found & mask) * np.uint64(2 * 1_287_643 + 1) & mask
    x ^= x >> np.uint64(UNIVERSE // 2)
    return (x * np.uint64(2 * 911_777 + 1) & mask).astype(np.int64)


def signature(found: np.ndarray, coordinates: int) -> np.ndarray:
    runs, places = _runs(coordinates), _sigma(found)
    best = np.full(coordinates, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(places), 512):
        np.minimum(best, runs[places[at:at + 512]].min(axis=0), out=best)
    return best


def signatures(docs: DataFrame, size: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, set_key, n, bands, parts) of every row; without words no bands."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("set_key", pa.binary()), ("n", pa.int64()),
        ("bands", pa.list_(pa.int64())), ("parts", pa.list_(pa.int64())),
    ])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        nth = np.arange(bands, dtype=np.uint64)
        for batch in batches:
            keys, counts, buckets, parts = [], [], [], []
            for text in texts_of(batch):
                found = shingles(hashes.of(words_of(text)), size)
                keys.append(xxhash.xxh3_128_digest(found.tobytes()))
                counts.append(len(found))
                parts.append(part_counts(found))
                if not len(found):
                    buckets.append([])
                    continue
                signed = signature(found, bands * rows)
                total = nth.copy()
                for column in signed.reshape(bands, rows).T.astype(np.uint64):
                    total = mixed(total + np.uint64(0x9E3779B97F4A7C15)) + column
                buckets.append(mixed(total).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()),
                 pa.array(buckets, pa.list_(pa.int64())), pa.array(parts, pa.list_(pa.int64()))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        sign, "doc_id long, set_key binary, n long, bands array<long>, parts array<long>")


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """(set_key, members): full sets as packed sorted 64-bit numbers."""
    schema = pa.schema([("set_key", pa.binary()), ("members", pa.binary())])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(hashes.of(words_of(t)), size).tobytes() for t in texts_of(batch)]
            keys = [xxhash.xxh3_128_digest(x) for x in sets]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(collect, "set_key binary, members binary")


def _settled(docs: DataFrame, size: int, percent: int, bands: int, rows: int, hub_turns: int,
             stages: Stages) -> tuple[DataFrame | None, DataFrame, DataFrame]:
    """Labels (node, component) of classes with links, or None; the signatures and the classes."""
    signed = stages.keep(signatures(docs, size, bands, rows), "signatures")
    # rows of one set hold equal bands and parts, so any of them will do
    classes = stages.keep(
        signed.where("n > 0 and doc_id is not null").groupBy("set_key").agg(
            F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands"),
            F.first("parts").alias("parts"), F.count(F.lit(1)).alias("rows"))
        .withColumn("key", F.xxhash64("set_key")), "classes")
    members = classes.select("key", "node", "n", *[F.col("parts")[i].alias(p) for i, p in enumerate(PACKED)],
                             F.explode("bands").alias("bucket"))
    shared = stages.keep(
        members.groupBy("bucket").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1"), "shared-buckets")
    met = stages.keep(balanced_join(members, shared, ["bucket"], shared, "classes", ["key"], "inner", UNIT), "met")
    central = met.groupBy("key").agg((-F.sum("classes")).alias("rank"))
    # buckets have no order, so any member may be shared at any place
    crowded = stages.keep(
        met.drop("classes").join(central, "key").withColumns({"m": F.col("n"), "at": F.lit(0).cast("long")}), "buckets")
    stages.drop(met, shared)
    candidates = crowded.select("node").distinct()
    held = F.broadcast(candidates) if candidates.count() <= BROADCAST_IDS else candidates
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        held.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi")
    sets = stages.keep(
        shingle_sets(texts, size).dropDuplicates(["set_key"])
        .join(classes.select("set_key", "key", "node", "n"), "set_key").drop("set_key"), "sets")
    labels = links = None
    if hub_turns:
        pairs = stages.keep(hub_pairs(crowded, percent), "hub-pairs")
        links = stages.keep(confirmed(pairs, sets, percent), "links")
        labels = None if links.isEmpty() else components(links, stages)
    more = stages.keep(
        links_that_remain(crowded, sets, labels, percent, stages, hubs_done=bool(hub_turns)), "more-links")
    if not more.isEmpty():
        labels = components(more if links is None else links.unionByName(more), stages)
    return labels, signed, classes


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS,
                    rows: int = ROWS, hub_turns: int = 1) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, set_key): one row per row of ``docs``.

    Documents are linked when 100 * shared >= percent * all of their distinct
    ``size``-word shingles.  component_id is the smallest doc_id reachable over links,
    kept is doc_id = component_id.  Null and empty texts have no shingles and
    link with nothing.  Rows that repeat a doc_id are one document with several
    texts.  A text of any length is one set in one row; ties need no order.  A row without doc_id links with nothing, has no component_id and is
    kept.  Columns other than doc_id and text are not read.
    """
    stages = Stages(docs.sparkSession)
    with short_lived_shuffles(docs.sparkSession):
        labels, signed, classes = _settled(docs, size, percent, bands, rows, hub_turns, stages)
    nodes = classes.select("set_key", "node", "rows")
    if labels is not None:
        nodes = nodes.join(labels, "node", "left")
    else:
        nodes = nodes.withColumn("component", F.lit(None).cast("long"))
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(
        F.coalesce("component", "node", "doc_id"))
    return (
        balanced_join(signed.select("doc_id", "set_key", "n"), nodes, ["set_key"], nodes, "rows", ["doc_id"], "left", UNIT)
        .withColumn("component_id", component)
        .select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "set_key")
    )
