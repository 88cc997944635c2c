"""Join of texts on the Jaccard similarity of their word n-grams, by prefix filtering.

N-grams are ordered from rare to frequent.  Two sets at the least similarity share one of
the first few n-grams of this order, so only these prefixes are joined.  A pair that meets
there must pass three filters before its sets are compared, once: by length, by position (what is
left behind the last shared prefix n-gram), and by suffix (n-grams counted in parts;
the differences of the counts bound the differences of the sets).

N-grams held by one set only come first in the order and match nothing; a set with enough of them has
no partner.  Most sets are told apart this way from a quarter of their n-grams, before any others move.

Equal sets are one class.  A group of similar classes shares its prefix n-grams, so pairs are not taken
out of whole groups: see ``links``.  The hub of an n-gram is the class with the fewest n-grams of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from logvigil.functions.skew import balanced_join
from logvigil.llm.components import components
from logvigil.llm.links import PACKED, UNIT, confirmed, hub_pairs, links_that_remain, part_counts
from logvigil.llm.stages import Stages, short_lived_shuffles, texts_of
from logvigil.llm.words import WordHashes, shingles, words_of

#: One n-gram in so many is looked at to find sets that have too many of their own.
SHARE = 4


def least_shared(n: str, percent: int) -> Column:
    """The n-grams a set of ``n`` shares with any partner, at least."""
    return F.expr(f"({n} * {percent} + 99) div 100")


def _grams(docs: DataFrame, size: int, share: int) -> DataFrame:
    """(doc_id, set_key, n, grams): distinct n-grams; of every ``share``-th hash only."""
    schema = pa.schema([("doc_id", pa.int64()), ("set_key", pa.binary()), ("n", pa.int64()),
                        ("grams", pa.list_(pa.int64()))])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            keys, counts, held, ends = [], [], [], [0]
            for text in texts_of(batch):
                found = shingles(hashes.of(words_of(text)), size)
                keys.append(xxhash.xxh3_128_digest(found.tobytes()))
                counts.append(len(found))
                held.append(found[found % np.uint64(share) == 0] if share > 1 else found)
                ends.append(ends[-1] + len(held[-1]))
            flat = np.concatenate(held).view(np.int64) if held else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        collect, "doc_id long, set_key binary, n long, grams array<long>")


def _with_partners(signed: DataFrame, percent: int) -> DataFrame:
    """(set_key, key, node, n) of the classes not dismissed for the n-grams that only they hold.

    These are counted among the n-grams looked at, so at most too few are
    found and nothing with a partner is dismissed.
    """
    classes = signed.where("n > 0 and doc_id is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("node"), F.first("n").alias("n"))
    own = (
        signed.where("doc_id is not null")
        .select(F.xxhash64("set_key").alias("key"), F.explode("grams").alias("gram"))
        .groupBy("gram").agg(F.min("key").alias("key"), F.max("key").alias("last"))
        .where("key = last").groupBy("key").agg(F.count(F.lit(1)).alias("own"))
    )
    return (
        classes.withColumn("key", F.xxhash64("set_key")).join(own, "key", "left")
        .where(F.col("n") - F.coalesce("own", F.lit(0)) >= least_shared("n", percent)).drop("own")
    )


def _ordered(pairs: DataFrame, classes: DataFrame, percent: int, stages: Stages) -> DataFrame:
    """(key, node, n, m, first, members, p0..p3) of classes with a shared n-gram in their prefix.

    The m n-grams that other classes hold too are ``members``, and ``first`` lists those of the prefix,
    rare ones first; the n - m others come before them in the order.
    """
    shared = stages.keep(pairs.groupBy("gram").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1"), "shared")
    held = balanced_join(pairs, shared, ["gram"], shared, "holders", ["key"], "inner", UNIT)
    lists = held.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("holders", "gram")))["gram"].alias("grams"))
    prefix = F.col("n") - least_shared("n", percent) + 1 - (F.col("n") - F.size("grams"))
    ready = classes.select("key", "node", "n").join(lists, "key").withColumn("prefix", prefix.cast("int"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, node, n, grams, prefix = batch.columns
            sets = [x.values.to_numpy().view(np.uint64) for x in grams]
            counts = np.array([part_counts(x) for x in sets], np.int64).reshape(-1, len(PACKED))
            first = [x[:k].view(np.int64) for x, k in zip(sets, prefix.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [key, node, n, pa.array([len(x) for x in sets], pa.int64()), pa.array(first, pa.list_(pa.int64())),
                 pa.array([np.sort(x).tobytes() for x in sets], pa.binary()), *map(pa.array, counts.T.copy())],
                names=["key", "node", "n", "m", "first", "members", *PACKED])

    return ready.where("prefix > 0").select("key", "node", "n", "grams", "prefix").mapInArrow(
        pack, "key long, node long, n long, m long, first array<long>, members binary, "
              + ", ".join(f"{p} long" for p in PACKED))


def _labels(docs: DataFrame, classes: DataFrame, size: int, percent: int, stages: Stages) -> DataFrame | None:
    """(node, component) of all classes with links; None without any."""
    # every n-gram of one text of each class that is left
    texts = docs.join(classes.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    pairs = stages.keep(
        _grams(texts, size, 1).select(F.xxhash64("set_key").alias("key"), "grams").join(
            classes.select("key"), "key", "left_semi").dropDuplicates(["key"])
        .select("key", F.explode("grams").alias("gram")), "grams")
    sets = stages.keep(_ordered(pairs, classes, percent, stages), "ordered")
    stages.drop(pairs)
    postings = stages.keep(
        sets.select("key", "node", "n", "m", (F.col("n") - F.col("m")).alias("rank"), *PACKED,
                    F.posexplode("first").alias("at", "bucket"))
        .withColumn("at", F.col("at").cast("long")), "postings")
    met = stages.keep(hub_pairs(postings, percent), "hub-pairs")
    links = stages.keep(confirmed(met, sets, percent), "links")
    labels = None if links.isEmpty() else components(links, stages)
    more = stages.keep(links_that_remain(postings, sets, labels, percent, stages), "more-links")
    if not more.isEmpty():
        labels = components(links.unionByName(more), stages)
    stages.drop(sets, postings, met)
    return labels


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per row of ``docs``.

    Two texts link when 100 * shared >= percent * all of their distinct n-grams of ``size`` words
    (A-Z in lower case, as 64-bit hashes); a shorter text is one n-gram.  component_id is
    the smallest doc_id reachable over links.  Null and empty texts have no n-grams and link with
    nothing.  Rows that repeat a doc_id are texts of their own, each with the component of its
    own n-grams.  A row without doc_id links with nothing and has no component_id.  Equal
    sizes and ties need no order: a component does not depend on one.  A text of any
    length is one list of n-grams in one row.  Columns other than doc_id and text are not read.
    """
    stages = Stages(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with short_lived_shuffles(docs.sparkSession):
        sampled = stages.keep(_grams(docs, size, SHARE), "sampled")
        classes = stages.keep(_with_partners(sampled, percent), "classes")
        signed = stages.keep(sampled.drop("grams"), "signed")
        stages.drop(sampled)
        labels = _labels(docs, classes, size, percent, stages)
    nodes = signed.where("n > 0 and doc_id is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("rows"))
    if labels is not None:
        nodes = nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    else:
        nodes = nodes.withColumn("component", F.col("node"))
    nodes = nodes.select("set_key", "rows", "component")
    found = balanced_join(signed, nodes, ["set_key"], nodes, "rows", ["doc_id"], "left", UNIT)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(
        F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
