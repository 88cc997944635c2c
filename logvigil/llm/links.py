"""Links between sets that meet in groups, without comparing all pairs of a group.

A row names a group (a MinHash bucket, a prefix n-gram), a class of equal sets (``key``; ``node`` is
its smallest doc_id), the size ``n`` of the set, how many members ``m`` other sets may share, the
place ``at`` of the group's member among these where they are ordered (0 where not), counts of them by
parts, and a ``rank``: the class of smallest rank is the group's hub.

First the classes of a group are compared with its hub.  Where classes then lie outside the hub's
component, these meet all others of the group, in pairs of bounded blocks: bounds tell which rows may
link at all, of groups left with the same rows one is taken, only its rows are joined to their sets, and a block
returns only links that join components in it.  So no link between components is missed, rows grow with the classes and not with their pairs, and no
task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from logvigil.functions.skew import balanced_join
from logvigil.llm.stages import Stages

#: Parts that the members of a set are counted in: eight bytes in each of four numbers.
PARTS = 32
PACKED = tuple(f"p{i}" for i in range(PARTS // 8))
#: Classes of a group that a block holds, and members of their sets.
BLOCK, MEMBERS = 1024, 1 << 20
#: Rows a join key may have in one place.
UNIT = 4096

_SIDE = ("key", "n", "m", "at", *PACKED)


def part_counts(found: np.ndarray) -> np.ndarray:
    """Members of a set of 64-bit numbers by parts, packed; 255 of a part at most, which only weakens the bound."""
    counts = np.bincount((found >> np.uint64(8)).astype(np.int64) % PARTS, minlength=PARTS)
    return np.minimum(counts, 255).astype(np.uint8).view(np.int64)


def _may_link(x: str, y: str, percent: int) -> Column:
    """Length, position and part filters on struct columns of one group.

    Before places x.at and y.at lie that many shared members at most, behind them no more than either
    side has left; and what counts by parts differ by, the sets do too.
    """
    apart = F.expr(f"{x}.n - {x}.m + {y}.n - {y}.m")
    for p in PACKED:
        for i in range(8):
            a, b = (F.shiftrightunsigned(f"{side}.{p}", 8 * i).bitwiseAND(F.lit(255)) for side in (x, y))
            apart = apart + F.abs(a - b)
    least = F.expr(f"({percent} * ({x}.n + {y}.n) + {percent} + 99) div {100 + percent}")
    return (
        F.expr(f"100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n)")
        & (F.expr(f"least({x}.at, {y}.at) + least({x}.m - {x}.at, {y}.m - {y}.at)") >= least)
        & (apart <= F.expr(f"{x}.n + {y}.n") - 2 * least)
    )


def hub_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a = hub, b): keys that may link, each class with the hubs of its groups."""
    hubs = rows.groupBy("bucket").agg(
        F.min(F.struct("rank", *_SIDE)).alias("x"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    asking = rows.select("bucket", "key", F.struct(*_SIDE).alias("y"))
    return (
        balanced_join(asking, hubs, ["bucket"], hubs, "classes", ["key"], "inner", UNIT)
        .where("x.key <> y.key").where(_may_link("x", "y", percent))
        .select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()
    )


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between nodes of the pairs of keys whose whole sets reach the similarity.

    ``sets`` has key, node, n and members (packed, sorted).  A hub with many partners is joined in slices.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            sides = zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True)
            shared = np.fromiter(
                (len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                 for x, y in sides), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("node_a"), batch.column("node_b")], schema=schema).filter(
                pa.array(100 * shared >= percent * (total - shared)))

    per_hub = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("partners"))
    side = lambda s, m: sets.select(
        F.col("key").alias(s), F.col("node").alias(f"node_{s}"), F.col("n").alias(f"n_{s}"), F.col("members").alias(m))
    sides = balanced_join(pairs.join(side("b", "right"), "b"), side("a", "left"), ["a"], per_hub, "partners", ["b"],
                          "inner", UNIT)
    return sides.select("node_a", "node_b", "n_a", "n_b", "left", "right").mapInArrow(verify, "a long, b long")


class _Block:
    """The rows of a pair of blocks, and which of them may link."""

    def __init__(self, group: pa.Table, percent: int):
        self.percent = percent
        self.asks, self.outside = (group.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "outside"))
        self.key, self.node, self.n, self.m, self.at, self.component = (
            group.column(c).to_numpy() for c in ("key", "node", "n", "m", "at", "component"))
        counts = np.stack([group.column(p).to_numpy() for p in PACKED], axis=1)
        self.counts = counts.view(np.uint8).astype(np.int16)
        self.targets = np.flatnonzero(~self.asks)

    def least(self, i, j):
        return (self.percent * (self.n[i] + self.n[j]) + self.percent + 99) // (100 + self.percent)

    def partners(self, i: int) -> np.ndarray:
        """Places of other components that row i may link with, likely ones first."""
        t = self.targets
        t = t[(self.component[t] != self.component[i]) & (~self.outside[t] | (self.key[t] > self.key[i]))]
        t = t[100 * np.minimum(self.n[t], self.n[i]) >= self.percent * np.maximum(self.n[t], self.n[i])]
        least = self.least(i, t)
        most = np.minimum(self.at[t], self.at[i]) + np.minimum(self.m[t] - self.at[t], self.m[i] - self.at[i])
        t, least = t[most >= least], least[most >= least]
        apart = np.abs(self.counts[t] - self.counts[i]).sum(axis=1) + self.n[t] - self.m[t] + self.n[i] - self.m[i]
        near = apart <= self.n[t] + self.n[i] - 2 * least
        return t[near][np.argsort(apart[near], kind="stable")]


def links_that_remain(rows: DataFrame, sets: DataFrame, labels: DataFrame | None, percent: int, stages: Stages,
                      hubs_done: bool = True) -> DataFrame:
    """Links (a, b) between nodes of different components that share a group, enough to join all linked ones.

    ``labels`` has node and component for nodes that already have links.
    """
    if labels is None:
        labelled = rows.withColumn("component", F.col("node"))
    else:
        labelled = rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least_classes = 3 if hubs_done else 2     # two classes have met as hub and partner
    groups = labelled.groupBy("bucket").agg(
        F.min(F.struct("rank", "key", "component"))["component"].alias("main"), F.min("component").alias("low"),
        F.max("component").alias("high"), F.count(F.lit(1)).alias("classes"), F.sum("m").alias("members"),
    ).where(f"low <> high and classes >= {least_classes}").select("bucket", "main", "classes", F.expr(
        f"int(greatest(ceil(classes / {BLOCK}), ceil(members / {MEMBERS})))").alias("blocks"))
    placed = balanced_join(labelled, groups, ["bucket"], groups, "classes", ["key"], "inner", UNIT).withColumn(
        "outside", F.col("component") != F.col("main"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    own = F.array(F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    sides = placed.select("*", F.lit(False).alias("asks"), own.alias("mine"), every.alias("theirs")).unionByName(
        placed.where("outside").select("*", F.lit(True).alias("asks"), every.alias("mine"), own.alias("theirs")))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    where = ["bucket", "block", "asking"]
    fields = ["node", "component", "outside", "asks", *_SIDE]
    dealt = (
        sides.withColumn("block", F.explode("mine")).withColumn("asking", F.explode("theirs")).select(*where, *fields)
        # small rows, slow comparisons: keep AQE from packing many groups into one task
        .repartition(parts, *where)
    )

    def sieve(group: pa.Table) -> pa.Table:
        block = _Block(group, percent)
        kept = np.zeros(len(block.n), bool)
        for i in np.flatnonzero(block.asks):
            near = block.partners(i)
            kept[near] = True
            kept[i] = len(near) > 0
        order = np.lexsort((block.asks[kept], block.key[kept]))
        same = xxhash.xxh3_64_intdigest(block.key[kept][order].tobytes() + block.asks[kept][order].tobytes())
        # as a signed number
        same = np.full(int(kept.sum()), same, np.uint64).view(np.int64)
        return group.filter(pa.array(kept)).append_column("same", pa.array(same))

    may = stages.keep(dealt.groupBy(*where).applyInArrow(
        sieve, T.StructType([*dealt.schema.fields, T.StructField("same", T.LongType())])), "may-link")
    # long texts and copies share many groups with the same rows left: one of these groups will do
    once = may.groupBy(*where).agg(F.first("same").alias("same")).groupBy("same").agg(
        F.min(F.struct(*where)).alias("one")).select("one.*")
    may = may.join(once, where, "left_semi")

    def settle(group: pa.Table) -> pa.Table:
        block, packed = _Block(group, percent), group.column("members")
        joined: dict[int, int] = {}

        def top(c: int) -> int:
            while c in joined:
                c = joined[c]
            return c

        found = []
        for i in np.flatnonzero(block.asks):
            mine = np.frombuffer(packed[i].as_py(), np.uint64)
            for j in block.partners(i):
                a, b = top(block.component[i]), top(block.component[j])
                # each link found spares the other pairs of its components
                if a != b and len(np.intersect1d(
                        mine, np.frombuffer(packed[j].as_py(), np.uint64), assume_unique=True)) >= block.least(i, j):
                    joined[max(a, b)] = min(a, b)
                    found.append((block.node[i], block.node[j]))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()),
                         "b": pa.array([b for _, b in found], pa.int64())})

    held = may.join(sets.select("key", "members"), "key").repartition(parts, *where)
    return held.groupBy(*where).applyInArrow(settle, "a long, b long")
