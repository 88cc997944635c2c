"""Isolation forest per investigation.

Liu, Ting and Zhou, "Isolation Forest", 2008: 100 trees over 256 rows each; the
5 % of events that are isolated soonest are outliers.

* sample: each tree draws its own rows from all rows of the investigation, by
  hashes of the event id, so a sample depends on neither partitioning nor retries;
* fit: one bounded group per investigation and tree;
* score: only ids and features go through Arrow; events and trees meet by
  (investigation, slice) with a large investigation cut in slices;
* threshold: the exact percentile over all events, in two scans of the scores: a
  histogram finds the narrow interval that holds it, and the unrounded scores of that
  interval are counted.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from logvigil.functions.skew import (
    UNIT, balanced_join, heavy_keys, repeat_lookup, slice_rows,
)
from logvigil.operators.features import feature_vector
from logvigil.session import cut_lineage

INV = "investigation_id"
TREES, SAMPLE, SEED, CONTAMINATION = 100, 256, 42, 0.05
_SCORE_UNIT = 100_000
_BLOCK = 4096
#: Intervals of the score histogram, from 0 to 1.
BINS = 1 << 17

TREE_SCHEMA = (
    f"{INV} string, tree int, scale double, feature array<int>, "
    "cut array<double>, low array<int>, high array<int>, depth array<float>"
)
SCORE_SCHEMA = f"{INV} string, event_id long, ml_score double"


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Average depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3)
    full = 2.0 * (np.log(big - 1.0) + np.euler_gamma) - 2.0 * (big - 1.0) / big
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, full))


def training_sample(rows: DataFrame, weights: DataFrame, seed: int = SEED) -> DataFrame:
    """(investigation, tree, event_id, features): 256 rows for each tree, or all if fewer.

    Every row may reach any tree.  A tree first takes the rows whose hash lies in its
    own arc of a circle, wide enough for twice the sample, then the 256 with the smallest
    hash of their own.  Arcs of neighbouring trees follow each other, so a row
    of a large investigation is looked at by one tree or none.
    """
    located = balanced_join(rows, weights, [INV], weights=weights, weight="events", row_id=["event_id"])
    share = F.least(F.lit(1.0), F.lit(2.0 * SAMPLE) / F.col("events"))
    place = F.pmod(F.xxhash64("event_id", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    drawn = located.withColumn("_share", share).withColumn("_place", place)
    turns = F.sequence(F.lit(0), F.ceil(F.col("_share") * TREES).cast("int"))
    trees = F.filter(
        F.transform(turns, lambda k: F.floor((F.col("_place") + k) / F.col("_share")).cast("int")),
        lambda t: t < TREES)
    candidates = (
        drawn.where(F.col("_place") < F.col("_share") * TREES)
        .select(INV, "event_id", "features", F.explode(F.array_distinct(trees)).alias("tree"))
    )
    order = Window.partitionBy(INV, "tree").orderBy(
        F.xxhash64("event_id", "tree", F.lit(seed + 1)), "event_id")
    return (
        candidates.withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= SAMPLE).drop("_n")
    )


def _fit(pdf: pd.DataFrame, seed: int) -> pd.DataFrame:
    pdf = pdf.sort_values("event_id", kind="stable")
    x = np.stack(pdf["features"].to_numpy()).astype(float)
    name, tree = pdf[INV].iloc[0], int(pdf["tree"].iloc[0])
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    feature, cut, low, high, depth = [], [], [], [], []
    rng = np.random.default_rng([seed, tree, zlib.crc32(str(name).encode())])
    todo = [(np.arange(len(x)), 0, -1, False)]
    while todo:
        members, level, parent, is_high = todo.pop()
        node = len(feature)
        if parent >= 0:
            (high if is_high else low)[parent] = node
        values = x[members]
        spread = np.flatnonzero(values.min(axis=0) < values.max(axis=0))
        leaf = level >= limit or len(members) <= 1 or len(spread) == 0
        column = 0 if leaf else int(rng.choice(spread))
        at = 0.0 if leaf else float(rng.uniform(values[:, column].min(), values[:, column].max()))
        feature.append(column)
        cut.append(at)
        low.append(node)       # a leaf leads to itself
        high.append(node)
        depth.append(float(level + _mean_path(len(members))) if leaf else 0.0)
        if not leaf:
            below = values[:, column] <= at
            todo.append((members[~below], level + 1, node, True))
            todo.append((members[below], level + 1, node, False))
    return pd.DataFrame({
        INV: [name], "tree": [tree], "scale": [float(max(_mean_path(len(x)), 1e-9))],
        "feature": [feature], "cut": [cut], "low": [low], "high": [high], "depth": [depth],
    })


def fit_forests(sample: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per investigation and tree, holding the tree as flat arrays."""
    # a sample is small but slow to fit: keep AQE from packing many into one task
    parts = int(sample.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = sample.repartition(parts, INV, "tree")
    return spread.groupBy(INV, "tree").applyInPandas(lambda pdf: _fit(pdf, seed), TREE_SCHEMA)


def _forest(trees: pa.Table) -> dict:
    """All trees of an investigation as one set of arrays."""
    rows = sorted(trees.to_pylist(), key=lambda r: r["tree"])
    starts = np.cumsum([0] + [len(r["feature"]) for r in rows])
    join = lambda key: np.concatenate([np.asarray(r[key]) for r in rows])
    moved = lambda key: np.concatenate([np.asarray(r[key]) + s for r, s in zip(rows, starts)])
    return {"roots": starts[:-1], "feature": join("feature"), "cut": join("cut"), "low": moved("low"),
            "high": moved("high"), "depth": join("depth"), "scale": rows[0]["scale"]}


def _score_block(x: np.ndarray, model: dict) -> np.ndarray:
    at = np.tile(model["roots"], (len(x), 1))
    row = np.arange(len(x))[:, None]
    for _ in range(int(np.ceil(np.log2(SAMPLE)))):
        down = x[row, model["feature"][at]] <= model["cut"][at]
        at = np.where(down, model["low"][at], model["high"][at])
    mean = model["depth"][at].mean(axis=1, dtype=float)
    return np.exp2(-mean / model["scale"])


def _score(events: pa.Table, trees: pa.Table) -> pa.Table:
    scores = [np.empty(0)]
    if events.num_rows:
        model = _forest(trees)
        column = events.column("features").combine_chunks()
        x = np.asarray(column.flatten()).reshape(len(column), -1)
        scores += [_score_block(x[i:i + _BLOCK], model) for i in range(0, len(x), _BLOCK)]
    return pa.table({INV: events.column(INV), "event_id": events.column("event_id"),
                     "ml_score": pa.array(np.concatenate(scores), pa.float64())})


def score_events(rows: DataFrame, trees: DataFrame, weights: DataFrame,
                 unit: int = _SCORE_UNIT) -> DataFrame:
    """(investigation, event_id, ml_score): near 1 for events that are isolated soon."""
    heavy = heavy_keys(weights, [INV], "events", unit)
    left = slice_rows(rows, heavy, [INV], ["event_id"])
    right = repeat_lookup(trees, heavy, [INV])
    return (
        left.groupBy(INV, "_slice").cogroup(right.groupBy(INV, "_slice"))
        .applyInArrow(_score, SCORE_SCHEMA)
    )


def outlier_cutoffs(scored: DataFrame, weights: DataFrame,
                    contamination: float = CONTAMINATION) -> DataFrame:
    """The score above which an event is an outlier, and the events counted.

    Linear interpolation between the two ranks around the percentile, the highest score
    having rank 0.  The first scan counts scores in ``BINS`` equal intervals, partly in each task;
    running totals tell which one or two intervals hold the ranks.  The second scan counts the
    unrounded scores of these intervals only, so the result is that of a full sort.
    """
    binned = scored.select(INV, "ml_score", F.least(
        F.floor(F.col("ml_score") * BINS), F.lit(BINS - 1)).cast("int").alias("_bin"))
    place = F.lit(contamination) * (F.col("events") - 1)
    ranks = weights.select(INV, "events", F.floor(place).alias("_first"), F.ceil(place).alias("_second"))
    downwards = Window.partitionBy(INV).orderBy(F.desc("_bin"))
    chosen = (
        binned.groupBy(INV, "_bin").agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.sum("_rows").over(downwards) - F.col("_rows"))
        .join(ranks, INV)
        .where((F.col("_before") <= F.col("_second")) & (F.col("_before") + F.col("_rows") > F.col("_first")))
        .drop("_rows")
    )
    inside = Window.partitionBy(INV, "_bin").orderBy(F.desc("ml_score"))
    counted = (
        binned.join(chosen, [INV, "_bin"])
        .groupBy(INV, "_bin", "_before", "_first", "_second", "events", "ml_score").agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_from", F.col("_before") + F.sum("_rows").over(inside) - F.col("_rows"))
    )
    at = lambda rank: F.max(F.when(
        (F.col("_from") <= F.col(rank)) & (F.col("_from") + F.col("_rows") > F.col(rank)), F.col("ml_score")))
    found = counted.groupBy(INV, "events").agg(at("_first").alias("_a"), at("_second").alias("_b"))
    between = (place - F.floor(place)) * (F.col("_b") - F.col("_a"))
    return found.select(INV, "events", (F.col("_a") + between).alias("cutoff"))


def isolation_forest(context: DataFrame, zone: str = "UTC", seed: int = SEED,
                     contamination: float = CONTAMINATION, unit: int = UNIT) -> DataFrame:
    """Set ``ml_is_anomaly`` on events that carry their source context.

    Events that share an id within an investigation share the verdict.
    """
    # read three times below: written once, so the source context is joined once
    rows = cut_lineage(
        context.drop("ml_is_anomaly").withColumn("features", feature_vector(zone))
    )
    slim = rows.select(INV, F.col("event_id").cast("long").alias("event_id"), "features")
    weights = cut_lineage(slim.groupBy(INV).agg(F.count(F.lit(1)).alias("events")))
    trees = cut_lineage(fit_forests(training_sample(slim, weights, seed), seed))
    scored = cut_lineage(score_events(slim, trees, weights))
    cutoffs = outlier_cutoffs(scored, weights, contamination)
    outliers = balanced_join(
        scored, cutoffs, [INV], weights=weights, weight="events", row_id=["event_id"], how="inner", unit=unit,
    ).where(F.col("ml_score") > F.col("cutoff")).select(
        INV, F.col("event_id").alias("_id"), F.lit(True).alias("_outlier")).distinct()
    same = [rows[INV].eqNullSafe(outliers[INV]), rows["event_id"].cast("long") == outliers["_id"]]
    joined = rows.join(outliers, same[0] & same[1], "left").drop(outliers[INV])
    return joined.withColumn("ml_is_anomaly", F.coalesce("_outlier", F.lit(False))).select(
        *[c for c in context.columns if c != "ml_is_anomaly"], "ml_is_anomaly"
    )
