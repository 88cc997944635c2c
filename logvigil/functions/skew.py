"""Joins that stay balanced when one key holds a large share of the rows.

A key heavier than ``unit`` rows is cut into slices of about ``unit`` rows: the
rows spread over the slices by the hash of a row id, and the lookup row of the
key is repeated once per slice.  Every heavy key is sliced.  The list of heavy keys is
read once: up to ``BROADCAST_KEYS`` of them travel as a broadcast, more are joined as
any other table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

UNIT = 1_000_000
#: Short rows, so a few tens of MB.
BROADCAST_KEYS = 200_000


def heavy_keys(weights: DataFrame, keys: list[str], weight: str, unit: int = UNIT) -> DataFrame:
    """Keys above ``unit`` rows with their number of slices."""
    heavy = weights.where(F.col(weight) > unit).select(
        *keys, F.ceil(F.col(weight) / unit).cast("int").alias("_slices"))
    found = heavy.limit(BROADCAST_KEYS + 1).collect()
    if len(found) > BROADCAST_KEYS:
        return heavy
    return F.broadcast(weights.sparkSession.createDataFrame(found, heavy.schema))


def slice_rows(rows: DataFrame, heavy: DataFrame, keys: list[str], row_id: list[str]) -> DataFrame:
    """Add ``_slice``: 0 for light keys, the row's slice for heavy ones."""
    spread = F.pmod(F.xxhash64(*row_id), F.col("_slices")).cast("int")
    return (
        rows.join(heavy, keys, "left")
        .withColumn("_slice", F.when(F.col("_slices").isNull(), 0).otherwise(spread))
        .drop("_slices")
    )


def repeat_lookup(lookup: DataFrame, heavy: DataFrame, keys: list[str]) -> DataFrame:
    """Repeat each lookup row once per slice of its key."""
    last = F.coalesce(F.col("_slices"), F.lit(1)) - 1
    return (
        lookup.join(heavy, keys, "left")
        .withColumn("_slice", F.explode(F.sequence(F.lit(0), last)))
        .drop("_slices")
    )


def balanced_join(rows: DataFrame, lookup: DataFrame, keys: list[str], weights: DataFrame,
                  weight: str, row_id: list[str], how: str = "left", unit: int = UNIT) -> DataFrame:
    """Join ``rows`` to a ``lookup`` that has one row per key.

    A lookup that carries the weight itself is repeated by it.
    """
    heavy = heavy_keys(weights, keys, weight, unit)
    left = slice_rows(rows, heavy, keys, row_id)
    if weight in lookup.columns:
        last = F.greatest(F.ceil(F.col(weight) / unit).cast("int"), F.lit(1)) - 1
        right = lookup.withColumn("_slice", F.explode(F.sequence(F.lit(0), last)))
    else:
        right = repeat_lookup(lookup, heavy, keys)
    return left.join(right, [*keys, "_slice"], how).drop("_slice")
