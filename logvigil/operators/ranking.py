"""Row numbers over whole groups without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logvigil.session import cut_lineage


def number_rows(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Add ``name``: 1, 2, ... in ``order`` within each group of ``keys``.

    The rows are range-partitioned by (keys, order) and numbered inside each
    partition; every partition then adds the rows its group has in earlier
    ones.  ``order`` must settle all ties.  The partitioned rows are written
    before they are numbered, so a task run again sees the same partitions.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = cut_lineage(
        df.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id())
    )
    sizes = spread.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(
        *keys, "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    return (
        spread.withColumn("_n", F.row_number().over(inside))
        .join(offsets, [*keys, "_part"])
        .withColumn(name, (F.col("_n") + F.col("_offset")).cast("long"))
        .drop("_n", "_part", "_offset")
    )
