"""Session settings and the shared folder for checkpoints and stage tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "logvigil", **conf: str) -> SparkSession:
    """Session with the settings the operators rely on.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: the submit
    command names the master, and AQE coalesces from the cluster's own initial
    partition number.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Settings a running session needs: UTC, and no oversized generated methods.

    The JVM never compiles methods above 8000 bytes; where one whole-stage
    method would be larger, operator-wise code is many times faster.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application below the one ``spark.checkpoint.dir`` names.

    The setting is required: the folder must be one that all executors share, and
    only the user can know it.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise ValueError("spark.checkpoint.dir must name a folder all executors share")
        sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


_written: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, never reused between runs."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def stage_scope(spark: SparkSession) -> Iterator[None]:
    """Removes the stage tables written inside it.

    Results are read from stage tables, so store or collect them before the
    scope ends.
    """
    before = len(_written)
    try:
        yield
    finally:
        while len(_written) > before:
            remove_path(spark, _written.pop())


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the written table.

    Survives the loss of any executor, is computed once, and later reads take
    only the columns they need.
    """
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
