"""Stage tables in the shared folder, and small helpers around Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from logvigil.session import prepare, scratch_path

#: Texts handed to Python at a time, in bytes; keeps very long texts from piling up.
BATCH_BYTES = 4 << 20


class Stages:
    """Tables an operator writes on its way; each can be dropped when it has been used.

    Tables that have a column of ``by`` are stored in a folder for each of its values.
    """

    def __init__(self, spark: SparkSession, *by: str):
        self.spark, self.by = spark, by
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame, name: str = "stage") -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.partitionBy(*[c for c in self.by if c in df.columns]).parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(kept)] = (kept, path)
        return kept

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            _, path = self._paths.pop(id(table))
            target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when the query that wrote them ends: for jobs that write stage tables and run once."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """The UTF-8 bytes of a text column, without decoding."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.binary()).to_pylist()


def batches_of(rows: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(rows[f.name], f.type) for f in schema], schema=schema
    )


def emit(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Row tuples as batches of at most ``size`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*held, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )
