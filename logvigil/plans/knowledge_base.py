"""Knowledge-base ingestion: read, build records, embed, guard, upsert, store (K7, K8).

The base is plain Parquet partitioned by collection.  An ingestion rewrites the collections it
brings and leaves all others alone.  Vectors of few terms are a hundred times smaller in files than
in memory, so rows are dealt to tasks by their number, not by their bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from logvigil.operators.knowledge import space_outcomes, upsert
from logvigil.operators.retrieval import EMBEDDING_DIM, hashed_embedding
from logvigil.session import cut_lineage

#: Documents with their vectors that one task sorts or writes, about.
ROWS = 50_000


def read_base(spark: SparkSession, root: str) -> DataFrame | None:
    """The stored documents of all collections; None before the first ingestion."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    fields = spark.read.parquet(root).schema.fields
    return spark.read.schema(T.StructType([
        T.StructField(f.name, T.StringType() if f.name == "collection" else f.dataType) for f in fields
    ])).parquet(root)


def ingest(spark: SparkSession, root: str, records: DataFrame, provider: str = "local", model: str = "hashed-terms",
           dim: int = EMBEDDING_DIM, embed: Callable[[DataFrame, str], DataFrame] = hashed_embedding) -> None:
    """Embed records (collection, id, document, metadata) and store them.

    Every collection keeps the space it was first embedded with, beside its
    documents; records from another space are refused before anything is written.
    """
    embedded = cut_lineage(embed(records, "document"))
    base = read_base(spark, root)
    refused = space_outcomes(embedded, base, provider, model, dim).where("outcome is not null").orderBy("collection").first()
    if refused:
        raise ValueError(f"{refused.collection}: {refused.outcome}")
    rows = embedded.withColumns({"provider": F.lit(provider), "model": F.lit(model), "dim": F.lit(dim)})
    keys = ["collection", "id"]
    if base is not None:
        held = base.join(embedded.select("collection").distinct(), "collection", "left_semi")
        sizes = _sizes(embedded.select("collection").unionByName(held.select("collection")))
    else:
        held, sizes = rows.limit(0), _sizes(embedded)
    total = sizes.agg(F.coalesce(F.sum("slices"), F.lit(1))).first()[0]
    rows = upsert(held.repartition(total, *keys), rows.repartition(total, *keys))
    columns = [c for c in rows.columns if c != "collection"]
    sliced = rows.join(sizes, "collection", "left").withColumn(
        "_slice", F.pmod(F.xxhash64("id"), F.coalesce("slices", F.lit(1))))
    (sliced.repartition(total, "collection", "_slice").select(*columns, "collection").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(root))


def _sizes(rows: DataFrame) -> DataFrame:
    """(collection, slices): the parts each collection is dealt to."""
    return cut_lineage(rows.groupBy("collection").agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias("slices")))
