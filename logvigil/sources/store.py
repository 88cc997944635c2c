"""Stored investigations (S8, I6, I11): plain Parquet, in folders by owner and bucket.

Every table below the root is partitioned by user_id and by a bucket of the investigation's
hash, the same for the investigation and all its children, so the number of folders is
bounded by owners times ``BUCKETS``, and a request for one investigation reads one folder a table.

Writes, deletes and new reports are set operations.  The requested rows name the folders they
touch; what stays of these and what is new is written in one job a table, and Spark's
dynamic partition overwrite puts it in place of exactly these folders.  Running the same
change twice gives the same rows.  Each rewritten folder holds one placeholder row
without investigation_id, so a folder whose rows are all gone is overwritten too; readers
pass over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logvigil.functions.skew import balanced_join
from logvigil.operators.investigations import apply_regenerated
from logvigil.session import cut_lineage

INV = "investigation_id"
OWNER = ["user_id", INV]
FOLDER = ["user_id", "bucket"]
MAIN = "investigations"
#: Folders an owner has in a table, at most.
BUCKETS = 16

# child table -> columns that name a row within its investigation
CHILD_TABLES = {
    "events": ["event_id"],
    "nodes": ["node_id"],
    "edges": ["source", "target"],
    "clusters": ["cluster_id"],
    "cluster_members": ["node_id"],
    "cluster_event_types": ["cluster_id", "event_type"],
}


def bucket_of(investigation: Column) -> Column:
    return F.pmod(F.xxhash64(investigation), F.lit(BUCKETS)).cast("int")


class InvestigationStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def exists(self, name: str = MAIN) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def _stored(self, name: str) -> DataFrame:
        """A table with its placeholders and bucket; owners keep their text, whatever it looks like."""
        if not self.exists(name):
            raise ValueError(f"There is no table {name} below {self.root}")
        inference = "spark.sql.sources.partitionColumnTypeInference.enabled"
        before = self.spark.conf.get(inference)
        self.spark.conf.set(inference, "false")
        try:
            stored = self.spark.read.parquet(f"{self.root}/{name}")
        finally:
            self.spark.conf.set(inference, before)
        return stored.withColumn("bucket", F.col("bucket").cast("int"))

    def read(self, name: str = MAIN) -> DataFrame:
        """A stored table, with no rows if everything in it was deleted."""
        return self._stored(name).where(F.col(INV).isNotNull()).drop("bucket")

    def detail(self, user_id: str, investigation_id: str, name: str = MAIN) -> DataFrame:
        """The rows of one owned investigation, read from its folder alone."""
        rows = self._stored(name).where(
            (F.col("user_id") == user_id) & (F.col("bucket") == bucket_of(F.lit(investigation_id))))
        return rows.where(F.col(INV) == investigation_id).drop("bucket")

    def _rewrite(self, name: str, touched: DataFrame, gone: DataFrame, new: DataFrame | None = None) -> None:
        """Put what is stored without ``gone``, and ``new``, into the folders ``touched``.

        ``touched`` has (user_id, bucket), ``gone`` (user_id, investigation_id), both distinct.
        Where nothing is new the rows stay in the files they are read from, without a shuffle.
        """
        rows = None
        if self.exists(name):
            rows = (
                self._stored(name).where(F.col(INV).isNotNull())
                .join(touched, FOLDER, "left_semi").join(gone, OWNER, "left_anti")
            )
        if new is not None:
            placed = new.withColumn("bucket", bucket_of(F.col(INV)))
            rows = placed if rows is None else rows.unionByName(placed, allowMissingColumns=True)
        columns = [c for c in rows.columns if c not in FOLDER]
        empty = touched.select(
            *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in columns], *FOLDER)
        dealt = rows.select(*[f"`{c}`" for c in columns], *FOLDER)
        if new is None:
            dealt = dealt.unionByName(empty.repartition(self.spark.sparkContext.defaultParallelism))
        else:
            # few files per folder; AQE splits one that is too large for one task
            dealt = dealt.unionByName(empty).hint("rebalance", *FOLDER)
        if "created_at" in columns:
            dealt = dealt.sortWithinPartitions(*FOLDER, "created_at")
        (dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*FOLDER).parquet(f"{self.root}/{name}"))

    def write(self, tables: dict[str, DataFrame]) -> DataFrame:
        """Store investigations and their child tables; returns the rows left out.

        ``tables`` has investigations and any of the child tables.  Investigations that are
        stored already are replaced with all their children.  Children of an
        investigation that is not among them are not stored but counted:
        (table, investigation_id, rows).  The children go first, so an
        investigation that can be listed is complete.
        """
        main = tables[MAIN]
        owner = cut_lineage(main.select(*OWNER).distinct())
        touched = cut_lineage(owner.select("user_id", bucket_of(F.col(INV)).alias("bucket")).distinct())
        rejects = self.spark.createDataFrame([], "table string, investigation_id string, rows long")
        for name, row_id in CHILD_TABLES.items():
            if name in tables:
                child = tables[name].drop("user_id")
                sizes = cut_lineage(child.groupBy(INV).agg(F.count(F.lit(1)).alias("rows")))
                owned = balanced_join(child, owner, [INV], weights=sizes, weight="rows", row_id=row_id, how="inner")
                self._rewrite(name, touched, owner, owned)
                rejects = rejects.unionByName(
                    sizes.join(owner, INV, "left_anti").select(F.lit(name).alias("table"), INV, "rows"))
            elif self.exists(name):
                self._rewrite(name, touched, owner)
        self._rewrite(MAIN, touched, owner, main)
        return rejects

    def delete(self, requests: DataFrame) -> None:
        """Remove owned investigations with all their children.

        ``requests`` has user_id and investigation_id; a pair that does not match
        a stored owner removes nothing.  The investigations go first, so they are
        no longer listed when their children go.
        """
        asked = requests.select(*OWNER).distinct()
        held = cut_lineage(self.read().select(*OWNER).join(asked, OWNER, "left_semi"))
        touched = held.select("user_id", bucket_of(F.col(INV)).alias("bucket")).distinct()
        for name in (MAIN, *CHILD_TABLES):
            if self.exists(name):
                self._rewrite(name, touched, held)

    def regenerate(self, reports: DataFrame, at: Column) -> None:
        """Put new reports on their owner's investigations, and store those anew.

        ``reports`` has user_id, investigation_id, report_error and the report
        columns; faulty reports and strangers change nothing.
        """
        sound = reports.where(F.col("report_error").isNull())
        mine = self.read().join(sound.select(*OWNER).distinct(), OWNER, "left_semi")
        # written once: it names the rows to replace and holds their new form
        new = cut_lineage(apply_regenerated(mine, sound, at))
        touched = new.select("user_id", bucket_of(F.col(INV)).alias("bucket")).distinct()
        self._rewrite(MAIN, touched, new.select(*OWNER), new)


def write_investigations(tables: dict[str, DataFrame], root: str) -> DataFrame:
    """S8 in one call; returns the child rows that belong to no investigation, counted."""
    return InvestigationStore(tables[MAIN].sparkSession, root).write(tables)
