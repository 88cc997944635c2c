"""Connected components of links between integer nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logvigil.llm.stages import Stages


def components(links: DataFrame, stages: Stages) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node reachable.

    Every round each node takes the smallest label around it, and then that
    label's own label, so the distance covered doubles.  Rounds go on until no
    label changes.  A node with very many links is pre-aggregated in each task;
    joins on it are split by adaptive execution.
    """
    both = stages.keep(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .where("a <> b").distinct(), "links")
    labels = stages.keep(
        both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("component")), "labels")
    while True:
        around = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("around"))
        )
        nearer = stages.keep(
            labels.join(around, "node")
            .select("node", F.least("component", "around").alias("component"),
                    (F.col("around") < F.col("component")).alias("moved")), "labels")
        moved = not nearer.where("moved").isEmpty()
        if moved:
            # a label is a node of the same component, so its own label is one too
            further = nearer.select(F.col("node").alias("component"), F.col("component").alias("next"))
            jumped = stages.keep(
                nearer.select("node", "component").join(further, "component")
                .select("node", F.least("component", "next").alias("component")), "labels")
            stages.drop(labels, nearer)
            labels = jumped
        else:
            stages.drop(nearer, both)
            return labels
