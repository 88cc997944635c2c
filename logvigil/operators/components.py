"""Connected components of the address graph.

Alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014): the number of rounds grows with the
logarithm of the graph, also on long chains, where plain label passing needs as
many rounds as the chain is long.  Each round is written to the shared folder.
Neighbours are pre-aggregated in each task; in the joins a node with very many links is cut in
slices, each with its own copy of the node's minimum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logvigil.functions.skew import UNIT, balanced_join
from logvigil.session import cut_lineage

INV = "investigation_id"


def _around(rows: DataFrame) -> DataFrame:
    """(investigation, u, m, degree): the smallest of a node and its neighbours ``v``, and their number."""
    return rows.groupBy(INV, "u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("degree"))


def _with_smallest(rows: DataFrame, around: DataFrame, unit: int, small: bool) -> DataFrame:
    """Add ``m`` to rows (u, v): nodes with more than ``unit`` rows are cut in slices that each get their own
    copy of the node's minimum.  A ``small`` table has no such nodes and is joined as it is."""
    if small:
        return rows.join(around.select(INV, "u", "m"), [INV, "u"])
    return balanced_join(rows, around, [INV, "u"], weights=around, weight="degree", row_id=["v"], how="inner", unit=unit)


def _large_star(pairs: DataFrame, unit: int, small: bool) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    back = pairs.select(INV, F.col("v").alias("u"), F.col("u").alias("v"))
    around = _around(pairs.unionByName(back))
    joined = _with_smallest(back, around if small else cut_lineage(around), unit, small)
    return joined.select(INV, F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(pairs: DataFrame, unit: int, small: bool) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    if not small:
        pairs = cut_lineage(pairs)
    around = _around(pairs) if small else cut_lineage(_around(pairs))
    joined = _with_smallest(pairs, around, unit, small)
    return (
        joined.where(F.col("v") != F.col("m"))
        .select(INV, F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(around.select(INV, "u", F.col("m").alias("v")))
        .distinct()
    )


def _settled(pairs: DataFrame) -> bool:
    """Whether the links are separate stars.

    The steps keep what is connected connected.  So once every node has one
    link at most to a smaller one, and no such node is itself linked to, each
    star is a whole component around its smallest node.
    """
    ends = pairs.select(INV, F.explode(F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(False).alias("centre")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(True).alias("centre")),
    )).alias("e")).select(INV, "e.*")
    per_node = ends.groupBy(INV, "node").agg(
        F.sum("up").alias("up"), F.bool_or("centre").alias("centre")
    )
    return per_node.where((F.col("up") > 1) | ((F.col("up") > 0) & F.col("centre"))).isEmpty()


def connected_components(edges: DataFrame, nodes: DataFrame, unit: int = UNIT) -> DataFrame:
    """(investigation_id, node_id, component) for each address node.

    ``edges`` has source and target; ``nodes`` has node_id.  The component is
    the smallest node id in it.  Accounts and devices have no edges, so only
    address nodes are returned.
    """
    pairs = cut_lineage(
        edges.where(F.col("source") != F.col("target"))
        .select(INV, F.greatest("source", "target").alias("u"), F.least("source", "target").alias("v"))
        .distinct()
    )
    # every step keeps or lowers the number of links but for a link a node; a node's rows are fewer
    small = 2 * pairs.count() <= unit
    while not _settled(pairs):
        pairs = cut_lineage(_small_star(_large_star(pairs, unit, small), unit, small))
    stars = pairs.select(INV, F.col("u").alias("node_id"), F.col("v").alias("component"))
    return (
        nodes.where(F.col("node_id").startswith("ip:")).select(INV, "node_id")
        .join(stars, [INV, "node_id"], "left")
        .withColumn("component", F.coalesce("component", "node_id"))
    )
