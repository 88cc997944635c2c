"""Entity graph of scored events (G1..G5, G7..G12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logvigil.functions.skew import UNIT, balanced_join
from logvigil.functions.text import blank_to_null, level_name, level_rank
from logvigil.operators.ranking import number_rows

INV = "investigation_id"
ENTITIES = ("src_ip", "dst_ip", "user_account", "device_id")
CLUSTER_MIN_SUSPICIOUS = 3


def _entity_id(role: str) -> Column:
    """Both address roles share one node; accounts and devices keep their own names."""
    prefix = "ip:" if role in ("src_ip", "dst_ip") else f"{role}:"
    return F.concat(F.lit(prefix), blank_to_null(F.col(role)))


def _with_all_roles(scored: DataFrame) -> DataFrame:
    """Logs without accounts or devices simply have no such nodes."""
    missing = [c for c in ENTITIES if c not in scored.columns]
    return scored.withColumns({c: F.lit(None).cast("string") for c in missing}) if missing else scored


def entities(scored: DataFrame) -> DataFrame:
    """G1: one row per entity an event mentions; blanks are skipped."""
    roles = [F.struct(F.lit(r).alias("role"), _entity_id(r).alias("node_id")) for r in ENTITIES]
    return (
        _with_all_roles(scored)
        .select(
            INV,
            F.coalesce("threat_score", F.lit(0)).alias("score"),
            level_rank(F.col("threat_level")).alias("rank"),
            F.explode(F.array(*roles)).alias("e"),
        )
        .select(INV, "e.role", "e.node_id", "score", "rank")
        .where(F.col("node_id").isNotNull())
    )


def graph_nodes(scored: DataFrame) -> DataFrame:
    """Events, highest score and level, suspicion and type of each node."""
    # within a node the roles are either the two address roles, the source first, or one single role;
    # as numbers, so that the nodes are hashed in each task and not sorted
    roles = F.array(*[F.lit(r) for r in ENTITIES])
    return (
        entities(scored)
        .withColumn("role", F.array_position(roles, F.col("role")).cast("int"))
        .groupBy(INV, "node_id")
        .agg(
            F.element_at(roles, F.min("role")).alias("type"),
            (F.max("rank") >= 3).alias("is_suspicious"),
            F.greatest(F.max("score"), F.lit(0)).alias("max_threat_score"),
            level_name(F.max("rank")).alias("max_threat_level"),
            F.count(F.lit(1)).alias("event_count"),
        )
    )


def edge_events(scored: DataFrame) -> DataFrame:
    """Traffic per source, target and event type; the edge tables build on it."""
    return (
        scored.select(
            INV,
            _entity_id("src_ip").alias("source"),
            _entity_id("dst_ip").alias("target"),
            blank_to_null(F.col("event_type")).alias("event_type"),
            F.coalesce("bytes_transferred", F.lit(0.0)).alias("bytes"),
            F.coalesce("threat_score", F.lit(0)).alias("score"),
        )
        .where(F.col("source").isNotNull() & F.col("target").isNotNull())
        .groupBy(INV, "source", "target", "event_type")
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.sum("bytes").alias("bytes"),
            F.max("score").alias("score"),
        )
    )


def edges_of(traffic: DataFrame) -> DataFrame:
    """Totals of each directed address pair and its commonest event type.

    ``traffic`` counts per type, so a pair keeps one best type, however many
    types it shows.  Ties go to the smallest name.
    """
    best = F.min(
        F.when(F.col("event_type").isNotNull(), F.struct(-F.col("events"), F.col("event_type")))
    )
    return traffic.groupBy(INV, "source", "target").agg(
        F.sum("events").alias("event_count"),
        F.sum("bytes").alias("total_bytes"),
        F.greatest(F.max("score"), F.lit(0)).alias("max_threat_score"),
        F.coalesce(best["event_type"], F.lit("")).alias("dominant_event_type"),
    )


def graph_edges(scored: DataFrame) -> DataFrame:
    """G4, G5 from scored events."""
    return edges_of(edge_events(scored))


def attack_clusters(nodes: DataFrame, components: DataFrame, traffic: DataFrame,
                    unit: int = UNIT) -> dict[str, DataFrame]:
    """G7..G9: components with three or more suspicious nodes.

    ``traffic`` is the output of ``edge_events``.  Returns the tables
    ``clusters`` (one row each, without arrays), ``members`` (its nodes) and
    ``event_types``: a cluster may hold a large share of all nodes, so its
    members stay rows.
    """
    size = components.groupBy(INV, "component").agg(F.count(F.lit(1)).alias("members"))
    in_component = components.join(nodes, [INV, "node_id"])
    found = (
        in_component.groupBy(INV, "component")
        .agg(
            F.count_if("is_suspicious").alias("suspicious_nodes"),
            F.max("max_threat_score").alias("max_threat_score"),
            level_name(F.max(level_rank(F.col("max_threat_level")))).alias("dominant_threat_level"),
            F.count(F.lit(1)).alias("node_count"),
        )
        .where(F.col("suspicious_nodes") >= CLUSTER_MIN_SUSPICIOUS)
    )
    # the component is named after its smallest node, which is the cluster's first node
    order = [F.desc("max_threat_score"), F.desc("suspicious_nodes"), F.asc("component")]
    ranked = number_rows(found, [INV], order, "position").withColumn(
        "cluster_id", F.format_string("CLUSTER-%03d", F.col("position"))
    )
    label = ranked.select(INV, "component", "cluster_id")
    members = balanced_join(
        components, label, [INV, "component"], weights=size, weight="members",
        row_id=["node_id"], how="inner", unit=unit,
    ).select(INV, "cluster_id", "component", "node_id")

    # an edge lies in the component of its source
    per_source = traffic.groupBy(INV, "source").agg(F.count(F.lit(1)).alias("edges"))
    inside = balanced_join(
        traffic, members.withColumnRenamed("node_id", "source"), [INV, "source"],
        weights=per_source, weight="edges", row_id=["target", "event_type"], how="inner", unit=unit,
    )
    totals = (
        inside.groupBy(INV, "cluster_id", "source", "target").agg(F.sum("bytes").alias("bytes"))
        .groupBy(INV, "cluster_id")
        .agg(F.count(F.lit(1)).alias("edge_count"), F.sum("bytes").alias("total_bytes"))
    )
    clusters = ranked.join(totals, [INV, "cluster_id"]).select(
        INV, "cluster_id", "position", F.col("component").alias("first_node"), "node_count",
        "suspicious_nodes", "edge_count", "total_bytes", "max_threat_score",
        "dominant_threat_level",
    )
    event_types = (
        inside.where(F.col("event_type").isNotNull())
        .select(INV, "cluster_id", "event_type").distinct()
    )
    return {
        "clusters": clusters,
        "members": members.select(INV, "cluster_id", "node_id"),
        "event_types": event_types,
    }


def graph_summary(investigations: DataFrame, nodes: DataFrame, edges: DataFrame,
                  clusters: DataFrame | None = None) -> DataFrame:
    """Totals per investigation; zeros where there is no graph."""
    by_node = nodes.groupBy(INV).agg(
        F.count(F.lit(1)).alias("total_nodes"),
        F.count_if("is_suspicious").alias("suspicious_nodes"),
        F.max("max_threat_score").alias("max_threat_score_in_graph"),
    )
    by_edge = edges.groupBy(INV).agg(F.count(F.lit(1)).alias("total_edges"))
    out = (
        investigations.select(INV).distinct().join(by_node, INV, "left").join(by_edge, INV, "left")
    )
    if clusters is None:
        out = out.withColumn("attack_clusters_detected", F.lit(None).cast("long"))
    else:
        by_cluster = clusters.groupBy(INV).agg(F.count(F.lit(1)).alias("attack_clusters_detected"))
        out = out.join(by_cluster, INV, "left")
    counts = ["total_nodes", "total_edges", "suspicious_nodes", "attack_clusters_detected",
              "max_threat_score_in_graph"]
    return out.select(INV, *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def incident_edges(edges: DataFrame, node_id: str) -> DataFrame:
    """Edges that start or end at one node."""
    return edges.where((F.col("source") == node_id) | (F.col("target") == node_id))


def incident_edges_of(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """G11 for a table of nodes: each edge once per chosen end, with that node."""
    ends = edges.withColumn(
        "node_id", F.explode(F.array_distinct(F.array("source", "target")))
    )
    degree = ends.groupBy(INV, "node_id").agg(F.count(F.lit(1)).alias("_edges"))
    return balanced_join(ends, chosen.select(INV, "node_id").distinct(), [INV, "node_id"],
                         weights=degree, weight="_edges", row_id=["source", "target"],
                         how="left_semi")


def display_value(node_id: Column) -> Column:
    """The part after the first colon."""
    return F.when(F.coalesce(node_id, F.lit("")) == "", "Unknown").otherwise(
        F.substring(node_id, F.instr(node_id, ":") + 1, F.length(node_id))
    )
