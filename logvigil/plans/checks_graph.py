"""Registered queries on the entity graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from logvigil.operators import graph, regulatory
from logvigil.operators.components import connected_components as find_components
from logvigil.plans import oracle as sql
from logvigil.plans.checks_detection import INV, piped, scored
from logvigil.plans.investigate import graph_tables
from logvigil.session import cut_lineage


def entity_mentions(spark, sf_dir):
    return graph.entities(scored(spark, sf_dir)).groupBy(INV, "role", "node_id").agg(
        F.count(F.lit(1)).alias("mentions"), F.max("score").alias("score")
    )


def graph_nodes(spark, sf_dir):
    return graph.graph_nodes(scored(spark, sf_dir))


def graph_edges(spark, sf_dir):
    return graph.graph_edges(scored(spark, sf_dir))


def _tables(spark, sf_dir):
    """Scored events are read by every graph table, so they are written once."""
    return graph_tables(cut_lineage(scored(spark, sf_dir)))


def connected_components(spark, sf_dir):
    events = cut_lineage(scored(spark, sf_dir))
    return find_components(graph.graph_edges(events), graph.graph_nodes(events))


def attack_clusters(spark, sf_dir):
    return _tables(spark, sf_dir)["clusters"]


def cluster_members(spark, sf_dir):
    return _tables(spark, sf_dir)["cluster_members"]


def cluster_event_types(spark, sf_dir):
    return _tables(spark, sf_dir)["cluster_event_types"]


def graph_summary(spark, sf_dir):
    return _tables(spark, sf_dir)["graph_summary"]


def incident_edges(spark, sf_dir):
    """Edges at the nodes with the highest score of all."""
    events = cut_lineage(scored(spark, sf_dir))
    chosen = graph.graph_nodes(events).where(F.col("max_threat_score") == 100)
    return graph.incident_edges_of(graph.graph_edges(events), chosen).select(
        INV, "node_id", "source", "target", "event_count", "total_bytes"
    )


def node_display(spark, sf_dir):
    nodes = graph.graph_nodes(scored(spark, sf_dir))
    return nodes.select(INV, "node_id", graph.display_value(F.col("node_id")).alias("display"))


def referral_flags(spark, sf_dir):
    """C6 needs the number of clusters."""
    events = cut_lineage(scored(spark, sf_dir))
    found = graph_tables(events)["graph_summary"]
    return regulatory.classify(events, found).select(INV, piped("cybercrimes_flags"), "compliance_summary")


_GRAPH = sql.chain(sql.GRAPH)
_CLUSTERS = sql.chain(sql.CLUSTERS, recursive=True)

CHECKS = {
    "entity_mentions": (entity_mentions, _GRAPH + """
        SELECT investigation_id, role, node_id, count(*) AS mentions, max(threat_score) AS score
        FROM mentions GROUP BY ALL"""),
    "graph_nodes": (graph_nodes, _GRAPH + " SELECT * FROM nodes"),
    "graph_edges": (graph_edges, _GRAPH + " SELECT * FROM edges"),
    "connected_components": (connected_components, _CLUSTERS + " SELECT * FROM components"),
    "attack_clusters": (attack_clusters, _CLUSTERS + " SELECT * FROM clusters"),
    "cluster_members": (cluster_members, _CLUSTERS + " SELECT * FROM cluster_members"),
    "cluster_event_types": (cluster_event_types, _CLUSTERS + """
        SELECT DISTINCT investigation_id, cluster_id, event_type FROM inside"""),
    "graph_summary": (graph_summary, _CLUSTERS + " SELECT * FROM graph_summary"),
    "incident_edges": (incident_edges, _GRAPH + """
        SELECT DISTINCT e.investigation_id, n.node_id, e.source, e.target, e.event_count, e.total_bytes
        FROM edges e JOIN nodes n ON n.investigation_id = e.investigation_id
             AND n.node_id IN (e.source, e.target) AND n.max_threat_score = 100"""),
    "node_display": (node_display, _GRAPH + """
        SELECT investigation_id, node_id, substr(node_id, instr(node_id, ':') + 1) AS display FROM nodes"""),
    "referral_flags": (referral_flags, sql.chain(sql.CLUSTERS, sql.flags(sql.CLUSTER_COUNT), recursive=True)
                       + " SELECT investigation_id, cybercrimes_flags, compliance_summary FROM listed"),
}
