"""From logs to stored investigations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from logvigil.functions.skew import UNIT
from logvigil.operators.components import connected_components
from logvigil.operators.graph import (
    attack_clusters, edge_events, edges_of, graph_nodes, graph_summary,
)
from logvigil.operators.investigations import build_investigations
from logvigil.operators.knowledge import pattern_technique_table, techniques_of_patterns
from logvigil.operators.models import asked_for, parse_answers
from logvigil.operators.regulatory import classify
from logvigil.operators.reports import REPORT_COLUMNS, evidence_report, prompt_context, reports_or_fallback
from logvigil.operators.retrieval import (
    hashed_embedding, nearest, query_text, retrieval_result, retrieved_context,
)
from logvigil.operators.rules import detect_anomalies
from logvigil.operators.scoring import score_threats
from logvigil.operators.summary import threat_summary, top_events_list
from logvigil.session import cut_lineage

INV = "investigation_id"
NO_CONTEXT = (
    "struct<rag_available:boolean,retrieved_context:"
    "array<struct<source:string,id:string,content:string,relevance_score:double>>>"
)


def scored_events(events: DataFrame, forest: bool = False, zone: str = "UTC",
                  unit: int = UNIT) -> DataFrame:
    """Detection and scoring in one lazy plan."""
    return score_threats(detect_anomalies(events, forest=forest, zone=zone, unit=unit))


def graph_tables(scored: DataFrame, unit: int = UNIT) -> dict[str, DataFrame]:
    """Nodes, edges, clusters with members and event types, and the summary."""
    # nodes, traffic and clusters are each read by several of the tables below
    nodes, traffic = cut_lineage(graph_nodes(scored)), cut_lineage(edge_events(scored))
    edges = edges_of(traffic)
    components = cut_lineage(connected_components(edges, nodes))
    found = attack_clusters(nodes, components, traffic, unit)
    clusters = cut_lineage(found["clusters"])
    return {
        "nodes": nodes, "edges": edges, "components": components, "clusters": clusters,
        "cluster_members": found["members"],
        "cluster_event_types": found["event_types"],
        "graph_summary": graph_summary(scored, nodes, edges, clusters),
    }


def retrieve(queries: DataFrame, docs: DataFrame, k: int = 5,
             embed: Callable[[DataFrame, str], DataFrame] = hashed_embedding) -> DataFrame:
    """Context for each (query_id, query_used); ``docs`` carries embeddings."""
    asked = embed(queries, "query_used").select("query_id", "embedding")
    return retrieval_result(queries, retrieved_context(nearest(asked, docs, k)), docs)


def investigate(events: DataFrame, uploads: DataFrame, docs: DataFrame | None = None,
                generate: Callable[[DataFrame], DataFrame] | None = None, forest: bool = True,
                zone: str = "UTC", unit: int = UNIT) -> dict[str, DataFrame]:
    """All result tables for many investigations at once.

    ``events`` is a canonical log table with investigation_id and event_id;
    ``uploads`` has investigation_id, user_id, filename, upload_source and
    created_at.  ``docs`` is an embedded knowledge base; without it retrieval
    is unavailable.  ``generate`` turns the prompt table (investigation_id,
    prompt_context) into (investigation_id, raw_report), such as
    ``models.generate_answers`` with a model; without it, and for
    answers that never came or break the contract, the report is made from the evidence.
    """
    scored = cut_lineage(scored_events(events, forest, zone, unit))
    graph = graph_tables(scored, unit)
    summary_of_graph = cut_lineage(graph["graph_summary"])
    summary = cut_lineage(threat_summary(scored))
    flags = cut_lineage(classify(scored, summary_of_graph))
    top = cut_lineage(top_events_list(scored))

    queries = flags.join(top, INV, "left").select(
        F.col(INV).alias("query_id"),
        query_text(F.col("top_threats"), F.col("sa_patterns_matched"), F.col("popia_flags"),
                   F.col("cybercrimes_flags")).alias("query_used"),
    )
    if docs is None:
        context = queries.select(
            "query_id", "query_used", F.lit(False).alias("rag_available"),
            F.lit(None).cast(NO_CONTEXT)["retrieved_context"].alias("retrieved_context"),
        )
    else:
        context = retrieve(queries, docs)
    context = cut_lineage(context).withColumnRenamed("query_id", INV)

    evidence = (
        summary.join(summary_of_graph, INV)
        .withColumn("attack_clusters", F.col("attack_clusters_detected"))
        .join(flags, INV)
        .join(techniques_of_patterns(flags, pattern_technique_table(events.sparkSession)), INV)
        .join(context.select(INV, "rag_available", F.array_distinct(F.transform(
            F.coalesce("retrieved_context", F.array()), lambda e: e["source"])).alias("rag_sources")),
            INV)
    )
    reports = evidence_report(evidence)
    if generate is not None:
        parts = (
            summary.join(top, INV, "left").join(summary_of_graph, INV).join(flags, INV)
            .join(context, INV)
            .select(
                INV,
                F.struct("event_count", "anomaly_count", "high_threat_count", "max_threat_score",
                         "top_threats").alias("threat_summary"),
                F.struct("total_nodes", "total_edges", "suspicious_nodes",
                         "attack_clusters_detected").alias("graph_summary"),
                F.struct("popia_flags", "cybercrimes_flags", "sa_patterns_matched",
                         "compliance_summary", "reporting_obligations").alias("sa_result"),
                F.struct("rag_available", "retrieved_context").alias("rag_context"),
            )
        )
        # a model answer is costly and may differ when asked twice: keep the first
        raw = cut_lineage(asked_for(generate, prompt_context(parts)))
        parsed = parse_answers(raw.join(context.select(INV, "rag_available"), INV, "left"))
        reports = reports_or_fallback(parsed, reports)
    else:
        reports = reports.select(INV, *REPORT_COLUMNS, F.lit(None).cast("string").alias("report_error"))

    return {
        "investigations": build_investigations(uploads, summary, summary_of_graph, flags, reports),
        "events": scored, "top_events": top, "flags": flags, "summary": summary,
        "retrieval": context, "reports": reports, **graph,
    }
