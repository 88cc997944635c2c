"""Registered queries on stored investigations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logvigil.operators import investigations as store
from logvigil.operators.graph import graph_nodes
from logvigil.operators.summary import (
    recent_totals as newest_totals, threat_summary, top_events_list,
)
from logvigil.plans import oracle as sql
from logvigil.plans.adapter import load, telemetry_of
from logvigil.plans.checks_detection import INV, piped, scored, stamp
from logvigil.plans.investigate import investigate
from logvigil.session import cut_lineage, scratch_path
from logvigil.sources.sinks import text_report, to_json_rows
from logvigil.sources.store import CHILD_TABLES, InvestigationStore, write_investigations


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stored investigations, twenty owners."""
    return load(spark, sf_dir, "orders").selectExpr(
        "concat('inv-', o_orderkey) as investigation_id",
        "concat('user', o_custkey % 20) as user_id",
        "concat(o_orderpriority, '-', o_orderkey, '.csv') as filename",
        "'csv' as upload_source",
        "cast(o_orderdate as timestamp) as created_at",
        "cast(floor(o_totalprice) as bigint) as event_count",
        "cast(floor(o_totalprice) as bigint) div 2 as anomaly_count",
        "o_orderkey % 97 as high_threat_count",
        "o_custkey % 5 as attack_clusters",
        "if(o_orderstatus = 'F', concat('order ', o_orderkey), null) as incident_summary",
        "if(o_orderkey % 3 = 0, array('look', 'act'), cast(null as array<string>)) as incident_next_steps",
        "if(o_orderkey % 4 = 0, array('T1078', 'T1110'), array()) as mitre_techniques",
        "if(o_orderkey % 5 = 0, array('POPIA_PERSONAL_DATA'), array()) as popia_flags",
        "if(o_orderkey % 6 = 0, array('SAPS_REFERRAL', 'SARB_REPORTABLE'), array()) as cybercrimes_flags",
        "cast(array() as array<string>) as sa_patterns_matched",
        "if(o_orderkey % 7 = 0, array('KB'), array()) as rag_sources_used",
        "cast(null as timestamp) as regenerated_at",
    )


def _short(df: DataFrame) -> DataFrame:
    return df.select(INV, "user_id", "filename", stamp("created_at"), "event_count",
                     "high_threat_count", "attack_clusters")


def owned_page(spark, sf_dir):
    return _short(store.list_page(stored(spark, sf_dir), "user7", page=3, page_size=20,
                                  sort_by="high_threat_count"))


def owned_page_by_date(spark, sf_dir):
    return _short(store.list_page(stored(spark, sf_dir), "user3", descending=False))


def owned_page_after(spark, sf_dir):
    """I2 on the stored table: the page behind the last row of the page before, three pages deep."""
    keep = InvestigationStore(spark, scratch_path(spark, "store"))
    keep.write({"investigations": stored(spark, sf_dir)})
    last = None
    for _ in range(3):
        page = store.list_after(keep.read(), "user7", last, page_size=20)
        rows = page.select("created_at", INV).collect()
        if not rows:
            break
        final, last = page, tuple(rows[-1])
    return _short(final)


def page_totals(spark, sf_dir):
    totals = store.page_totals(stored(spark, sf_dir), "user7", page=2, page_size=20)
    return totals.select(*[F.col(c).cast("long").alias(c) for c in totals.columns])


def totals_by_owner(spark, sf_dir):
    return store.totals_by_owner(stored(spark, sf_dir))


def owned_detail(spark, sf_dir):
    table = stored(spark, sf_dir)
    children = load(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("inv-"), "l_orderkey").alias(INV), F.col("l_linenumber").alias("event_id")
    )
    return store.detail_children(table, children, "user7", "inv-30").select(INV, "event_id")


def after_delete(spark, sf_dir):
    """Every owner deletes investigations 0, 13, 26, ...; some belong to others."""
    table = stored(spark, sf_dir)
    requests = table.where(F.substring(INV, 5, 20).cast("long") % 13 == 0).select(
        F.when(F.col("high_threat_count") % 2 == 0, F.col("user_id")).otherwise(F.lit("stranger"))
        .alias("user_id"), INV)
    return store.without_all(table, requests).select(INV, "user_id")


def after_versioned_delete(spark, sf_dir):
    """I6 on the stored table: what stays replaces its folder."""
    keep = InvestigationStore(spark, scratch_path(spark, "store"))
    keep.write({"investigations": stored(spark, sf_dir)})
    keep.delete(keep.read().where((F.col("user_id") == "user7") & (F.col(INV) == "inv-30")))
    return keep.read().groupBy("user_id").agg(F.count(F.lit(1)).alias("investigations"))


def _store(spark: SparkSession, sf_dir: str) -> InvestigationStore:
    """Orders as investigations, their lines as events, the customers' nations as nodes; written twice."""
    keep = InvestigationStore(spark, scratch_path(spark, "store"))
    main = stored(spark, sf_dir).withColumn("compliance_summary", F.lit(""))
    events = load(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("inv-"), "l_orderkey").alias(INV), F.col("l_linenumber").alias("event_id"),
        F.col("l_returnflag").alias("event_type"))
    nodes = load(spark, sf_dir, "orders").select(
        F.concat(F.lit("inv-"), "o_orderkey").alias(INV), F.concat(F.lit("user:"), "o_custkey").alias("node_id"))
    tables = {"investigations": main, "events": events, "nodes": nodes}
    keep.write({name: table.limit(0) if name == "nodes" else table for name, table in tables.items()})
    keep.write(tables)
    return keep


def _counts(keep: InvestigationStore) -> DataFrame:
    out = None
    for name in ("investigations", "events", "nodes"):
        rows = keep.read(name).groupBy("user_id").agg(F.count(F.lit(1)).alias("rows")).withColumn("name", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def stored_twice(spark, sf_dir):
    """A second write of the same investigations replaces the first."""
    return _counts(_store(spark, sf_dir))


def stored_delete(spark, sf_dir):
    """Half of the requests come from strangers; children go with their investigation."""
    keep = _store(spark, sf_dir)
    number = F.substring(INV, 5, 20).cast("long")
    keep.delete(keep.read().where(number % 200 == 0).select(
        F.when(number % 400 == 0, F.col("user_id")).otherwise("stranger").alias("user_id"), INV))
    return _counts(keep)


def stored_regeneration(spark, sf_dir):
    """New reports are stored and read back."""
    keep = _store(spark, sf_dir)
    number = F.substring(INV, 5, 20).cast("long")
    reports = keep.read().where(number % 150 == 0).select(
        F.when(number % 300 == 0, F.col("user_id")).otherwise("stranger").alias("user_id"), INV,
        F.when(number % 900 == 0, "broken").alias("report_error"),
        F.concat(F.lit("new "), INV).alias("incident_summary"),
        F.array(F.lit("one")).alias("incident_next_steps"), F.array(F.lit("T1")).alias("mitre_techniques"),
        F.array().cast("array<string>").alias("rag_sources_used"))
    keep.regenerate(reports, F.lit("2026-01-01 00:00:00").cast("timestamp"))
    return keep.read().select(INV, "user_id", "incident_summary", piped("mitre_techniques"), stamp("regenerated_at"))


def orphaned_rows(spark, sf_dir):
    """Events of investigations that were not uploaded are reported, not lost in silence."""
    main = stored(spark, sf_dir).where(F.substring(INV, 5, 20).cast("long") % 3 == 0)
    events = load(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("inv-"), "l_orderkey").alias(INV), F.col("l_linenumber").alias("event_id"))
    rejects = write_investigations({"investigations": main, "events": events}, scratch_path(spark, "store"))
    return rejects.select(F.col("table").alias("name"), INV, "rows")


def filename_filter(spark, sf_dir):
    return store.filename_contains(stored(spark, sf_dir), " URGENT ").select(INV, "filename")


def recent_totals(spark, sf_dir):
    return newest_totals(store.owned(stored(spark, sf_dir), "user7"))


def incident_view(spark, sf_dir):
    view = store.incident_view(stored(spark, sf_dir))
    return view.select(INV, "incident_summary", piped("incident_next_steps"), piped("mitre_techniques"),
                       piped("popia_flags"), piped("cybercrimes_flags"), "attack_clusters",
                       "high_threat_count", "event_count", "created_at")


def text_reports(spark, sf_dir):
    return text_report(store.incident_view(stored(spark, sf_dir)))


def json_rows(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_id") % 3 == 0, F.lit("NaN").cast("double")).otherwise(F.floor("value").cast("double"))
        .alias("value"),
        F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("event_type"),
        F.struct(F.col("user_id").alias("user"),
                 F.array(F.lit(1.5), F.lit("NaN").cast("double")).alias("list")).alias("nested"),
    )
    return rows.select("event_id").join(
        to_json_rows(rows).withColumn("event_id", F.get_json_object("value", "$.event_id").cast("long")),
        "event_id",
    )


def after_regeneration(spark, sf_dir):
    """Sound new reports replace four fields, faulty ones and strangers change nothing."""
    table = stored(spark, sf_dir)
    number = F.substring(INV, 5, 20).cast("long")
    reports = table.where(number % 11 == 0).select(
        F.when(number % 2 == 0, F.col("user_id")).otherwise("stranger").alias("user_id"), INV,
        F.when(number % 3 == 0, "broken").alias("report_error"),
        F.concat(F.lit("new "), INV).alias("incident_summary"),
        F.array(F.lit("one")).alias("incident_next_steps"), F.array(F.lit("T1")).alias("mitre_techniques"),
        F.array().cast("array<string>").alias("rag_sources_used"),
    )
    at = F.lit("2026-01-01 00:00:00").cast("timestamp")
    return store.apply_regenerated(table, reports, at).select(
        INV, "incident_summary", piped("incident_next_steps"), piped("mitre_techniques"),
        piped("rag_sources_used"), stamp("regenerated_at"))


def regeneration_input(spark, sf_dir):
    """I10 from stored events and nodes."""
    events = cut_lineage(scored(spark, sf_dir))
    summary, nodes = threat_summary(events), graph_nodes(events)
    table = summary.select(
        INV, "event_count", "anomaly_count", "high_threat_count",
        F.create_map(F.lit("critical"), F.col("critical")).alias("threat_distribution"),
        *[F.lit(0).cast("long").alias(c) for c in ("attack_clusters", "graph_nodes", "graph_edges")],
        *[F.array().cast("array<string>").alias(c)
          for c in ("popia_flags", "cybercrimes_flags", "sa_patterns_matched")],
    )
    context = store.regeneration_input(table, top_events_list(events), summary, nodes)
    return context.select(
        INV, F.col("threat_summary.event_count").alias("event_count"),
        F.col("threat_summary.max_threat_score").alias("max_threat_score"),
        F.col("graph_summary.suspicious_nodes").alias("suspicious_nodes"),
        F.array_join(F.transform("threat_summary.top_threats",
                                 lambda t: t["threat_score"].cast("string")), "|").alias("top_scores"),
        F.array_join(F.transform("threat_summary.top_threats", lambda t: t["src_ip"]), "|").alias("top_sources"),
        F.col("rag_context.rag_available").alias("rag_available"),
    )


def uploads(events: DataFrame) -> DataFrame:
    return events.groupBy(INV).agg(F.max("timestamp").alias("created_at")).select(
        INV, F.lit("owner").alias("user_id"), F.concat(INV, F.lit(".csv")).alias("filename"),
        F.lit("csv").alias("upload_source"), "created_at",
    )


def investigations(spark, sf_dir):
    """Everything from logs to the stored table, read back."""
    events = telemetry_of(spark, sf_dir)
    tables = investigate(events, uploads(events), forest=False)
    root = scratch_path(spark, "store")
    write_investigations({k: tables[k] for k in ("investigations", *CHILD_TABLES)}, root)
    keep = InvestigationStore(spark, root)
    table = keep.read()
    for name in ("events", "nodes", "edges"):
        table = table.join(keep.read(name).groupBy(INV).agg(F.count(F.lit(1)).alias(f"stored_{name}")), INV)
    return table.select(
        INV, "user_id", "filename", "event_count", "anomaly_count", "high_threat_count",
        F.col("threat_distribution")["medium"].alias("medium"), "graph_nodes", "graph_edges",
        "stored_edges", "stored_events", "stored_nodes", "attack_clusters", "suspicious_nodes", piped("popia_flags"),
        piped("cybercrimes_flags"), piped("sa_patterns_matched"), "compliance_summary",
    )


_STORED = """
WITH stored AS (
  SELECT 'inv-' || o_orderkey AS investigation_id, o_orderkey AS k, 'user' || (o_custkey % 20) AS user_id,
         o_orderpriority || '-' || o_orderkey || '.csv' AS filename, o_orderdate AS created_at,
         CAST(floor(o_totalprice) AS BIGINT) AS event_count, o_orderkey % 97 AS high_threat_count,
         o_custkey % 5 AS attack_clusters,
         CASE WHEN o_orderstatus = 'F' THEN 'order ' || o_orderkey END AS incident_summary,
         CASE WHEN o_orderkey % 3 = 0 THEN 'look|act' ELSE '' END AS incident_next_steps,
         CASE WHEN o_orderkey % 4 = 0 THEN 'T1078|T1110' ELSE '' END AS mitre_techniques,
         CASE WHEN o_orderkey % 5 = 0 THEN 'POPIA_PERSONAL_DATA' ELSE '' END AS popia_flags,
         CASE WHEN o_orderkey % 6 = 0 THEN 'SAPS_REFERRAL|SARB_REPORTABLE' ELSE '' END AS cybercrimes_flags,
         CASE WHEN o_orderkey % 7 = 0 THEN 'KB' ELSE '' END AS rag_sources_used
  FROM orders)
"""
_SHORT = """SELECT investigation_id, user_id, filename, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at,
  event_count, high_threat_count, attack_clusters FROM stored"""
_ISO = """strftime(created_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(created_at) % 1000000 <> 0
  THEN strftime(created_at, '.%f') ELSE '' END || '+00:00'"""

_KEPT = """
    WITH kept AS (SELECT o_orderkey, 'user' || (o_custkey % 20) AS user_id FROM orders
                  WHERE {0}),
    named AS (SELECT user_id, 'investigations' AS name FROM kept
              UNION ALL SELECT user_id, 'nodes' FROM kept
              UNION ALL SELECT user_id, 'events' FROM kept JOIN lineitem ON l_orderkey = o_orderkey)
    SELECT user_id, name, count(*) AS rows FROM named GROUP BY ALL"""

CHECKS = {
    "stored_twice": (stored_twice, _KEPT.format("true")),
    "stored_delete": (stored_delete, _KEPT.format("o_orderkey % 400 <> 0")),
    "stored_regeneration": (stored_regeneration, """
        SELECT 'inv-' || o_orderkey AS investigation_id, 'user' || (o_custkey % 20) AS user_id,
               CASE WHEN fresh THEN 'new inv-' || o_orderkey
                    WHEN o_orderstatus = 'F' THEN 'order ' || o_orderkey END AS incident_summary,
               CASE WHEN fresh THEN 'T1' WHEN o_orderkey % 4 = 0 THEN 'T1078|T1110' ELSE '' END AS mitre_techniques,
               CASE WHEN fresh THEN '2026-01-01 00:00:00.000000' END AS regenerated_at
        FROM (SELECT *, o_orderkey % 300 = 0 AND o_orderkey % 900 <> 0 AS fresh FROM orders)"""),
    "orphaned_rows": (orphaned_rows, """
        SELECT 'events' AS name, 'inv-' || l_orderkey AS investigation_id, count(*) AS rows
        FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY l_orderkey"""),

    "owned_page": (owned_page, _STORED + _SHORT + """ WHERE user_id = 'user7'
        ORDER BY high_threat_count DESC, investigation_id LIMIT 20 OFFSET 40"""),
    "owned_page_by_date": (owned_page_by_date, _STORED + _SHORT + """ WHERE user_id = 'user3'
        ORDER BY stored.created_at, investigation_id LIMIT 10"""),
    "owned_page_after": (owned_page_after, _STORED + _SHORT + """ WHERE user_id = 'user7'
        ORDER BY stored.created_at DESC, investigation_id LIMIT 20 OFFSET 40"""),
    "page_totals": (page_totals, _STORED + """
        SELECT count(*) AS total, CAST(2 AS BIGINT) AS page, CAST(20 AS BIGINT) AS page_size,
               CAST(ceil(count(*) / 20) AS BIGINT) AS total_pages,
               CASE WHEN count(*) = 0 THEN 0 ELSE CAST(21 AS BIGINT) END AS first_row, least(40, count(*)) AS last_row
        FROM stored WHERE user_id = 'user7'"""),
    "totals_by_owner": (totals_by_owner, _STORED + """
        SELECT user_id, count(*) AS total, CAST(ceil(count(*) / 10) AS BIGINT) AS total_pages FROM stored GROUP BY ALL"""),
    "owned_detail": (owned_detail, _STORED + """
        SELECT 'inv-' || l_orderkey AS investigation_id, l_linenumber AS event_id FROM lineitem
        WHERE l_orderkey = 30 AND EXISTS (SELECT 1 FROM stored WHERE k = 30 AND user_id = 'user7')"""),
    "after_delete": (after_delete, _STORED + """
        SELECT investigation_id, user_id FROM stored WHERE NOT (k % 13 = 0 AND high_threat_count % 2 = 0)"""),
    "after_versioned_delete": (after_versioned_delete, _STORED + """
        SELECT user_id, count(*) AS investigations FROM stored
        WHERE NOT (user_id = 'user7' AND k = 30) GROUP BY ALL"""),
    "filename_contains": (filename_filter, _STORED + """
        SELECT investigation_id, filename FROM stored WHERE contains(lower(filename), 'urgent')"""),
    "recent_totals": (recent_totals, _STORED + """
        SELECT CAST(sum(event_count) AS BIGINT) AS event_count, CAST(sum(high_threat_count) AS BIGINT) AS high_threat_count,
               CAST(sum(attack_clusters) AS BIGINT) AS attack_clusters
        FROM (SELECT * FROM stored WHERE user_id = 'user7' ORDER BY created_at DESC, investigation_id LIMIT 5)"""),
    "incident_view": (incident_view, _STORED + f"""
        SELECT investigation_id, coalesce(incident_summary, '') AS incident_summary, incident_next_steps,
               mitre_techniques, popia_flags, cybercrimes_flags, attack_clusters, high_threat_count, event_count,
               {_ISO} AS created_at FROM stored"""),
    "text_reports": (text_reports, _STORED + f"""
        SELECT investigation_id, array_to_string(['INVESTIGATION SUMMARY SHEET', '', 'Investigation ID: ' || investigation_id,
          'Created: ' || {_ISO}, 'Events: ' || event_count, 'High threats: ' || high_threat_count,
          'Attack clusters: ' || attack_clusters, '', 'WHAT HAPPENED',
          coalesce(incident_summary, '(no summary)'), '', 'TO DO',
          CASE WHEN incident_next_steps = '' THEN '(none)' ELSE '1. look' || chr(10) || '2. act' END, '',
          'TECHNIQUES',
          CASE WHEN mitre_techniques = '' THEN '(none)' ELSE '- T1078' || chr(10) || '- T1110' END, '',
          'FLAGS',
          'POPIA flags: ' || coalesce(nullif(popia_flags, ''), 'None'),
          'Cybercrimes Act flags: ' || coalesce(nullif(replace(cybercrimes_flags, '|', ', '), ''), 'None'),
          'SA patterns matched: None', '', 'KNOWLEDGE USED',
          CASE WHEN rag_sources_used = '' THEN '(none)' ELSE '- KB' END], chr(10)) AS report
        FROM stored"""),
    "json_rows": (json_rows, """
        SELECT event_id, '{"event_id":' || event_id || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S')
          || CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN strftime(ts, '.%f') ELSE '' END || '+00:00","value":'
          || CASE WHEN event_id % 3 = 0 THEN 'null' ELSE CAST(floor(value) AS VARCHAR) END || ',"event_type":'
          || CASE WHEN event_id % 5 <> 0 THEN '"' || event_type || '"' ELSE 'null' END
          || ',"nested":{"user":' || user_id || ',"list":[1.5,null]}}' AS value FROM events"""),
    "after_regeneration": (after_regeneration, _STORED + """,
        n AS (SELECT *, k % 11 = 0 AND k % 2 = 0 AND k % 3 <> 0 AS renewed FROM stored)
        SELECT investigation_id, CASE WHEN renewed THEN 'new ' || investigation_id ELSE incident_summary END AS incident_summary,
               CASE WHEN renewed THEN 'one' WHEN k % 3 = 0 THEN incident_next_steps END AS incident_next_steps,
               CASE WHEN renewed THEN 'T1' ELSE mitre_techniques END AS mitre_techniques,
               CASE WHEN renewed THEN '' ELSE rag_sources_used END AS rag_sources_used,
               CASE WHEN renewed THEN '2026-01-01 00:00:00.000000' END AS regenerated_at FROM n"""),
    "regeneration_input": (regeneration_input, sql.chain(sql.GRAPH, sql.SUMMARY, sql.TOP) + """
        SELECT s.investigation_id, s.event_count, s.max_threat_score, n.suspicious_nodes, t.top_scores, t.top_sources,
               false AS rag_available
        FROM summary s
        JOIN (SELECT investigation_id, count(*) FILTER (is_suspicious) AS suspicious_nodes FROM nodes GROUP BY ALL) n
          USING (investigation_id)
        JOIN (SELECT investigation_id, string_agg(CAST(threat_score AS VARCHAR), '|' ORDER BY position) AS top_scores,
                     string_agg(src_ip, '|' ORDER BY position) AS top_sources FROM top_events GROUP BY ALL) t
          USING (investigation_id)"""),
    "investigations": (investigations, sql.chain(
        sql.CLUSTERS, sql.SUMMARY, sql.flags(sql.CLUSTER_COUNT), recursive=True) + """
        SELECT s.investigation_id, 'owner' AS user_id, s.investigation_id || '.csv' AS filename, s.event_count,
               s.anomaly_count, s.high_threat_count, s.medium, g.total_nodes AS graph_nodes,
               g.total_edges AS graph_edges, g.total_edges AS stored_edges, s.event_count AS stored_events,
               g.total_nodes AS stored_nodes,
               g.attack_clusters_detected AS attack_clusters, g.suspicious_nodes, l.popia_flags,
               l.cybercrimes_flags, l.sa_patterns_matched, l.compliance_summary
        FROM summary s JOIN graph_summary g USING (investigation_id) JOIN listed l USING (investigation_id)"""),
}
