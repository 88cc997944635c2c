"""Queries over stored investigations (I1..I11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logvigil.operators.summary import LEVEL_COLUMNS, distribution_map

INV = "investigation_id"
SORT_KEYS = ("created_at", "high_threat_count", "event_count", "attack_clusters")
MAX_PAGE = 50
STRINGS = "array<string>"
REGENERATED = ("incident_summary", "incident_next_steps", "mitre_techniques", "rag_sources_used")


def build_investigations(uploads: DataFrame, summary: DataFrame, graph: DataFrame,
                         flags: DataFrame, reports: DataFrame) -> DataFrame:
    """One row per uploaded investigation from the outputs of all stages.

    ``uploads`` has investigation_id, user_id, filename, upload_source and
    created_at.  The joins are one to one on the investigation.
    """
    none = F.array().cast(STRINGS)
    counted = summary.select(
        INV, "event_count", "anomaly_count", "high_threat_count", "max_threat_score",
        distribution_map().alias("threat_distribution"),
    )
    drawn = graph.select(
        INV, F.col("total_nodes").alias("graph_nodes"), F.col("total_edges").alias("graph_edges"),
        F.col("attack_clusters_detected").alias("attack_clusters"), "suspicious_nodes",
    )
    flagged = flags.select(INV, "popia_flags", "cybercrimes_flags", "sa_patterns_matched",
                           "compliance_summary", "reporting_obligations")
    written = reports.select(INV, *REGENERATED)
    out = uploads
    for part in (counted, drawn, flagged, written):
        out = out.join(part, INV, "left")
    numbers = ("event_count", "anomaly_count", "high_threat_count", "max_threat_score",
               "graph_nodes", "graph_edges", "attack_clusters", "suspicious_nodes")
    lists = ("popia_flags", "cybercrimes_flags", "sa_patterns_matched", "incident_next_steps",
             "mitre_techniques", "rag_sources_used", "reporting_obligations")
    zeros = F.create_map(*[x for n in LEVEL_COLUMNS for x in (F.lit(n), F.lit(0).cast("long"))])
    return out.withColumns({
        **{c: F.coalesce(c, F.lit(0)) for c in numbers},
        **{c: F.coalesce(c, none) for c in lists},
        "threat_distribution": F.coalesce("threat_distribution", zeros),
        "incident_summary": F.coalesce("incident_summary", F.lit("")),
        "regenerated_at": F.lit(None).cast("timestamp"),
    })


def owned(store: DataFrame, user_id: str) -> DataFrame:
    """The owner filter; it prunes the partitions of a stored table."""
    return store.where(F.col("user_id") == user_id)


def _check_page(page: int, page_size: int) -> None:
    if page < 1 or not 1 <= page_size <= MAX_PAGE:
        raise ValueError(f"page must be at least 1 and page_size between 1 and {MAX_PAGE}")


def list_page(store: DataFrame, user_id: str, page: int = 1, page_size: int = 10,
              sort_by: str = "created_at", descending: bool = True) -> DataFrame:
    """One page of an owner's investigations.

    Events and graph live in tables of their own, so a page reads none of them.
    """
    _check_page(page, page_size)
    if sort_by not in SORT_KEYS:
        raise ValueError(f"sort_by must be one of {', '.join(SORT_KEYS)}")
    order = F.desc(sort_by) if descending else F.asc(sort_by)
    return (
        owned(store, user_id).orderBy(order, INV).offset((page - 1) * page_size).limit(page_size)
    )


def list_after(store: DataFrame, user_id: str, after: tuple | None = None, page_size: int = 10,
               sort_by: str = "created_at", descending: bool = True) -> DataFrame:
    """I2 for deep pages: the page behind the last (sort value, id) of the page before.

    Costs the same wherever the page lies: rows up to the last one are filtered in the scan, and stored
    files are sorted by date, so whole row groups are passed over; the rest is a top-k.  Missing
    sort values come last when descending, first otherwise, as in ``list_page``.
    """
    _check_page(1, page_size)
    if sort_by not in SORT_KEYS:
        raise ValueError(f"sort_by must be one of {', '.join(SORT_KEYS)}")
    rows, key = owned(store, user_id), F.col(sort_by)
    if after is not None:
        value, last_id = after
        if value is None:
            behind = key.isNull() & (F.col(INV) > last_id)
            behind = behind if descending else behind | key.isNotNull()
        else:
            further = key < value if descending else key > value
            behind = further | ((key == value) & (F.col(INV) > last_id))
            # the first condition reaches the scan as it is
            reached = key <= value if descending else key >= value
            behind = ((reached & behind) | key.isNull()) if descending else (reached & behind)
        rows = rows.where(behind)
    return rows.orderBy(F.desc(sort_by) if descending else F.asc(sort_by), INV).limit(page_size)


def page_totals(store: DataFrame, user_id: str, page: int = 1, page_size: int = 10) -> DataFrame:
    """Total, number of pages and the row range shown."""
    _check_page(page, page_size)
    first = (page - 1) * page_size + 1
    return owned(store, user_id).agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.lit(page).alias("page"), F.lit(page_size).alias("page_size"),
        F.ceil(F.col("total") / page_size).alias("total_pages"),
        F.when(F.col("total") == 0, 0).otherwise(first).alias("first_row"),
        F.when(F.col("total") == 0, 0).otherwise(F.least(F.lit(page * page_size), "total"))
        .alias("last_row"),
    )


def totals_by_owner(store: DataFrame, page_size: int = 10) -> DataFrame:
    """I3 for every owner at once."""
    return store.groupBy("user_id").agg(F.count(F.lit(1)).alias("total")).withColumn(
        "total_pages", F.ceil(F.col("total") / page_size)
    )


def detail(store: DataFrame, user_id: str, investigation_id: str) -> DataFrame:
    """The owned investigation, or no row."""
    return owned(store, user_id).where(F.col(INV) == investigation_id)


def detail_children(store: DataFrame, child: DataFrame, user_id: str,
                    investigation_id: str) -> DataFrame:
    """Events, nodes, edges or clusters of an owned investigation."""
    mine = detail(store, user_id, investigation_id).select(INV)
    return child.where(F.col(INV) == investigation_id).join(mine, INV, "left_semi")


def without(store: DataFrame, user_id: str, investigation_id: str) -> DataFrame:
    """All rows but the owned investigation; a stranger's stays."""
    gone = (F.col("user_id") == user_id) & (F.col(INV) == investigation_id)
    return store.where(~F.coalesce(gone, F.lit(False)))


def without_all(store: DataFrame, deletions: DataFrame) -> DataFrame:
    """I6 for a table of (user_id, investigation_id) requests."""
    return store.join(deletions.select("user_id", INV).distinct(), ["user_id", INV], "left_anti")


def filename_contains(store: DataFrame, text: str) -> DataFrame:
    """File names with ``text`` in any letter case; blank keeps all."""
    wanted = text.strip().lower()
    return store.where(F.lower(F.coalesce("filename", F.lit(""))).contains(wanted)) if wanted else store


def iso_time(ts: Column) -> Column:
    """ISO 8601 with microseconds only where there are any."""
    fraction = F.when(F.unix_micros(ts) % 1_000_000 != 0, F.date_format(ts, ".SSSSSS")).otherwise("")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.date_format(ts, "xxx"))


def incident_view(store: DataFrame) -> DataFrame:
    """The report view with defaults for what is missing."""
    none = F.array().cast(STRINGS)
    lists = ("incident_next_steps", "mitre_techniques", "popia_flags", "cybercrimes_flags",
             "sa_patterns_matched", "rag_sources_used")
    numbers = ("attack_clusters", "high_threat_count", "event_count")
    return store.select(
        INV,
        F.coalesce("incident_summary", F.lit("")).alias("incident_summary"),
        *[F.coalesce(c, none).alias(c) for c in lists],
        *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers],
        F.coalesce(iso_time(F.col("created_at")), F.lit("")).alias("created_at"),
    )


def regeneration_input(store: DataFrame, top: DataFrame, max_scores: DataFrame,
                       nodes: DataFrame | None = None) -> DataFrame:
    """The context of a new report, from stored rows only.

    ``top`` holds the list of top events, ``max_scores`` the highest stored
    score of each investigation.  Suspicious nodes come from the stored nodes;
    without them the count of high threats stands in.  Retrieval is left empty.
    """
    score = F.coalesce("max_stored_score", F.lit(0))
    joined = store.join(top.select(INV, "top_threats"), INV, "left").join(
        max_scores.select(INV, F.col("max_threat_score").alias("max_stored_score")), INV, "left"
    )
    if nodes is None:
        suspicious = F.col("high_threat_count")
    else:
        counted = nodes.groupBy(INV).agg(F.count_if("is_suspicious").alias("_suspicious"))
        joined = joined.join(counted, INV, "left")
        suspicious = F.coalesce("_suspicious", "high_threat_count")
    return joined.select(
        INV,
        F.struct("event_count", "anomaly_count", "high_threat_count", "threat_distribution",
                 "top_threats", F.col("attack_clusters").alias("attack_clusters_detected"),
                 score.alias("max_threat_score")).alias("threat_summary"),
        F.struct(F.col("graph_nodes").alias("total_nodes"), F.col("graph_edges").alias("total_edges"),
                 suspicious.alias("suspicious_nodes"),
                 F.col("attack_clusters").alias("attack_clusters_detected"),
                 score.alias("max_threat_score_in_graph")).alias("graph_summary"),
        F.struct("popia_flags", "cybercrimes_flags", "sa_patterns_matched",
                 F.lit("").alias("compliance_summary"),
                 F.array().cast(STRINGS).alias("reporting_obligations")).alias("sa_result"),
        F.struct(F.lit(False).alias("rag_available"),
                 F.array().cast("array<struct<source:string,id:string,content:string,"
                                "relevance_score:double>>").alias("retrieved_context"))
        .alias("rag_context"),
    )


def apply_regenerated(store: DataFrame, reports: DataFrame, at: Column) -> DataFrame:
    """Put new report fields on their owner's rows; faulty reports change nothing.

    ``reports`` has user_id, investigation_id, report_error and the report
    columns.
    """
    good = reports.where(F.col("report_error").isNull()).select(
        "user_id", INV, F.struct(*REGENERATED).alias("_new")
    )
    joined = store.join(good, ["user_id", INV], "left")
    new = F.col("_new").isNotNull()
    changed = {c: F.when(new, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in REGENERATED}
    changed["regenerated_at"] = F.when(new, at).otherwise(F.col("regenerated_at"))
    return joined.withColumns(changed).select(*store.columns)
