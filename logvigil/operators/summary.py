"""Counts, distribution and top events per investigation (M1..M6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logvigil.constants import LEVELS
from logvigil.functions.text import tidy_level

INV = "investigation_id"
TOP = 10
TOP_FIELDS = ("event_type", "src_ip", "dst_ip", "threat_score", "threat_level", "threat_signals",
              "anomaly_reasons", "timestamp")
LEVEL_COLUMNS = tuple(name.lower() for name in reversed(LEVELS))


def _level_key(level: Column) -> Column:
    return F.lower(F.coalesce(level, F.lit("None")))


def threat_summary(scored: DataFrame) -> DataFrame:
    """M1, M2: totals and one count per level."""
    level = _level_key(F.col("threat_level"))
    return scored.groupBy(INV).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.count_if(F.coalesce("is_anomaly", F.lit(False))).alias("anomaly_count"),
        F.count_if(level.isin("critical", "high")).alias("high_threat_count"),
        F.coalesce(F.max("threat_score"), F.lit(0)).alias("max_threat_score"),
        *[F.count_if(level == name).alias(name) for name in LEVEL_COLUMNS],
    )


def distribution_map() -> Column:
    """The level counts as one map column."""
    return F.create_map(*[x for n in LEVEL_COLUMNS for x in (F.lit(n), F.col(n))])


def distribution_shares(summary: DataFrame) -> DataFrame:
    """M4: one row per level with its share of all levels; zero when empty."""
    total = sum((F.col(n) for n in LEVEL_COLUMNS), F.lit(0))
    pairs = F.array(*[
        F.struct(F.lit(n).alias("level"), F.col(n).alias("events")) for n in LEVEL_COLUMNS
    ])
    share = F.when(F.col("total") > 0, F.col("p.events") / F.col("total")).otherwise(0.0)
    return summary.select(INV, total.alias("total"), F.explode(pairs).alias("p")).select(
        INV, "p.level", "p.events", share.alias("share")
    )


def top_events(scored: DataFrame, n: int = TOP) -> DataFrame:
    """M3: the n highest scores of each investigation; ties go by event_id.

    The row limit is applied on the map side, so a task sends n rows per
    investigation at most.
    """
    defaults = {
        "threat_score": F.lit(0), "timestamp": F.lit(None).cast("timestamp"),
        "threat_signals": F.array().cast("array<string>"),
        "anomaly_reasons": F.array().cast("array<string>"),
    }
    missing = [c for c in TOP_FIELDS if c not in scored.columns]
    if missing:
        scored = scored.withColumns(
            {c: defaults.get(c, F.lit(None).cast("string")) for c in missing}
        )
    rank = Window.partitionBy(INV).orderBy(
        F.desc(F.coalesce("threat_score", F.lit(0))), F.asc("event_id")
    )
    return (
        scored.select(INV, "event_id", *TOP_FIELDS)
        .withColumn("position", F.row_number().over(rank))
        .where(F.col("position") <= n)
    )


def top_events_list(scored: DataFrame, n: int = TOP) -> DataFrame:
    """M3 as one array per investigation, best first."""
    item = F.struct("position", *TOP_FIELDS)
    return (
        top_events(scored, n).groupBy(INV)
        .agg(F.sort_array(F.collect_list(item)).alias("top_threats"))
        .withColumn("top_threats", F.transform("top_threats", lambda t: t.dropFields("position")))
    )


def events_at_level(scored: DataFrame, level: str) -> DataFrame:
    """M5: ALL, or the events whose tidied level equals ``level``."""
    if level.upper() == "ALL":
        return scored
    return scored.where(F.upper(tidy_level(F.col("threat_level"))) == level.upper())


def recent_totals(investigations: DataFrame, n: int = 5) -> DataFrame:
    """M6: totals over the n newest investigations."""
    newest = investigations.orderBy(F.desc("created_at"), INV).limit(n)
    total = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).alias(c)
    return newest.agg(total("event_count"), total("high_threat_count"), total("attack_clusters"))
