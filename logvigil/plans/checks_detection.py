"""Registered queries on detection, scoring, flags and summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logvigil.functions.network import cross_border
from logvigil.operators import features, regulatory, rules, scoring, summary
from logvigil.operators.forest import isolation_forest
from logvigil.plans import oracle as sql
from logvigil.plans.adapter import load, telemetry_of
from logvigil.plans.investigate import scored_events

INV = "investigation_id"


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry_of(spark, sf_dir)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_events(logs(spark, sf_dir))


def piped(name: str, alias: str | None = None):
    return F.array_join(name, "|").alias(alias or name)


def stamp(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)


def threat_distribution(spark, sf_dir):
    return summary.threat_summary(scored(spark, sf_dir))


def source_profile(spark, sf_dir):
    return features.source_profile(logs(spark, sf_dir)).withColumn(
        "source_mean_bytes", F.round("source_mean_bytes", 4)
    )


def source_hour_events(spark, sf_dir):
    return features.hourly_counts(logs(spark, sf_dir))


def calendar_features(spark, sf_dir):
    ts = F.col("timestamp")
    return logs(spark, sf_dir).select(
        "event_id", features.hour_of_day(ts).alias("hour_of_day"),
        features.day_of_week(ts).alias("day_of_week"),
    )


def feature_matrix(spark, sf_dir):
    names = ["bytes_transferred", "dst_port", "hour_of_day", "day_of_week",
             "events_per_source_hour", "ports_per_source"]
    rows = features.with_source_context(logs(spark, sf_dir)).select(
        "event_id", features.feature_vector().alias("f")
    )
    return rows.select("event_id", *[F.col("f")[i].alias(n) for i, n in enumerate(names)])


def anomaly_reasons(spark, sf_dir):
    return rules.detect_anomalies(logs(spark, sf_dir)).select(
        "event_id", piped("anomaly_reasons"), "is_anomaly"
    )


def events_with(reason: str):
    def query(spark, sf_dir):
        marked = rules.detect_anomalies(logs(spark, sf_dir))
        return marked.where(F.array_contains("anomaly_reasons", reason)).select(
            INV, "event_id", "src_ip", "dst_ip"
        )
    return query


def stateless(reason: str):
    """Rules on single events need no source context, so no shuffle."""
    def query(spark, sf_dir):
        return logs(spark, sf_dir).where(rules.stateless_rules()[reason]).select(
            INV, "event_id", "src_ip", "dst_ip"
        )
    return query


def cross_border_addresses(spark, sf_dir):
    """R7 over addresses from every part of the IPv4 space."""
    number = "(o_orderkey % 1000000007 * 2654435761) % 4294967296"
    return load(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        f"""concat_ws('.', ({number}) div 16777216, ({number}) div 65536 % 256,
                      ({number}) div 256 % 256, ({number}) % 256) as address""",
    ).withColumn("outside", cross_border("address"))


def isolation_forest_flags(spark, sf_dir):
    """R10 as facts: the flagged share, and whether planted outliers are flagged."""
    planted = F.col("event_id") % 997 == 5
    far = logs(spark, sf_dir).withColumns({
        "bytes_transferred": F.when(planted, 1e12).otherwise(F.col("bytes_transferred")),
        "dst_port": F.when(planted, 65_000).otherwise(F.col("dst_port")),
    })
    found = isolation_forest(features.with_source_context(rules.prepare(far)))
    share = F.count_if("ml_is_anomaly") / F.count(F.lit(1))
    return found.groupBy(INV).agg(
        F.count(F.lit(1)).alias("events"), share.between(0.03, 0.06).alias("share_as_set"),
        F.count_if(planted).alias("planted"), F.count_if(planted & F.col("ml_is_anomaly")).alias("planted_found"),
    )


def outlier_scores(spark, sf_dir):
    """Given outliers among the events."""
    given = logs(spark, sf_dir).withColumn("ml_is_anomaly", F.col("event_id") % 20 == 0)
    return scored_events(given).select(
        INV, "event_id", "is_anomaly", "threat_score", "threat_level", piped("threat_signals"))


def column_checks(spark, sf_dir):
    """The complaint about each column that is taken away, and about an empty input."""
    frame = logs(spark, sf_dir)

    def complaint(check) -> str:
        try:
            check()
        except ValueError as error:
            return str(error)
        return ""

    found = [(c, complaint(lambda c=c: rules.prepare(frame.drop(c)))) for c in sorted(frame.columns)]
    none = frame.where("event_id < 0")
    found.append(("(no rows)", complaint(lambda: rules.prepare(none, require_nonempty=True))))
    found.append(("(all rows)", complaint(lambda: rules.prepare(frame, require_nonempty=True))))
    return spark.createDataFrame(found, "taken string, complaint string")


def threat_scores(spark, sf_dir):
    return scored(spark, sf_dir).select(
        INV, "event_id", "threat_score", "threat_level", piped("threat_signals")
    )


def protocol_mismatch(spark, sf_dir):
    return logs(spark, sf_dir).where(
        scoring.protocol_mismatch(F.col("dst_port"), F.col("protocol"))
    ).select("event_id", "dst_port", "protocol")


def regulatory_flags(spark, sf_dir):
    return regulatory.investigation_flags(scored(spark, sf_dir))


def small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log cut into 2,111 investigations of a few events, so that flags take both signs."""
    return logs(spark, sf_dir).withColumn(INV, F.concat(F.lit("inv-"), F.col("event_id") % 2111))


def small_flags(spark, sf_dir):
    return regulatory.investigation_flags(scored_events(small(spark, sf_dir)))


def small_compliance(spark, sf_dir):
    return regulatory.classify(scored_events(small(spark, sf_dir))).select(
        INV, piped("popia_flags"), piped("cybercrimes_flags"), piped("sa_patterns_matched"),
        "compliance_summary", piped("reporting_obligations"),
    )


def compliance_summary(spark, sf_dir):
    return regulatory.classify(scored(spark, sf_dir)).select(
        INV, piped("popia_flags"), piped("cybercrimes_flags"), piped("sa_patterns_matched"),
        "compliance_summary", piped("reporting_obligations"),
    )


def top_events(spark, sf_dir):
    return summary.top_events(scored(spark, sf_dir)).select(
        INV, F.col("position").cast("long").alias("position"), "event_id", "event_type", "src_ip",
        "dst_ip", "threat_score", "threat_level", piped("threat_signals", "signals"),
        piped("anomaly_reasons", "reasons"), stamp("timestamp"),
    )


def distribution_shares(spark, sf_dir):
    shares = summary.distribution_shares(summary.threat_summary(scored(spark, sf_dir)))
    return shares.withColumn("share", F.round("share", 6))


def critical_events(spark, sf_dir):
    return summary.events_at_level(scored(spark, sf_dir), "critical").select(
        INV, "event_id", "threat_score"
    )


_CONTEXT, _SCORED = sql.chain(sql.CONTEXT), sql.chain(sql.SCORED)
_LOGS = sql.chain(sql.LOGS)
_SUMMARY = sql.chain(sql.SCORED, sql.SUMMARY)
_BY_REASON = "SELECT investigation_id, event_id, src_ip, dst_ip FROM rules WHERE \"{0}\""


def _small(text: str) -> str:
    """The same statement over the small investigations."""
    whole = f"'inv-' || (g % {sql.INVESTIGATIONS}) AS investigation_id"
    assert whole in text
    return text.replace(whole, "'inv-' || (event_id % 2111) AS investigation_id")


_NUMBER = "(o_orderkey % 1000000007 * 2654435761) % 4294967296"

CHECKS = {
    "threat_distribution": (threat_distribution, _SUMMARY + " SELECT * FROM summary"),
    "source_profile": (source_profile, sql.chain(sql.LOGS, sql.PROFILE) + """
        SELECT investigation_id, src_ip, source_events, round(source_mean_bytes, 4) AS source_mean_bytes,
               source_ports FROM profile"""),
    "source_hour_events": (source_hour_events, _LOGS + """
        SELECT investigation_id, src_ip, ts_us // 3600000000 AS hour, count(*) AS source_hour_events
        FROM logs GROUP BY ALL"""),
    "calendar_features": (calendar_features, _LOGS + """
        SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour_of_day,
               CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week FROM logs"""),
    "feature_matrix": (feature_matrix, sql.chain(sql.LOGS, sql.PROFILE) + """
        SELECT event_id, bytes_transferred, CAST(dst_port AS DOUBLE) AS dst_port,
               CAST(hour(ts) AS DOUBLE) AS hour_of_day, CAST(isodow(ts) - 1 AS DOUBLE) AS day_of_week,
               CAST(count(*) OVER (PARTITION BY investigation_id, src_ip, date_trunc('hour', ts)) AS DOUBLE)
                 AS events_per_source_hour,
               CAST(source_ports AS DOUBLE) AS ports_per_source
        FROM logs JOIN profile USING (investigation_id, src_ip)"""),
    "anomaly_reasons": (anomaly_reasons, _SCORED + """
        SELECT event_id, reasons AS anomaly_reasons, is_anomaly FROM scored"""),
    "amount_spike": (events_with("AMOUNT_SPIKE"), _CONTEXT + _BY_REASON.format("AMOUNT_SPIKE")),
    "rapid_succession": (events_with("RAPID_SUCCESSION"), _CONTEXT + _BY_REASON.format("RAPID_SUCCESSION")),
    "new_source": (events_with("NEW_SOURCE"), _CONTEXT + _BY_REASON.format("NEW_SOURCE")),
    "port_scan": (events_with("PORT_SCAN"), _CONTEXT + _BY_REASON.format("PORT_SCAN")),
    "brute_force": (events_with("BRUTE_FORCE"), _CONTEXT + _BY_REASON.format("BRUTE_FORCE")),
    "off_hours": (stateless("OFF_HOURS"), _CONTEXT + _BY_REASON.format("OFF_HOURS")),
    "round_bytes": (stateless("ROUND_BYTES"), _CONTEXT + _BY_REASON.format("ROUND_BYTES")),
    "cross_border": (stateless("CROSS_BORDER"), _CONTEXT + _BY_REASON.format("CROSS_BORDER")),
    "cross_border_addresses": (cross_border_addresses, f"""
        WITH a AS (SELECT o_orderkey, (({_NUMBER}) // 16777216) || '.' || (({_NUMBER}) // 65536 % 256)
                     || '.' || (({_NUMBER}) // 256 % 256) || '.' || (({_NUMBER}) % 256) AS address FROM orders)
        SELECT o_orderkey, address, {sql.ABROAD.format(c='address')} AS outside FROM a"""),
    "isolation_forest_flags": (isolation_forest_flags, _LOGS + """
        SELECT investigation_id, count(*) AS events, true AS share_as_set,
               count(*) FILTER (event_id % 997 = 5) AS planted,
               count(*) FILTER (event_id % 997 = 5) AS planted_found FROM logs GROUP BY ALL"""),
    "outlier_scores": (outlier_scores, _SCORED + """,
        given AS (SELECT *, event_id % 20 = 0 AS ml FROM marked),
        rated AS (
          SELECT *, CAST(least(100, """ + sql.POINTS + """ + CASE WHEN ml THEN 15 ELSE 0 END) AS INTEGER) AS score
          FROM given)
        SELECT investigation_id, event_id, ml OR """ + sql.REASONS + """ <> '' AS is_anomaly, score AS threat_score,
               CASE WHEN score = 0 THEN 'None' WHEN score <= 24 THEN 'Low' WHEN score <= 49 THEN 'Medium'
                    WHEN score <= 74 THEN 'High' ELSE 'Critical' END AS threat_level,
               """ + sql.labels("CASE WHEN ml THEN 'Statistical outlier (ML)' END") + """ AS threat_signals
        FROM rated"""),
    "column_checks": (column_checks, """
        SELECT taken, CASE WHEN taken = '(no rows)' THEN 'There are no events to look at'
                           WHEN needed THEN 'Missing required columns: ' || taken ELSE '' END AS complaint
        FROM (VALUES ('investigation_id', false), ('event_id', false), ('timestamp', true), ('src_ip', true),
              ('dst_ip', true), ('event_type', true), ('dst_port', true), ('protocol', false),
              ('bytes_transferred', true), ('user_account', false), ('device_id', false),
              ('(no rows)', false), ('(all rows)', false)) AS t(taken, needed)"""),
    "threat_scores": (threat_scores, _SCORED + """
        SELECT investigation_id, event_id, threat_score, threat_level, signals AS threat_signals FROM scored"""),
    "protocol_mismatch": (protocol_mismatch, _LOGS + f"""
        SELECT event_id, dst_port, protocol FROM logs WHERE {sql.MISMATCH}"""),
    "regulatory_flags": (regulatory_flags, sql.chain(sql.SCORED, sql.flags()) + " SELECT * FROM flags"),
    "small_flags": (small_flags, _small(sql.chain(sql.SCORED, sql.flags())) + " SELECT * FROM flags"),
    "small_compliance": (small_compliance, _small(sql.chain(sql.SCORED, sql.flags())) + " SELECT * FROM listed"),
    "compliance_summary": (compliance_summary, sql.chain(sql.SCORED, sql.flags()) + " SELECT * FROM listed"),
    "top_events": (top_events, sql.chain(sql.SCORED, sql.TOP) + """
        SELECT investigation_id, position, event_id, event_type, src_ip, dst_ip, threat_score, threat_level,
               signals, reasons, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS timestamp FROM top_events"""),
    "distribution_shares": (distribution_shares, _SUMMARY + """
        SELECT investigation_id, level, events, round(events / event_count, 6) AS share
        FROM (UNPIVOT summary ON critical, high, medium, low, "none" INTO NAME level VALUE events)"""),
    "events_at_level": (critical_events, _SCORED + """
        SELECT investigation_id, event_id, threat_score FROM scored WHERE threat_level = 'Critical'"""),
}
