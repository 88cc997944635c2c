"""Anomaly rules R1..R9, R11, R12."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logvigil.constants import REASON_POINTS, SCAN_PORTS, SPIKE_FACTOR, SPIKE_MIN_EVENTS
from logvigil.functions.network import cross_border
from logvigil.functions.skew import UNIT
from logvigil.functions.text import flag_list
from logvigil.operators.features import CONTEXT_COLUMNS, hour_of_day, with_source_context
from logvigil.operators.normalise import check_columns, to_bytes, to_port

REQUIRED = ("timestamp", "src_ip", "dst_ip", "event_type", "dst_port", "bytes_transferred")


def prepare(events: DataFrame, require_nonempty: bool = False) -> DataFrame:
    """Check the columns and coerce bytes and port."""
    check_columns(events, REQUIRED)
    if require_nonempty and events.isEmpty():
        raise ValueError("There are no events to look at")
    kind = {f.name: f.dataType for f in events.schema}
    return events.withColumns({
        "bytes_transferred": to_bytes(F.col("bytes_transferred"), kind.get("bytes_transferred")),
        "dst_port": to_port(F.col("dst_port"), kind.get("dst_port")),
    })


def stateless_rules(zone: str = "UTC") -> dict[str, Column]:
    """Rules that look at one event only."""
    amount = F.col("bytes_transferred")
    return {
        "OFF_HOURS": hour_of_day(F.col("timestamp"), zone) < 5,
        "ROUND_BYTES": (amount > 0) & (amount % 1000 == 0),
        "CROSS_BORDER": cross_border("dst_ip"),
    }


def source_rules() -> dict[str, Column]:
    """Rules that need the context of the source."""
    count = F.col("source_events")
    return {
        "AMOUNT_SPIKE": (count >= SPIKE_MIN_EVENTS)
        & (F.col("bytes_transferred") > SPIKE_FACTOR * F.col("source_mean_bytes")),
        "RAPID_SUCCESSION": F.col("in_rapid_burst"),
        "NEW_SOURCE": count == 1,
        "PORT_SCAN": F.col("source_ports") >= SCAN_PORTS,
        "BRUTE_FORCE": F.col("in_brute_burst"),
    }


RULE_ORDER = tuple(REASON_POINTS)


def anomaly_reasons(zone: str = "UTC") -> Column:
    """The reasons that hold, in rule order.

    The address test was made before the events met their source context, so
    all rules here are comparisons.
    """
    rules = {**stateless_rules(zone), **source_rules(), "CROSS_BORDER": F.col("is_abroad")}
    return flag_list((rules[name], name) for name in RULE_ORDER)


def apply_rules(context: DataFrame, zone: str = "UTC") -> DataFrame:
    """Reasons and verdict for events that carry their source context.

    ``ml_is_anomaly`` counts towards the verdict when present (R11).
    """
    if "ml_is_anomaly" not in context.columns:
        context = context.withColumn("ml_is_anomaly", F.lit(False))
    return context.withColumn("anomaly_reasons", anomaly_reasons(zone)).withColumn(
        "is_anomaly", F.col("ml_is_anomaly") | (F.size("anomaly_reasons") > 0)
    )


def detect_anomalies(events: DataFrame, forest: bool = False, zone: str = "UTC",
                     unit: int = UNIT, require_nonempty: bool = False) -> DataFrame:
    """Events with ml_is_anomaly, anomaly_reasons and is_anomaly.

    With ``forest`` the isolation forest sets ``ml_is_anomaly``; otherwise a
    column of that name is used as it is, or false.
    """
    context = with_source_context(prepare(events, require_nonempty), zone, unit)
    if forest:
        from logvigil.operators.forest import isolation_forest

        context = isolation_forest(context, zone=zone)
    return apply_rules(context, zone).drop(*CONTEXT_COLUMNS)
