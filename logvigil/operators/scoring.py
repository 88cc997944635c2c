"""Threat score, level and signals (T1..T9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logvigil.constants import (
    LARGE_TRANSFER_BYTES, OUTLIER_SIGNAL, PORT_PROTOCOLS, PROTOCOL_SIGNAL, REASON_POINTS,
    SERVICE_SIGNAL, SERVICE_TERMS, TRANSFER_SIGNAL,
)
from logvigil.functions.text import contains_any, flag_list, strip
from logvigil.operators.normalise import check_columns


def protocol_mismatch(port: Column, protocol: Column) -> Column:
    """A named protocol that is not the one expected on a known port."""
    expected = F.create_map(*[
        x for number, names in PORT_PROTOCOLS.items()
        for x in (F.lit(number), F.array(*[F.lit(n) for n in names]))
    ])
    named = F.upper(F.coalesce(strip(protocol), F.lit("")))
    # a blank protocol is as expected as any
    fitting = F.array_contains(F.array_append(F.try_element_at(expected, port), F.lit("")), named)
    return ~F.coalesce(fitting, F.lit(True))


def threat_level(score: Column) -> Column:
    """T7."""
    return (
        F.when(score <= 0, "None").when(score <= 24, "Low").when(score <= 49, "Medium")
        .when(score <= 74, "High").otherwise("Critical")
    )


def _event_signals(columns: list[str]) -> list[tuple[Column, int, str]]:
    """T2..T5: signals beside the anomaly reasons, in output order."""
    protocol = F.col("protocol") if "protocol" in columns else F.lit(None).cast("string")
    port = F.col("dst_port") if "dst_port" in columns else F.lit(0)
    kind = F.col("event_type") if "event_type" in columns else F.lit("")
    amount = F.col("bytes_transferred") if "bytes_transferred" in columns else F.lit(0.0)
    return [
        (protocol_mismatch(port, protocol), *PROTOCOL_SIGNAL),
        (F.coalesce("ml_is_anomaly", F.lit(False)), *OUTLIER_SIGNAL),
        (contains_any(F.lower(kind), SERVICE_TERMS), *SERVICE_SIGNAL),
        (F.coalesce(amount > LARGE_TRANSFER_BYTES, F.lit(False)), *TRANSFER_SIGNAL),
    ]


def score_threats(detected: DataFrame) -> DataFrame:
    """Add threat_score (0..100), threat_level and threat_signals.

    A reason counts once however often it is listed; missing reasons are none.
    """
    check_columns(detected, ("is_anomaly", "ml_is_anomaly", "anomaly_reasons"))
    reasons = F.coalesce("anomaly_reasons", F.array().cast("array<string>"))
    signals = [
        (F.array_contains(reasons, reason), points, label)
        for reason, (points, label) in REASON_POINTS.items()
    ] + _event_signals(detected.columns)
    total = F.lit(0)
    for fired, points, _ in signals:
        total = total + F.when(fired, points).otherwise(0)
    score = F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int")
    return (
        detected.withColumn("threat_score", score)
        .withColumn("threat_level", threat_level(F.col("threat_score")))
        .withColumn("threat_signals", flag_list((fired, label) for fired, _, label in signals))
    )
