"""Regulatory and regional flags per investigation (C1..C14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logvigil.constants import (
    BANKING_TERMS, CYBER_FLAGS, GOVERNMENT_TERMS, MOBILE_MONEY_TERMS, MUNICIPAL_TERMS,
    NO_OBLIGATIONS, ONBOARDING_TERMS, PATTERN_FLAGS, PERSONAL_TERMS, POPIA_FLAGS,
    RANSOMWARE_TERMS, SERVICE_ACCOUNT_TERMS, UTILITY_TERMS,
)
from logvigil.functions.text import contains_any, flag_list, strip

INV = "investigation_id"

# flag -> (sentence of the summary, obligation); the wording is this project's own
OBLIGATIONS = {
    "POPIA_SECTION_22": (
        "Personal data may be affected, so a section 22 notice is to be considered.",
        "Give the Information Regulator a section 22 notice without undue delay",
    ),
    "CYBERCRIMES_ACT_REPORTABLE": (
        "Activity was seen that the Cybercrimes Act may require to be reported.",
        "Check the section 54 duty to report to the police within 72 hours",
    ),
    "SAPS_REFERRAL": (
        "The activity looks coordinated and is suited for referral to the police.",
        "Hand the evidence of the coordinated activity to the police cybercrime unit",
    ),
    "SARB_REPORTABLE": (
        "Banking systems appear affected, so the central bank may have to be told.",
        "Notify the central bank under its operational resilience directive",
    ),
}


def row_tests(columns: list[str]) -> dict[str, Column]:
    """What one event alone shows."""
    def text(name: str) -> Column:
        if name not in columns:
            return F.lit("")
        return F.lower(F.coalesce(strip(F.col(name)), F.lit("")))

    def strings(name: str) -> Column:
        return F.coalesce(F.col(name), F.array().cast("array<string>"))

    kind, account, target = text("event_type"), text("user_account"), text("dst_ip")
    signals = F.lower(F.array_join(F.transform(strings("threat_signals"), strip), " "))
    combined = F.concat_ws(" ", kind, signals)
    reasons = F.transform(strings("anomaly_reasons"), lambda r: F.upper(strip(r)))
    has = lambda reason: F.array_contains(reasons, reason)
    level = F.coalesce(strip(F.col("threat_level")), F.lit("None"))
    critical = level == "Critical"
    score = F.coalesce("threat_score", F.lit(0))
    personal = contains_any(combined, PERSONAL_TERMS)
    municipal = contains_any(target, MUNICIPAL_TERMS) | contains_any(kind, MUNICIPAL_TERMS)
    state = contains_any(target, GOVERNMENT_TERMS) | contains_any(kind, GOVERNMENT_TERMS)
    return {
        "personal": personal,
        "serious": score >= 50,
        "cross_border": personal & has("CROSS_BORDER"),
        "operator": level.isin("High", "Critical") & contains_any(account, SERVICE_ACCOUNT_TERMS),
        "reportable": critical | has("BRUTE_FORCE") | has("PORT_SCAN"),
        "banking": critical & contains_any(kind, BANKING_TERMS),
        "utility": contains_any(combined, UTILITY_TERMS),
        "portal": has("BRUTE_FORCE") & state,
        "mobile": contains_any(kind, MOBILE_MONEY_TERMS),
        "ransom": contains_any(kind, RANSOMWARE_TERMS) & municipal,
        "onboarding": (score >= 50) & contains_any(kind, ONBOARDING_TERMS),
    }


def investigation_flags(scored: DataFrame, cluster_counts: DataFrame | None = None) -> DataFrame:
    """One boolean column per flag; only booleans travel to the aggregation.

    ``cluster_counts`` has investigation_id and attack_clusters_detected; an
    investigation without a row there has no cluster.
    """
    tests = row_tests(scored.columns)
    seen = scored.groupBy(INV).agg(*[F.bool_or(test).alias(name) for name, test in tests.items()])
    if cluster_counts is None:
        clusters = F.lit(0)
    else:
        seen = seen.join(cluster_counts.select(INV, "attack_clusters_detected"), INV, "left")
        clusters = F.coalesce("attack_clusters_detected", F.lit(0))
    col = F.col
    flags = [
        col("personal"), col("personal") & col("serious"), col("cross_border"), col("operator"),
        col("reportable"), col("reportable") & (clusters > 0), col("banking"),
        col("utility"), col("portal"), col("mobile"), col("ransom"), col("onboarding"),
    ]
    names = [*POPIA_FLAGS, *CYBER_FLAGS, *PATTERN_FLAGS]
    return seen.select(INV, *[flag.alias(name) for flag, name in zip(flags, names, strict=True)])


def classify(scored: DataFrame, cluster_counts: DataFrame | None = None) -> DataFrame:
    """Ordered flag lists, summary sentences and obligations."""
    flags = investigation_flags(scored, cluster_counts)

    def listed(names) -> Column:
        return flag_list((F.col(n), n) for n in names)

    sentences = flag_list((F.col(n), texts[0]) for n, texts in OBLIGATIONS.items())
    duties = flag_list((F.col(n), texts[1]) for n, texts in OBLIGATIONS.items())
    return flags.select(
        INV,
        listed(POPIA_FLAGS).alias("popia_flags"),
        listed(CYBER_FLAGS).alias("cybercrimes_flags"),
        listed(PATTERN_FLAGS).alias("sa_patterns_matched"),
        F.coalesce(F.nullif(F.array_join(sentences, " "), F.lit("")), F.lit(NO_OBLIGATIONS))
        .alias("compliance_summary"),
        duties.alias("reporting_obligations"),
    )
