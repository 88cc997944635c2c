"""Preparing and grounding generated incident reports (B1..B10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logvigil.constants import (
    CONFIDENCE_LEVELS, REPORT_KEYS, REPORT_LISTS, STEP_COUNT, STEP_PADDING, TECHNIQUE_ENTRY,
)
from logvigil.functions.text import strip

INV = "investigation_id"
STRINGS = "array<string>"
REPORT_AUTHOR = "report-model"


def strip_fence(raw: Column) -> Column:
    """B1: remove one Markdown code fence around a JSON text."""
    opened = F.regexp_replace(strip(raw), r"\A```(json)?", "")
    return strip(F.regexp_replace(opened, r"```\z", ""))


def _document(text: Column) -> Column:
    """The JSON value of a text, or null if it is not one value and nothing else.

    Spark's parser stops at the end of the first value; inside an array and
    inside an object anything that follows it shows.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    closed = F.try_parse_json(F.concat(F.lit('{"report":'), text, F.lit(',"end":0}')))
    alone = (
        F.try_variant_get(listed, "$[1]", "variant").isNull()
        & F.try_variant_get(closed, "$.end", "int").isNotNull()
    )
    return F.when(alone, F.try_variant_get(listed, "$[0]", "variant"))


def _type_of(field: str) -> str:
    return f"schema_of_variant(variant_get(_doc, '$.{field}'))"


def _report_error() -> Column:
    """B2: the first broken rule of the report contract, or null."""
    absent = ", ".join(f"if(variant_get(_doc, '$.{k}') is null, '{k}', null)" for k in REPORT_KEYS)
    lists = "\n".join(
        f"when {_type_of(f)} not like 'ARRAY%' then '{f} must be a list'" for f in REPORT_LISTS
    )
    levels = ", ".join(f"'{c}'" for c in CONFIDENCE_LEVELS)
    return F.expr(f"""case
        when _doc is null then 'report is not valid JSON'
        when schema_of_variant(_doc) not like 'OBJECT%' then 'report must be a JSON object'
        when size(array_compact(array({absent}))) > 0
             then concat('report misses required keys: ', array_join(array_compact(array({absent})), ', '))
        when {_type_of('incident_summary')} <> 'STRING' then 'incident_summary must be a string'
        {lists}
        when {_type_of('confidence_level')} <> 'STRING'
             or variant_get(_doc, '$.confidence_level', 'string') not in ({levels})
             then 'confidence_level must be High, Medium, or Low'
        end""")


def valid_techniques(entries: Column) -> Column:
    """Entries that begin with a technique id, their text unchanged."""
    return F.filter(entries, lambda e: F.coalesce(strip(e).rlike(TECHNIQUE_ENTRY), F.lit(False)))


def grounded_sources(sources: Column, rag_available: Column) -> Column:
    """No sources when retrieval is known to have been unavailable."""
    cleared = F.array().cast(STRINGS)
    return F.when(F.coalesce(rag_available, F.lit(True)), sources).otherwise(cleared)


def four_steps(steps: Column) -> Column:
    """Exactly four steps, padded or cut."""
    padded = F.concat(steps, F.array_repeat(F.lit(STEP_PADDING), STEP_COUNT))
    return F.slice(padded, 1, STEP_COUNT)


def parse_reports(raw: DataFrame, author: str = REPORT_AUTHOR) -> DataFrame:
    """B1..B6: the grounded report columns and ``report_error``.

    ``raw`` has raw_report and, where known, rag_available; other columns stay.
    A faulty report has null report columns.
    """
    available = F.col("rag_available") if "rag_available" in raw.columns else F.lit(None)
    parsed = raw.withColumn("_doc", _document(strip_fence(F.col("raw_report")))).withColumn(
        "report_error", _report_error()
    )
    sound = F.col("report_error").isNull()
    text = lambda f: F.expr(f"try_variant_get(_doc, '$.{f}', 'string')")
    listed = lambda f: F.expr(f"try_variant_get(_doc, '$.{f}', '{STRINGS}')")
    columns = {
        "incident_summary": text("incident_summary"),
        "mitre_techniques": valid_techniques(listed("mitre_techniques")),
        "confidence_level": text("confidence_level"),
        "incident_next_steps": four_steps(listed("incident_next_steps")),
        "popia_flags": listed("popia_flags"),
        "cybercrimes_flags": listed("cybercrimes_flags"),
        "sa_patterns_matched": listed("sa_patterns_matched"),
        "rag_sources_used": grounded_sources(listed("rag_sources_used"), available),
        "generated_by": F.lit(author),
        "mock": F.lit(False),
    }
    return parsed.withColumns({n: F.when(sound, c) for n, c in columns.items()}).drop("_doc")


REPORT_COLUMNS = ("incident_summary", "mitre_techniques", "confidence_level", "incident_next_steps",
                  "popia_flags", "cybercrimes_flags", "sa_patterns_matched", "rag_sources_used",
                  "generated_by", "mock")


def evidence_report(evidence: DataFrame) -> DataFrame:
    """A deterministic report from the counts and flags themselves.

    ``evidence`` has event_count, anomaly_count, high_threat_count,
    max_threat_score, attack_clusters, the three flag lists, technique_ids and,
    optionally, rag_sources.
    """
    counts = F.format_string(
        "%d events were analysed; %d were anomalous and %d rated High or Critical. "
        "The highest score was %d and %d attack clusters were found.",
        "event_count", "anomaly_count", "high_threat_count", "max_threat_score", "attack_clusters",
    )
    flags = F.concat("popia_flags", "cybercrimes_flags", "sa_patterns_matched")
    findings = F.when(
        F.size(flags) > 0,
        F.concat(F.lit("Flags raised: "), F.array_join(flags, ", "), F.lit(".")),
    ).otherwise("No regulatory or regional flag was raised.")
    confidence = (
        F.when(F.col("max_threat_score") >= 75, "High")
        .when(F.col("max_threat_score") >= 50, "Medium").otherwise("Low")
    )
    steps = F.array_compact(F.array(
        F.when(F.col("high_threat_count") > 0, "Review every event rated High or Critical."),
        F.when(F.col("attack_clusters") > 0, "Contain the hosts of the attack clusters."),
        F.when(F.size("popia_flags") > 0, "Assess which personal data may be affected."),
        F.when(F.size("cybercrimes_flags") > 0, "Preserve evidence and check reporting duties."),
    ))
    sources = F.col("rag_sources") if "rag_sources" in evidence.columns else F.array().cast(STRINGS)
    return evidence.select(
        INV,
        F.concat(counts, F.lit("\n\n"), findings).alias("incident_summary"),
        F.col("technique_ids").alias("mitre_techniques"),
        confidence.alias("confidence_level"),
        four_steps(steps).alias("incident_next_steps"),
        "popia_flags", "cybercrimes_flags", "sa_patterns_matched",
        sources.alias("rag_sources_used"),
        F.lit("evidence-template").alias("generated_by"),
        F.lit(True).alias("mock"),
    )


def reports_or_fallback(parsed: DataFrame, fallback: DataFrame) -> DataFrame:
    """The valid generated report, else the evidence report with the error.

    ``fallback`` has one row per investigation; one without any generated
    report gets the fallback and no error.
    """
    got = parsed.select(INV, "report_error", F.struct(*REPORT_COLUMNS).alias("_new"))
    joined = fallback.join(got, INV, "left")
    usable = F.col("_new").isNotNull() & F.col("report_error").isNull()
    return joined.select(
        INV,
        *[F.when(usable, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in REPORT_COLUMNS],
        F.when(~usable, F.col("report_error")).alias("report_error"),
    )


def prompt_context(evidence: DataFrame, max_entries: int | None = None,
                   content_chars: int | None = None) -> DataFrame:
    """The four context parts as one JSON text per investigation.

    ``evidence`` has the struct columns threat_summary, graph_summary, sa_result
    and rag_context (rag_available, retrieved_context).  Small models get fewer
    entries of limited length; by default nothing is cut.
    """
    entries = F.coalesce("rag_context.retrieved_context", F.array())
    if max_entries is not None:
        entries = F.slice(entries, 1, max_entries)

    def trimmed(e: Column) -> Column:
        content = F.coalesce(e["content"], F.lit(""))
        if content_chars is not None:
            content = F.substring(content, 1, content_chars)
        return F.struct(
            e["source"].alias("source"), e["id"].alias("id"), content.alias("content"),
            e["relevance_score"].alias("relevance_score"),
        )

    rag = F.struct(
        F.coalesce("rag_context.rag_available", F.lit(False)).alias("rag_available"),
        F.transform(entries, trimmed).alias("retrieved_context"),
    )
    whole = F.struct("threat_summary", "graph_summary", "sa_result", rag.alias("rag_context"))
    return evidence.select(
        INV, F.to_json(whole, {"ignoreNullFields": "false"}).alias("prompt_context")
    )


def split_technique(entry: Column) -> Column:
    """Struct of technique id and name; other text is all name."""
    text = strip(F.coalesce(entry, F.lit("")))
    pattern = r"^(T\d{4}(?:\.\d{3})?)\s*(?:\((.*)\))?$"
    matched = text.rlike(pattern)
    return F.struct(
        F.when(matched, F.regexp_extract(text, pattern, 1)).otherwise("").alias("id"),
        F.when(matched, F.regexp_extract(text, pattern, 2)).otherwise(text).alias("name"),
    )
