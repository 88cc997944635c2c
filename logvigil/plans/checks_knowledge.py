"""Registered queries on the knowledge base, retrieval and reports."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from logvigil.functions.text import squeeze
from logvigil.operators import knowledge, models, regulatory, reports, retrieval, summary
from logvigil.plans import oracle as sql
from logvigil.plans.adapter import load
from logvigil.plans.checks_detection import INV, piped, scored
from logvigil.plans.knowledge_base import ingest, read_base
from logvigil.session import cut_lineage, scratch_path

STIX_OBJECTS = """
    event_id as position,
    concat('attack-pattern--', user_id) as id,
    if(event_type = 'error', 'tool', 'attack-pattern') as type,
    concat('  Name ', user_id, ' ', event_type, ' ') as name,
    concat('seen  ', event_type) as description,
    cast(event_id div 3 as string) as modified,
    event_id % 23 = 0 as revoked,
    if(event_id % 29 = 0, null, event_id % 31 = 0) as x_mitre_deprecated,
    array(named_struct('source_name', 'other', 'external_id', 'X1'),
          named_struct('source_name', 'mitre-attack',
                       'external_id', if(user_id % 13 = 0, null, concat('T', user_id)))) as external_references,
    array(named_struct('kill_chain_name', 'mitre-attack', 'phase_name', concat(event_type, ' ')),
          named_struct('kill_chain_name', 'mitre-attack', 'phase_name', 'discovery'),
          named_struct('kill_chain_name', 'other', 'phase_name', 'x')) as kill_chain_phases,
    array('Linux', if(event_id % 2 = 0, 'Linux', 'Windows'), '') as x_mitre_platforms
"""


def stix_objects(spark, sf_dir):
    """Versions of techniques made from the events."""
    return load(spark, sf_dir, "events").selectExpr(*_split(STIX_OBJECTS))


def _split(text: str) -> list[str]:
    """Top-level comma-separated expressions."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()]


def latest_versions(spark, sf_dir):
    objects = stix_objects(spark, sf_dir).select("position", "id", "modified", "name")
    return knowledge.latest_versions(objects)


def technique_records(spark, sf_dir):
    return knowledge.technique_records(stix_objects(spark, sf_dir)).select(
        "collection", "id", "document",
        *[F.col("metadata")[k].alias(k) for k in ("name", "tactics", "platforms")],
    )


def pattern_records(spark, sf_dir):
    """K6: parts as threat patterns."""
    patterns = load(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"),
        F.array("p_brand", F.concat(F.lit("size "), "p_size")).alias("indicators"),
        F.when(F.col("p_partkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("p_type")).alias("sector"),
        F.array(F.concat(F.lit("T"), "p_size"), F.lit("T1")).alias("mitre_technique_ids"), F.lit("survey").alias("source"))
    return knowledge.pattern_records(patterns).select(
        "collection", "id", "document", *[F.col("metadata")[k].alias(k) for k in ("name", "sectors", "mitre_technique_ids")])


def compliance_records(spark, sf_dir):
    """K6: parts as compliance rules."""
    rules = load(spark, sf_dir, "part").select(
        F.concat(F.lit("C"), "p_partkey").alias("id"), F.col("p_brand").alias("legislation"),
        F.concat(F.lit("s"), "p_size").alias("section"), F.col("p_name").alias("title"), F.col("p_type").alias("summary"),
        F.array("p_type", "p_brand").alias("trigger_conditions"), F.lit("report").alias("required_action"),
        F.lit("office").alias("reporting_body"), F.concat("p_size", F.lit(" days")).alias("deadline"))
    return knowledge.compliance_records(rules).select(
        "collection", "id", "document", *[F.col("metadata")[k].alias(k) for k in ("legislation", "section", "deadline")])


def whitespace(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", squeeze(F.col("text")).alias("text"))


def kb_documents(spark, sf_dir):
    """The embeddings table as a knowledge base with its labels as collections."""
    return load(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("c"), "label").alias("collection"),
        F.concat(F.lit("d"), F.lpad(F.col("vec_id").cast("string"), 8, "0")).alias("id"),
        "embedding",
    )


def kb_upsert(spark, sf_dir):
    """Every third document comes again with new text, some documents are new."""
    docs = kb_documents(spark, sf_dir).withColumn("document", F.col("id")).drop("embedding")
    number = F.regexp_extract("id", "[0-9]+", 0).cast("int")
    again = docs.where(number % 3 == 0).withColumn("document", F.concat(F.lit("new "), "id"))
    extra = docs.withColumn("id", F.concat(F.lit("x"), "id"))
    new = again.unionByName(extra)
    once = knowledge.upsert(docs, new)
    return knowledge.upsert(once, new)


def _part_records(spark, sf_dir, collections):
    return load(spark, sf_dir, "part").select(
        F.concat(F.lit("c"), F.col("p_partkey") % collections).alias("collection"),
        F.concat(F.lit("P"), "p_partkey").alias("id"), F.col("p_name").alias("document"),
        F.create_map(F.lit("brand"), F.col("p_brand")).alias("metadata"))


def kb_ingested(spark, sf_dir):
    """Parts as records of three collections, ingested, and every fifth once more with new text."""
    root, records = scratch_path(spark, "kb"), _part_records(spark, sf_dir, 3)
    ingest(spark, root, records)
    ingest(spark, root, records.where(F.substring("id", 2, 20).cast("long") % 5 == 0).withColumn(
        "document", F.concat(F.lit("new "), "document")))
    return read_base(spark, root).select(
        "collection", "id", "document", F.col("metadata")["brand"].alias("brand"),
        "provider", "model", "dim", F.size("embedding").alias("size"))


def kb_mismatch(spark, sf_dir):
    """K8: stored collections refuse vectors from another space, a new one takes any that have the length stated."""
    root = scratch_path(spark, "kb")
    ingest(spark, root, _part_records(spark, sf_dir, 3))
    new = cut_lineage(retrieval.hashed_embedding(_part_records(spark, sf_dir, 4), "document"))
    found = None
    for case, changed in {"same": {}, "provider": {"provider": "x"}, "model": {"model": "x"}, "dim": {"dim": 9}}.items():
        space = {"provider": "local", "model": "hashed-terms", "dim": retrieval.EMBEDDING_DIM} | changed
        outcomes = knowledge.space_outcomes(new, read_base(spark, root), **space).withColumn("changed", F.lit(case))
        found = outcomes if found is None else found.unionByName(outcomes)
    return found


def vector_violations(spark, sf_dir):
    docs = kb_documents(spark, sf_dir)
    number = F.substring("id", 2, 8).cast("int")
    broken = F.when(number % 50 == 0, F.slice("embedding", 1, 63)).when(number % 70 != 0, F.col("embedding"))
    return knowledge.vector_violations(docs.withColumn("embedding", broken), 64)


def collection_status(spark, sf_dir):
    names = [f"c{i}" for i in range(12)]
    return knowledge.collection_status(spark, kb_documents(spark, sf_dir), names)


def nearest_documents(spark, sf_dir):
    """Every vector asks for its five nearest in each collection."""
    docs = kb_documents(spark, sf_dir)
    asked = docs.select(F.col("id").alias("query_id"), "embedding")
    hits = retrieval.nearest(asked, docs, 5)
    return hits.select(
        "query_id", "collection", "id", F.col("position").cast("long").alias("position"),
        F.round("distance", 6).alias("distance"),
        F.round(retrieval.relevance(F.col("distance")), 6).alias("relevance_score"),
    )


def nearest_in_cells(spark, sf_dir):
    """K11 by the index: every vector asks for its five nearest in each collection."""
    docs = kb_documents(spark, sf_dir)
    hits = retrieval.nearest_in_cells(docs.select(F.col("id").alias("query_id"), "embedding"), docs, 5)
    return hits.select("query_id", "collection", "id", F.col("position").cast("long").alias("position"),
                       F.round("distance", 6).alias("distance"))


#: What the small model below counts.
_LETTERS = "etaoinsr"


def _letter_model():
    """Loads a model from texts to counts of eight letters."""
    import numpy as np
    letters = np.frombuffer(_LETTERS.encode(), np.uint8)

    def predict(texts):
        counts = [np.bincount(np.frombuffer(t.encode(), np.uint8), minlength=256)[letters] for t in texts]
        return np.array(counts, np.float32).reshape(len(counts), len(letters))
    return predict


def model_embedding(spark, sf_dir):
    """K9: a model of one's own, loaded once a worker."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = models.embedder(_letter_model)(docs, "text")
    return found.select("doc_id", *[F.col("embedding")[i].cast("long").alias(f"n_{c}") for i, c in enumerate(_LETTERS)])


def _faulty_model():
    """Loads a model that fails for every fifth investigation and whose answer is broken for every seventh."""
    def answer(prompts):
        out = []
        for prompt in prompts:
            number = int(json.loads(prompt)["investigation_id"].removeprefix("inv-"))
            if number % 5 == 0:
                raise RuntimeError(f"no answer for {number}")
            out.append("{broken" if number % 7 == 0 else json.dumps({
                "incident_summary": f"answer {number}", "mitre_techniques": ["T1110"], "confidence_level": "Low",
                "incident_next_steps": ["look"], "popia_flags": [], "cybercrimes_flags": [],
                "sa_patterns_matched": [], "rag_sources_used": []}))
        return out
    return answer


def generated_reports(spark, sf_dir):
    """Answers that fail or break the contract become evidence reports, and the job goes on."""
    table = load(spark, sf_dir, "orders").selectExpr(
        "concat('inv-', o_orderkey) as investigation_id", "o_orderkey % 97 as event_count", "o_orderkey % 31 as anomaly_count",
        "o_orderkey % 11 as high_threat_count", "o_orderkey % 101 as max_threat_score", "o_orderkey % 3 as attack_clusters",
        *[f"cast(array() as array<string>) as {c}"
          for c in ("popia_flags", "cybercrimes_flags", "sa_patterns_matched", "technique_ids")])
    prompts = table.select(INV, F.to_json(F.struct(INV, "event_count")).alias("prompt_context"))
    answers = cut_lineage(models.generate_answers(prompts, _faulty_model))
    found = reports.reports_or_fallback(models.parse_answers(answers), reports.evidence_report(table))
    tried = answers.select(INV, F.when(F.col("generation_error").isNotNull(), F.col("attempts")).alias("failed_attempts"))
    return found.join(tried, INV).select(
        INV, F.when(~F.col("mock"), F.col("incident_summary")).alias("answer"), "confidence_level", "generated_by",
        "report_error", "failed_attempts")


def retrieved_context(spark, sf_dir):
    """All collections merged by relevance, one row per query."""
    docs = kb_documents(spark, sf_dir).withColumns({
        "document": F.concat(F.lit("text of "), "id"),
        "metadata": F.create_map(F.lit("id"), F.col("id")),
    })
    queries = docs.select(F.col("id").alias("query_id"), F.col("id").alias("query_used"))
    hits = retrieval.nearest(docs.select(F.col("id").alias("query_id"), "embedding"), docs, 3)
    result = retrieval.retrieval_result(queries, retrieval.retrieved_context(hits), docs)
    return result.select(
        "query_id", "query_used", piped("collections_queried"),
        F.col("total_retrieved").cast("long").alias("total_retrieved"), "rag_available",
        F.array_join(F.transform("retrieved_context", lambda e: e["id"]), "|").alias("ids"),
        F.col("retrieved_context")[0]["content"].alias("first_content"),
    )


def hashed_embedding(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return retrieval.hashed_embedding(docs, "text").select(
        "doc_id", F.size("embedding").alias("dim"),
        F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x), 4).alias("square"),
    )


def _flags_and_top(spark, sf_dir):
    events = cut_lineage(scored(spark, sf_dir))
    return events, regulatory.classify(events), summary.top_events_list(events)


def query_text(spark, sf_dir):
    _, flags, top = _flags_and_top(spark, sf_dir)
    return flags.join(top, INV, "left").select(
        INV,
        retrieval.query_text(F.col("top_threats"), F.col("sa_patterns_matched"), F.col("popia_flags"),
                             F.col("cybercrimes_flags")).alias("query_used"),
    )


def pattern_techniques(spark, sf_dir):
    flags = regulatory.classify(scored(spark, sf_dir))
    found = knowledge.techniques_of_patterns(flags, knowledge.pattern_technique_table(spark))
    return found.select(INV, piped("technique_ids"))


RAW = """
    concat('inv-', doc_id) as investigation_id,
    lang,
    case doc_id % 4 when 0 then true when 1 then false end as rag_available,
    case doc_id % 9
      when 0 then concat('```json\n', body, '\n```')
      when 1 then concat('  ```', body, '```  ')
      when 2 then concat('[', body, ']')
      when 3 then concat(body, '}')
      when 4 then replace(body, '"High"', '"certain"')
      when 5 then replace(body, '"popia_flags":[]', '"popia_flags":"none"')
      when 6 then replace(body, '"rag_sources_used"', '"sources"')
      else body
    end as raw_report
"""
BODY = """concat('{"incident_summary":"document ', doc_id, '","mitre_techniques":["T', 1000 + doc_id % 9000,
    ' (', lang, ')","T12","T1059.001","', source, '"],"confidence_level":"High","incident_next_steps":[',
    array_join(transform(sequence(1, cast(doc_id % 7 as int) + 1), i -> concat('"step ', i, '"')), ','),
    '],"popia_flags":[],"cybercrimes_flags":["X"],"sa_patterns_matched":[],"rag_sources_used":["', source, '"]}')"""


def raw_reports(spark, sf_dir):
    """Model answers, sound and faulty, one per document."""
    docs = load(spark, sf_dir, "documents").withColumn("body", F.expr(BODY))
    return docs.selectExpr(*_split(RAW))


def strip_fence(spark, sf_dir):
    return raw_reports(spark, sf_dir).select(INV, reports.strip_fence(F.col("raw_report")).alias("text"))


def parsed_reports(spark, sf_dir):
    return reports.parse_reports(raw_reports(spark, sf_dir)).select(
        INV, "report_error", "incident_summary", piped("mitre_techniques"), "confidence_level",
        piped("incident_next_steps"), piped("cybercrimes_flags"), piped("rag_sources_used"),
        "generated_by", "mock",
    )


def split_techniques(spark, sf_dir):
    entry = F.expr("""case doc_id % 4 when 0 then concat('T', 1000 + doc_id % 9000, ' (', lang, ')')
        when 1 then concat(' T', 1000 + doc_id % 9000, '.001 ') when 2 then concat('T', doc_id % 1000)
        else source end""")
    parts = load(spark, sf_dir, "documents").select("doc_id", reports.split_technique(entry).alias("t"))
    return parts.select("doc_id", F.col("t.id").alias("technique_id"), F.col("t.name").alias("technique_name"))


def _evidence(spark, sf_dir):
    events = cut_lineage(scored(spark, sf_dir))
    flags = regulatory.classify(events)
    lookup = knowledge.pattern_technique_table(spark)
    return (
        summary.threat_summary(events).withColumn("attack_clusters", F.lit(0).cast("long"))
        .join(flags, INV).join(knowledge.techniques_of_patterns(flags, lookup), INV)
    )


def evidence_reports(spark, sf_dir):
    return reports.evidence_report(_evidence(spark, sf_dir)).select(
        INV, "incident_summary", "confidence_level", piped("incident_next_steps"),
        piped("mitre_techniques"),
    )


def report_fallback(spark, sf_dir):
    """Each document's answer stands for the investigation inv-<doc_id mod 8>, lowest sound first."""
    raw = raw_reports(spark, sf_dir).withColumn("doc_id", F.substring(INV, 5, 20).cast("long"))
    per_doc = reports.parse_reports(raw)
    plain = F.array().cast("array<string>")
    fallback = load(spark, sf_dir, "documents").select(
        F.concat(F.lit("inv-"), "doc_id").alias(INV),
        F.concat(F.lit("fallback "), "doc_id").alias("incident_summary"),
        plain.alias("mitre_techniques"), F.lit("Low").alias("confidence_level"),
        plain.alias("incident_next_steps"), plain.alias("popia_flags"),
        plain.alias("cybercrimes_flags"), plain.alias("sa_patterns_matched"),
        plain.alias("rag_sources_used"), F.lit("evidence-template").alias("generated_by"),
        F.lit(True).alias("mock"),
    )
    return reports.reports_or_fallback(per_doc, fallback).select(
        INV, "incident_summary", "confidence_level", "generated_by", "mock", "report_error"
    )


def prompt_context(spark, sf_dir):
    """Document texts as retrieved content, five entries of 200 characters."""
    docs = load(spark, sf_dir, "documents").withColumn("content", F.regexp_replace("text", "[^A-Za-z ]+", ""))
    entry = lambda i: F.struct(
        F.col("source").alias("source"), F.concat(F.lit(f"{i}-"), F.col("doc_id")).alias("id"),
        "content", F.lit(0.5).alias("relevance_score"),
    )
    evidence = docs.select(
        F.concat(F.lit("inv-"), "doc_id").alias(INV),
        F.struct(F.col("n_chars").alias("event_count")).alias("threat_summary"),
        F.struct(F.col("doc_id").alias("total_nodes")).alias("graph_summary"),
        F.struct(F.col("lang").alias("popia_flags")).alias("sa_result"),
        F.struct(F.lit(True).alias("rag_available"),
                 F.array(*[entry(i) for i in range(6)]).alias("retrieved_context")).alias("rag_context"),
    )
    return reports.prompt_context(evidence, max_entries=5, content_chars=200)


_DUCK_OBJECTS = """
objects AS (
  SELECT event_id AS position, 'attack-pattern--' || user_id AS id, event_type, user_id,
         '  Name ' || user_id || ' ' || event_type || ' ' AS name,
         CAST(event_id // 3 AS VARCHAR) AS modified, event_id % 23 = 0 AS revoked,
         CASE WHEN event_id % 29 = 0 THEN false ELSE event_id % 31 = 0 END AS deprecated, event_id
  FROM events
)"""
_DUCK_NEAREST = """
docs AS (SELECT 'c' || label AS collection, 'd' || lpad(CAST(vec_id AS VARCHAR), 8, '0') AS id,
                CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pairs AS (SELECT q.id AS query_id, d.collection, d.id,
                 list_sum(list_transform(list_zip(q.v, d.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance
          FROM docs q CROSS JOIN docs d),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY distance, id) AS position FROM pairs)"""
_DUCK_BODY = """'{"incident_summary":"document ' || doc_id || '","mitre_techniques":["T' || (1000 + doc_id % 9000)
  || ' (' || lang || ')","T12","T1059.001","' || source || '"],"confidence_level":"High","incident_next_steps":['
  || array_to_string(list_transform(range(1, CAST(doc_id % 7 AS INTEGER) + 2), lambda i: '"step ' || i || '"'), ',')
  || '],"popia_flags":[],"cybercrimes_flags":["X"],"sa_patterns_matched":[],"rag_sources_used":["' || source || '"]}'"""
_DUCK_RAW = f"""
bodies AS (SELECT doc_id, lang, source, {_DUCK_BODY} AS body FROM documents),
raw AS (
  SELECT doc_id, 'inv-' || doc_id AS investigation_id, lang, source, body,
         CASE doc_id % 9
           WHEN 0 THEN '```json' || chr(10) || body || chr(10) || '```'
           WHEN 1 THEN '  ```' || body || '```  '
           WHEN 2 THEN '[' || body || ']'
           WHEN 3 THEN body || '}}'
           WHEN 4 THEN replace(body, '"High"', '"certain"')
           WHEN 5 THEN replace(body, '"popia_flags":[]', '"popia_flags":"none"')
           WHEN 6 THEN replace(body, '"rag_sources_used"', '"sources"')
           ELSE body END AS raw_report
  FROM bodies
),
stripped AS (
  SELECT *, trim(regexp_replace(regexp_replace(trim(raw_report), '^```(json)?', ''), '```$', ''), ' ' || chr(10)) AS text
  FROM raw
),
judged AS (
  SELECT *, CASE
    WHEN NOT json_valid(text) THEN 'report is not valid JSON'
    WHEN json_type(text) <> 'OBJECT' THEN 'report must be a JSON object'
    WHEN NOT json_exists(text, '$.rag_sources_used') THEN 'report misses required keys: rag_sources_used'
    WHEN json_type(text, '$.popia_flags') <> 'ARRAY' THEN 'popia_flags must be a list'
    WHEN json_extract_string(text, '$.confidence_level') NOT IN ('High', 'Medium', 'Low')
         THEN 'confidence_level must be High, Medium, or Low' END AS report_error
  FROM stripped
)"""

CHECKS = {
    "latest_versions": (latest_versions, "WITH " + _DUCK_OBJECTS + """
        SELECT position, id, modified, name FROM (
          SELECT *, row_number() OVER (PARTITION BY id ORDER BY modified DESC, position) AS n FROM objects)
        WHERE n = 1"""),
    "technique_records": (technique_records, "WITH " + _DUCK_OBJECTS + """,
        newest AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY modified DESC, position) AS n
                   FROM objects WHERE event_type <> 'error' AND NOT revoked AND NOT deprecated),
        ready AS (SELECT 'T' || user_id AS id, 'Name ' || user_id || ' ' || event_type AS name, event_type,
                    CASE WHEN event_type < 'discovery' THEN event_type || ', discovery'
                         ELSE 'discovery, ' || event_type END AS tactics,
                    CASE WHEN event_id % 2 = 0 THEN 'Linux' ELSE 'Linux, Windows' END AS platforms
                  FROM newest WHERE n = 1 AND user_id % 13 <> 0)
        SELECT 'mitre_attack' AS collection, id, name, tactics, platforms,
               id || ' | ' || name || ' | seen ' || event_type || ' | runs on ' || platforms
               || ' | serves ' || tactics AS document FROM ready"""),
    "whitespace_normalise": (whitespace, r"""
        SELECT doc_id, trim(regexp_replace(text,
          '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+',
          ' ', 'g')) AS text FROM documents"""),
    "pattern_records": (pattern_records, """
        SELECT 'sa_threat_intel' AS collection, 'P' || p_partkey AS id, p_name AS name,
               CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS sectors, 'T' || p_size || ', T1' AS mitre_technique_ids,
               'P' || p_partkey || ' | ' || p_name || ' | ' || p_type || ' | signs: ' || p_brand || '; size ' || p_size
               || ' | sectors: ' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END
               || ' | techniques: T' || p_size || ', T1 | from survey' AS document FROM part"""),
    "compliance_records": (compliance_records, """
        SELECT 'sa_compliance' AS collection, 'C' || p_partkey AS id, p_brand AS legislation, 's' || p_size AS section,
               p_size || ' days' AS deadline,
               p_brand || ' | s' || p_size || ' | ' || p_name || ' | ' || p_type || ' | applies when: ' || p_type || '; '
               || p_brand || ' | do: report | report to office | within ' || p_size || ' days' AS document FROM part"""),
    "nearest_in_cells": (nearest_in_cells, None),
    "model_embedding": (model_embedding, "SELECT doc_id, " + ", ".join(
        f"CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), '{c}', '')) AS BIGINT) AS n_{c}"
        for c in _LETTERS) + " FROM documents"),
    "generated_reports": (generated_reports, """
        WITH o AS (SELECT o_orderkey AS k, o_orderkey % 5 = 0 AS silent, o_orderkey % 7 = 0 AS broken FROM orders)
        SELECT 'inv-' || k AS investigation_id, CASE WHEN NOT silent AND NOT broken THEN 'answer ' || k END AS answer,
               CASE WHEN NOT silent AND NOT broken THEN 'Low' WHEN k % 101 >= 75 THEN 'High'
                    WHEN k % 101 >= 50 THEN 'Medium' ELSE 'Low' END AS confidence_level,
               CASE WHEN silent OR broken THEN 'evidence-template' ELSE 'report-model' END AS generated_by,
               CASE WHEN silent THEN 'RuntimeError: no answer for ' || k
                    WHEN broken THEN 'report is not valid JSON' END AS report_error,
               CASE WHEN silent THEN 3 END AS failed_attempts FROM o"""),
    "kb_ingested": (kb_ingested, """
        SELECT 'c' || (p_partkey % 3) AS collection, 'P' || p_partkey AS id,
               CASE WHEN p_partkey % 5 = 0 THEN 'new ' ELSE '' END || p_name AS document, p_brand AS brand,
               'local' AS provider, 'hashed-terms' AS model, 256 AS dim, 256 AS size FROM part"""),
    "kb_mismatch": (kb_mismatch, """
        WITH held AS (SELECT DISTINCT 'c' || (p_partkey % 3) AS collection FROM part),
        new AS (SELECT 'c' || (p_partkey % 4) AS collection, count(*) AS documents FROM part GROUP BY ALL)
        SELECT changed, collection, documents,
               CASE WHEN changed <> 'same' AND collection IN (FROM held)
                    THEN 'Vector space mismatch in ' || changed || '; rebuild the collection'
                    WHEN changed = 'dim' THEN 'Embedding dimension differs from 9' END AS outcome
        FROM new, (VALUES ('same'), ('provider'), ('model'), ('dim')) AS t(changed)"""),
    "kb_upsert": (kb_upsert, """
        WITH docs AS (SELECT 'c' || label AS collection, 'd' || lpad(CAST(vec_id AS VARCHAR), 8, '0') AS id, vec_id
                      FROM embeddings)
        SELECT collection, id, CASE WHEN vec_id % 3 = 0 THEN 'new ' || id ELSE id END AS document FROM docs
        UNION ALL SELECT collection, 'x' || id, id FROM docs"""),
    "vector_violations": (vector_violations, """
        SELECT 'c' || label AS collection, count(*) AS documents,
               count(*) FILTER (vec_id % 50 = 0 OR vec_id % 70 = 0) AS violations
        FROM embeddings GROUP BY ALL"""),
    "collection_status": (collection_status, """
        SELECT 'c' || i AS collection, count(label) > 0 AS "exists", count(label) AS document_count
        FROM range(12) t(i) LEFT JOIN embeddings ON label = i GROUP BY ALL"""),
    "nearest_documents": (nearest_documents, "WITH " + _DUCK_NEAREST + """
        SELECT query_id, collection, id, position, round(distance, 6) AS distance,
               round(1 - distance, 6) AS relevance_score FROM hits WHERE position <= 5"""),
    "retrieved_context": (retrieved_context, "WITH " + _DUCK_NEAREST + """
        SELECT query_id, query_id AS query_used,
               array_to_string(list_sort(list_distinct(list(collection))), '|') AS collections_queried,
               count(*) AS total_retrieved, true AS rag_available,
               string_agg(id, '|' ORDER BY 1 - distance DESC, collection, id) AS ids,
               'text of ' || list_extract(list(id ORDER BY 1 - distance DESC, collection, id), 1) AS first_content
        FROM hits WHERE position <= 3 GROUP BY query_id"""),
    "hashed_embedding": (hashed_embedding, r"""
        SELECT doc_id, 256 AS dim,
               CASE WHEN regexp_matches(text, '[\p{L}\p{N}.]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS square
        FROM documents"""),
    "query_text": (query_text, sql.chain(sql.SCORED, sql.flags(), sql.TOP, sql.QUERY_TEXT)
                   + " SELECT * FROM asked"),
    "pattern_techniques": (pattern_techniques, sql.chain(sql.SCORED, sql.flags(), sql.TECHNIQUES) + """
        SELECT investigation_id, coalesce(string_agg(DISTINCT technique_id, '|' ORDER BY technique_id), '') AS technique_ids
        FROM listed LEFT JOIN techniques ON contains('|' || sa_patterns_matched || '|', '|' || pattern || '|')
        GROUP BY ALL"""),
    "strip_fence": (strip_fence, "WITH " + _DUCK_RAW + " SELECT investigation_id, text FROM stripped"),
    "parsed_reports": (parsed_reports, "WITH " + _DUCK_RAW + """
        SELECT investigation_id, report_error,
          CASE WHEN report_error IS NULL THEN 'document ' || doc_id END AS incident_summary,
          CASE WHEN report_error IS NULL THEN array_to_string(list_filter(
            CAST(json_extract(text, '$.mitre_techniques') AS VARCHAR[]),
            lambda t: regexp_matches(trim(t), '^T\\d{4}(\\.\\d{3})?(\\s|\\(|$)')), '|') END AS mitre_techniques,
          CASE WHEN report_error IS NULL THEN 'High' END AS confidence_level,
          CASE WHEN report_error IS NULL THEN array_to_string(list_slice(list_concat(
            CAST(json_extract(text, '$.incident_next_steps') AS VARCHAR[]),
            list_value('No further action identified.', 'No further action identified.',
                       'No further action identified.', 'No further action identified.')), 1, 4), '|') END AS incident_next_steps,
          CASE WHEN report_error IS NULL THEN 'X' END AS cybercrimes_flags,
          CASE WHEN report_error IS NULL THEN CASE WHEN doc_id % 4 = 1 THEN '' ELSE source END END AS rag_sources_used,
          CASE WHEN report_error IS NULL THEN 'report-model' END AS generated_by,
          CASE WHEN report_error IS NULL THEN false END AS mock
        FROM judged"""),
    "split_techniques": (split_techniques, r"""
        WITH e AS (SELECT doc_id, trim(CASE doc_id % 4 WHEN 0 THEN 'T' || (1000 + doc_id % 9000) || ' (' || lang || ')'
             WHEN 1 THEN ' T' || (1000 + doc_id % 9000) || '.001 ' WHEN 2 THEN 'T' || (doc_id % 1000)
             ELSE source END) AS t FROM documents)
        SELECT doc_id, regexp_extract(t, '^(T\d{4}(?:\.\d{3})?)\s*(?:\((.*)\))?$', 1) AS technique_id,
               CASE WHEN regexp_matches(t, '^(T\d{4}(?:\.\d{3})?)\s*(?:\((.*)\))?$')
                    THEN regexp_extract(t, '^(T\d{4}(?:\.\d{3})?)\s*(?:\((.*)\))?$', 2) ELSE t END AS technique_name
        FROM e"""),
    "evidence_reports": (evidence_reports, sql.chain(
        sql.SCORED, sql.flags(), sql.SUMMARY, sql.EVIDENCE, sql.TECHNIQUES) + """
        SELECT d.*, (SELECT coalesce(string_agg(DISTINCT technique_id, '|' ORDER BY technique_id), '') FROM techniques
                     WHERE contains('|' || l.sa_patterns_matched || '|', '|' || pattern || '|')) AS mitre_techniques
        FROM drafted d JOIN listed l USING (investigation_id)"""),
    "report_fallback": (report_fallback, "WITH " + _DUCK_RAW + """
        SELECT investigation_id,
               CASE WHEN report_error IS NULL THEN 'document ' ELSE 'fallback ' END || doc_id AS incident_summary,
               CASE WHEN report_error IS NULL THEN 'High' ELSE 'Low' END AS confidence_level,
               CASE WHEN report_error IS NULL THEN 'report-model' ELSE 'evidence-template' END AS generated_by,
               report_error IS NOT NULL AS mock, report_error
        FROM judged"""),
    "prompt_context": (prompt_context, """
        WITH d AS (SELECT *, substr(regexp_replace(text, '[^A-Za-z ]', '', 'g'), 1, 200) AS c FROM documents)
        SELECT 'inv-' || doc_id AS investigation_id,
          '{"threat_summary":{"event_count":' || n_chars || '},"graph_summary":{"total_nodes":' || doc_id
          || '},"sa_result":{"popia_flags":"' || lang || '"},"rag_context":{"rag_available":true,"retrieved_context":['
          || array_to_string(list_transform(range(5), lambda i: '{"source":"' || source || '","id":"' || i || '-' || doc_id
             || '","content":"' || c || '","relevance_score":0.5}'), ',') || ']}}' AS prompt_context
        FROM d"""),
}
