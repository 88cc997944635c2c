"""Knowledge base, retrieval and reports."""

import json
import re

import numpy as np
import pytest
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.sql import functions as F

from logvigil.constants import STEP_PADDING
from logvigil.operators import knowledge, models, reports, retrieval
from logvigil.plans import checks_knowledge, knowledge_base
from logvigil.plans.investigate import retrieve

INV = "investigation_id"


def test_records(spark):
    patterns = spark.createDataFrame(
        [("P", "Name", "What.", ["i1", "i2"], ["s"], ["T1", "T2"], "src")],
        "id string, name string, description string, indicators array<string>, sector array<string>, "
        "mitre_technique_ids array<string>, source string")
    row = knowledge.pattern_records(patterns).first()
    assert row.document == (
        "P | Name | What. | signs: i1; i2 | sectors: s | techniques: T1, T2 | from src")
    assert row.metadata["mitre_technique_ids"] == "T1, T2"
    rules = spark.createDataFrame(
        [("C", "Act", "s1", "Title", "Sum.", ["a", "b"], "Do.", "Body", "soon")],
        "id string, legislation string, section string, title string, summary string, "
        "trigger_conditions array<string>, required_action string, reporting_body string, deadline string")
    assert knowledge.compliance_records(rules).first().document == (
        "Act | s1 | Title | Sum. | applies when: a; b | do: Do. | report to Body | within soon")


def test_upsert_does_not_depend_on_order(spark):
    schema = "collection string, id string, document string, line int"
    new = [("c", "a", "one", 1), ("c", "a", "two", 2), ("c", "b", "x", 1), ("c", "b", "y", 1)]
    current = spark.createDataFrame([("c", "a", "old", 0), ("c", "z", "kept", 0)], schema).drop("line")
    for rows in (new, new[::-1]):
        out = knowledge.upsert(current, spark.createDataFrame(rows, schema), position="line")
        assert sorted(map(tuple, out.collect())) == [("c", "a", "two"), ("c", "b", "y"), ("c", "z", "kept")]


def test_ingested_rows_are_dealt_by_number(spark, folder, monkeypatch):
    """No task writes more than a few times ROWS documents, however small their vectors are in files."""
    monkeypatch.setattr(knowledge_base, "ROWS", 50)
    records = spark.range(1000).select(
        F.lit("c").alias("collection"), F.concat(F.lit("p"), "id").alias("id"), F.lit("same words").alias("document"),
        F.create_map(F.lit("k"), F.lit("v")).alias("metadata"))
    for _ in range(2):
        knowledge_base.ingest(spark, str(folder / "kb"), records)
        base = knowledge_base.read_base(spark, str(folder / "kb"))
        assert base.count() == base.select("id").distinct().count() == 1000
        assert base.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= 500


def test_prompt_content_is_made_once(spark):
    plan = checks_knowledge.prompt_context(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1


def test_hits_move_once(spark):
    """A query's hits are moved once for the ranks in each collection and over all of them."""
    docs = spark.range(40).select(F.lit("c").alias("collection"), F.concat(F.lit("d"), "id").alias("id"),
                                  F.array(F.col("id").cast("double")).alias("embedding"))
    hits = retrieval.retrieved_context(retrieval.nearest(docs.select(F.col("id").alias("query_id"), "embedding"), docs, 3))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(query_id#\d+", plan)) == 1
    assert hits.groupBy("query_id").count().where("count <> 3").isEmpty()


def test_other_space_is_unavailable(spark):
    docs = spark.createDataFrame([("c", "a", "text", {"k": "v"}, [1.0, 0.0])],
                                 "collection string, id string, document string, metadata map<string,string>, "
                                 "embedding array<float>")
    queries = spark.createDataFrame([("q", "text")], "query_id string, query_used string")
    row = retrieve(queries, docs).first()
    assert (row.rag_available, row.total_retrieved) == (False, 0)


def test_vector_space(spark):
    docs = spark.createDataFrame([("c", "a", [1.0, 2.0])], "collection string, id string, embedding array<float>")
    knowledge.check_vector_space(docs, {}, "p", "m", 2)
    with pytest.raises(ValueError, match="dimension"):
        knowledge.check_vector_space(docs, {}, "p", "m", 3)
    with pytest.raises(ValueError, match="model"):
        knowledge.check_vector_space(docs, {"provider": "p", "model": "old", "dim": 2}, "p", "m", 2)


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = rng.integers(-3, 4, size=(90, 8)).astype(float)   # many equal distances
    docs = spark.createDataFrame(
        [("big" if i < 70 else "small" if i < 88 else "tiny", f"d{i:02d}", v.tolist()) for i, v in enumerate(vectors)],
        "collection string, id string, embedding array<double>")
    asked = spark.createDataFrame(
        [(f"q{i:02d}", rng.integers(-3, 4, size=8).astype(float).tolist()) for i in range(25)],
        "query_id string, embedding array<double>")
    names = [r.collection for r in docs.orderBy("id").collect()]
    expected = []
    for q in asked.collect():
        far = ((vectors - np.array(q.embedding)) ** 2).sum(1)
        for name in ("big", "small", "tiny"):
            best = sorted((far[i], f"d{i:02d}") for i in range(90) if names[i] == name)[:4]
            expected += [(q.query_id, name, d, n + 1, f) for n, (f, d) in enumerate(best)]
    for chunks, blocks in ((1, 1), (3, 4)):
        hits = retrieval.nearest(asked, docs, 4, query_chunks=chunks, doc_blocks=blocks).collect()
        got = sorted((h.query_id, h.collection, h.id, h.position, round(h.distance, 6)) for h in hits)
        assert got == sorted(expected)
    for wrong in (0, 11):
        with pytest.raises(ValueError):
            retrieval.nearest(asked, docs, wrong)
    with pytest.raises(TypeError):
        retrieval.nearest(asked, docs, True)


def test_nearest_in_cells(spark):
    """Recall against the exact path, many queries a cell, cells in blocks, and exactness where all cells are asked."""
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(900, 16)) + np.repeat(rng.normal(size=(30, 16)) * 2, 30, axis=0)
    docs = spark.createDataFrame([(f"c{i % 2}", f"d{i:03d}", v.tolist()) for i, v in enumerate(vectors)],
                                 "collection string, id string, embedding array<double>")
    asked = docs.where("id < 'd300'").select(F.col("id").alias("query_id"), "embedding")
    key = lambda hits: {(h.query_id, h.collection, h.id, h.position) for h in hits.collect()}
    exact = key(retrieval.nearest(asked, docs, 5))
    got = {x[:3] for x in key(retrieval.nearest_in_cells(asked, docs, 5))}
    assert len(got & {x[:3] for x in exact}) >= 0.9 * len(exact)
    retrieval._CELL_QUERIES, retrieval._DOC_BLOCK, before = 40, 30, (retrieval._CELL_QUERIES, retrieval._DOC_BLOCK)
    try:
        assert key(retrieval.nearest_in_cells(asked, docs, 5, cells=6, probes=6)) == exact
    finally:
        retrieval._CELL_QUERIES, retrieval._DOC_BLOCK = before
    assert retrieval.nearest_in_cells(asked, docs.limit(0), 5).collect() == []


def test_queries_move_once_a_block(spark, monkeypatch):
    """A query that asks many cells moves once a block of them, not once a cell and collection."""
    rng = np.random.default_rng(4)
    docs = spark.createDataFrame([(f"c{i % 4}", f"d{i:03d}", v.tolist()) for i, v in enumerate(rng.normal(size=(400, 8)))],
                                 "collection string, id string, embedding array<double>")
    asked = docs.select(F.col("id").alias("query_id"), "embedding")
    rows, cut = [], retrieval.cut_lineage

    def counted(df):
        table = cut(df)
        if "query_id" in table.columns:
            rows.append(table.count())
        return table

    monkeypatch.setattr(retrieval, "cut_lineage", counted)
    monkeypatch.setattr(retrieval, "_DOC_BLOCK", 100)
    hits = {tuple(h)[:3] for h in retrieval.nearest_in_cells(asked, docs, 3, cells=20, probes=20).collect()}
    assert hits == {tuple(h)[:3] for h in retrieval.nearest(asked, docs, 3).collect()}
    assert sum(rows) <= 400 * (2 * spark.sparkContext.defaultParallelism + 8)


def test_space_outcomes(spark):
    docs = spark.createDataFrame([("a", [1.0, 2.0]), ("a", None), ("b", [1.0, 2.0]), ("c", [1.0, 2.0])],
                                 "collection string, embedding array<double>")
    base = spark.createDataFrame([("b", "p", "m", 2), ("c", "q", "n", 3)],
                                 "collection string, provider string, model string, dim int")
    got = {r.collection: (r.documents, r.outcome) for r in knowledge.space_outcomes(docs, base, "p", "m", 2).collect()}
    assert got == {"a": (2, "Embedding dimension differs from 2"), "b": (1, None),
                   "c": (1, "Vector space mismatch in provider, model, dim; rebuild the collection")}


def test_embedder_takes_a_transformer(spark):
    docs = spark.createDataFrame([("a b",), (None,)], "t string")
    found = models.embedder(Vowels(inputCol="words", outputCol="vector"))(docs, "t").collect()
    assert [r.embedding for r in found] == [[1.0], [0.0]] and found[0].asDict().keys() == {"t", "embedding"}


class Vowels(Transformer, HasInputCol, HasOutputCol):
    def __init__(self, inputCol, outputCol):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _transform(self, df):
        vowels = F.length(self.getInputCol()) - F.length(F.translate(self.getInputCol(), "aeiou", ""))
        return df.withColumn(self.getOutputCol(), array_to_vector(F.array(vowels.cast("double"))))


def test_generation_outcomes(spark):
    """Faults stay with their row: always failing, failing once, a missing answer, a short batch."""
    def load():
        seen = set()

        def model(prompts):
            if len(prompts) == 3 and "short" in prompts:
                return ["x"]
            out = []
            for p in prompts:
                if p == "never" or (p == "once" and (len(prompts) > 1 or p not in seen)):
                    if len(prompts) == 1:
                        seen.add(p)
                    raise RuntimeError(p)
                out.append(None if p == "none" else f"<{p}>")
            return out
        return model

    def run(prompts, **kw):
        rows = spark.createDataFrame(list(enumerate(prompts)), f"{INV} int, prompt_context string").coalesce(1)
        return [tuple(r)[1:] for r in models.generate_answers(rows, load, **kw).orderBy(INV).collect()]

    assert run(["a", "b"]) == [("<a>", None, 1), ("<b>", None, 1)]
    assert run(["a", "never", "once", "d"]) == [
        ("<a>", None, 2), (None, "RuntimeError: never", 3), ("<once>", None, 3), ("<d>", None, 2)]
    assert run(["a", "never"], batch_size=1) == [("<a>", None, 1), (None, "RuntimeError: never", 3)]
    assert run(["none"]) == [(None, "no answer", 1)]
    assert run(["short", "b", "c"]) == [("<short>", None, 2), ("<b>", None, 2), ("<c>", None, 2)]
    assert run([]) == []


def test_context_order_and_absence(spark):
    hits = spark.createDataFrame(
        [("q", "sa_compliance", "C1", 0.1), ("q", "mitre_attack", "T2", 0.6), ("q", "mitre_attack", "T1", 0.2),
         ("q", "sa_threat_intel", "P", None)], "query_id string, collection string, id string, distance double")
    docs = hits.select("collection", "id", F.col("id").alias("document"), F.create_map("id", "id").alias("metadata"))
    queries = spark.createDataFrame([("q", "x"), ("none", "y")], "query_id string, query_used string")
    got = {r.query_id: r for r in retrieval.retrieval_result(
        queries, retrieval.retrieved_context(hits), docs).collect()}
    assert [e["id"] for e in got["q"].retrieved_context] == ["C1", "T1", "T2", "P"]
    assert got["q"].retrieved_context[0]["relevance_score"] == pytest.approx(0.9)
    assert got["q"].retrieved_context[3]["relevance_score"] == 0.0
    assert (got["none"].rag_available, got["none"].total_retrieved, got["none"].collections_queried) == (False, 0, [])


def test_query_text(spark):
    schema = ("top array<struct<threat_signals:array<string>,anomaly_reasons:array<string>,event_type:string>>, "
              "p array<string>, o array<string>, c array<string>")
    rows = [([([" Off-hours ", ""], ["OFF"], "Login"), (None, ["off"], " login ")], ["P"], ["O"], ["p", "C"]),
            ([], [], None, []), (None, None, None, None)]
    text = spark.createDataFrame(rows, schema).select(retrieval.query_text(*[F.col(c) for c in "top p o c".split()]))
    assert [r[0] for r in text.collect()] == [
        "Off-hours, OFF, Login, P, O, C", "Cybersecurity incident investigation",
        "Cybersecurity incident investigation"]


def test_embedding(spark):
    docs = spark.createDataFrame([("brute force login",), ("login force brute",), ("other",), (None,)], "t string")
    a, b, c, d = (r.embedding for r in retrieval.hashed_embedding(docs, "t").collect())
    assert a == b != c and len(a) == retrieval.EMBEDDING_DIM and sum(x * x for x in a) == pytest.approx(1, abs=1e-5)
    assert len(d) == len(a)


GOOD = {"incident_summary": "s", "mitre_techniques": ["T1078 (Valid)", "T10", 5, " T1566.001", None, "T1078x"],
        "confidence_level": "High", "incident_next_steps": ["a"], "popia_flags": [], "cybercrimes_flags": [],
        "sa_patterns_matched": [], "rag_sources_used": ["KB"]}


def test_parse_reports(spark):
    def text(**changes):
        return json.dumps({**GOOD, **changes})
    cases = {
        "fenced": (f"```json\n{text()}\n```", None), "spaced": (f"  ```{text()}``` ", None),
        "many": (text(incident_next_steps=list("abcdef")), None),
        "words": ("not json", "valid JSON"), "tail": (text() + "}", "valid JSON"),
        "two": (text() + "," + text(), "valid JSON"), "empty": ("", "valid JSON"),
        "list": ("[1]", "JSON object"), "level": (text(confidence_level="high"), "confidence_level"),
        "number": (text(incident_summary=5), "incident_summary must be a string"),
        "nolist": (text(popia_flags="x"), "popia_flags must be a list"),
        "null": (text(popia_flags=None), "popia_flags must be a list"),
        "missing": ('{"incident_summary": "x"}', "keys: confidence_level, cybercrimes_flags"),
    }
    raw = spark.createDataFrame([(k, t, k == "spaced" or None) for k, (t, _) in cases.items()],
                                f"{INV} string, raw_report string, rag_available boolean")
    raw = raw.withColumn("rag_available", F.when(F.col(INV) == "fenced", False).otherwise(F.col("rag_available")))
    got = {r[INV]: r for r in reports.parse_reports(raw).collect()}
    for name, (_, error) in cases.items():
        assert (got[name].report_error is None) == (error is None), (name, got[name].report_error)
        assert error is None or error in got[name].report_error
    assert got["fenced"].mitre_techniques == ["T1078 (Valid)", " T1566.001"]
    assert got["fenced"].incident_next_steps == ["a"] + [STEP_PADDING] * 3
    assert got["many"].incident_next_steps == list("abcd")
    assert got["fenced"].rag_sources_used == [] and got["spaced"].rag_sources_used == ["KB"]
    assert got["many"].rag_sources_used == ["KB"] and got["many"].mock is False
    assert got["words"].incident_summary is None
