"""The stored investigations and the whole flow."""

import json
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from logvigil.operators import investigations as store
from logvigil.operators.retrieval import hashed_embedding
from logvigil.plans.adapter import telemetry_of
from logvigil.plans.checks_store import uploads
from logvigil.plans.investigate import investigate
from logvigil.plans.regenerate import regenerate
from logvigil.session import cut_lineage, shared_dir, stage_scope
from logvigil.sources.sinks import text_report, to_json_rows
from logvigil.sources.store import BUCKETS, CHILD_TABLES, InvestigationStore, write_investigations

INV = "investigation_id"


@pytest.fixture(scope="module")
def table(spark):
    rows = [(f"i{n:02d}", "me" if n < 12 else "you", f"File{n}.csv", datetime(2026, 1, 1 + n), n, n % 3, n % 2)
            for n in range(15)]
    return spark.createDataFrame(
        rows, f"{INV} string, user_id string, filename string, created_at timestamp, event_count long, "
              "high_threat_count long, attack_clusters long").cache()


def test_paging(table):
    page = store.list_page(table, "me", page=2, page_size=5).collect()
    assert [r[INV] for r in page] == ["i06", "i05", "i04", "i03", "i02"]
    totals = store.page_totals(table, "me", page=3, page_size=5).first()
    assert (totals.total, totals.total_pages, totals.first_row, totals.last_row) == (12, 3, 11, 12)
    none = store.page_totals(table, "nobody").first()
    assert (none.total, none.total_pages, none.first_row, none.last_row) == (0, 0, 0, 0)
    by_threat = store.list_page(table, "me", sort_by="high_threat_count", descending=False, page_size=3).collect()
    assert [r[INV] for r in by_threat] == ["i00", "i03", "i06"]
    for wrong in (dict(page=0), dict(page_size=51), dict(sort_by="filename")):
        with pytest.raises(ValueError):
            store.list_page(table, "me", **wrong)


def test_pages_by_cursor(spark, table):
    rows = table.withColumn("created_at", F.when(F.col("event_count") % 5 != 0, F.date_trunc("week", "created_at")))
    for sort_by in ("created_at", "high_threat_count"):
        for descending in (True, False):
            expected = [r[INV] for r in store.list_page(rows, "me", page_size=50, sort_by=sort_by, descending=descending).collect()]
            last, got = None, []
            while page := store.list_after(rows, "me", last, 5, sort_by, descending).select(sort_by, INV).collect():
                got += [r[INV] for r in page]
                last = tuple(page[-1])
            assert got == expected and len(got) == 12


def test_ownership(table):
    assert store.detail(table, "me", "i03").count() == 1 and store.detail(table, "you", "i03").count() == 0
    assert store.without(table, "you", "i03").count() == 15 and store.without(table, "me", "i03").count() == 14
    assert store.filename_contains(table, "fILE1").count() == 6 and store.filename_contains(table, " ").count() == 15


def test_store_survives(spark, table, folder):
    keep = InvestigationStore(spark, str(folder / "s"))
    with pytest.raises(ValueError):
        keep.read()
    main = table.withColumn("user_id", F.concat("user_id", F.lit("/a=b")))
    events = main.select(INV, F.lit(1).alias("event_id"))
    lost = events.limit(1).withColumn(INV, F.lit("unknown"))
    rejects = keep.write({"investigations": main, "events": events.unionByName(lost)})
    assert [tuple(r) for r in rejects.collect()] == [("events", "unknown", 1)]
    # a writer that died leaves its staging folder
    (folder / "s" / "investigations" / ".spark-staging-dead" / "user_id=x").mkdir(parents=True)
    assert keep.read().count() == 15 and keep.read("events").count() == 15
    keep.write({"investigations": main.limit(2), "events": events.limit(0)})
    assert keep.read().count() == 15 and keep.read("events").count() == 13
    one = keep.detail("me/a=b", "i03").collect()
    assert [r[INV] for r in one] == ["i03"] and keep.detail("you/a=b", "i03").count() == 0
    assert keep.detail("me/a=b", "i03", "events").count() == 1
    keep.delete(main.where(F.col("user_id") == "you/a=b"))
    assert keep.read().count() == 12 and {r.user_id for r in keep.read("events").collect()} == {"me/a=b"}
    keep.delete(main)
    assert keep.read().count() == keep.read("events").count() == 0
    assert set(keep.read().columns) == set(main.columns)
    keep.write({"investigations": main.withColumn("user_id", F.lit("007")), "events": events})
    assert {r.user_id for r in keep.read().collect()} == {"007"} and keep.read("events").count() == 15


def jobs_of(spark, name, action):
    spark.sparkContext.setJobGroup(name, name)
    try:
        action()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_changes_are_set_operations(spark, folder):
    """As many jobs and no more folders for two thousand investigations as for a few."""
    def run(n, name):
        keep = InvestigationStore(spark, str(folder / name))
        main = cut_lineage(spark.range(n).select(
            F.concat(F.lit("i"), "id").alias(INV), F.concat(F.lit("u"), F.col("id") % 3).alias("user_id"),
            F.lit("a").alias("incident_summary"), F.array(F.lit("x")).alias("incident_next_steps"),
            F.array(F.lit("x")).alias("mitre_techniques"), F.array(F.lit("x")).alias("rag_sources_used"),
            F.lit(None).cast("timestamp").alias("regenerated_at"), F.lit(None).cast("string").alias("report_error")))
        events = main.select(INV, F.lit(1).alias("event_id"))
        rows = main.drop("report_error")
        jobs = [
            jobs_of(spark, f"{name} write", lambda: keep.write({"investigations": rows, "events": events})),
            jobs_of(spark, f"{name} regenerate", lambda: keep.regenerate(
                main.withColumn("incident_summary", F.lit("b")), F.lit("2026-01-01").cast("timestamp"))),
            jobs_of(spark, f"{name} delete", lambda: keep.delete(rows.where(F.col("user_id") != "u1"))),
        ]
        assert keep.read().count() == keep.read("events").count() == len(range(1, n, 3))
        assert {r.incident_summary for r in keep.read().collect()} == {"b"}
        return jobs, len(list((folder / name / "events").glob("user_id=*/bucket=*")))

    few, _ = run(48, "few")
    many, folders = run(2000, "many")
    assert folders <= 3 * BUCKETS
    assert all(m <= f + 2 for f, m in zip(few, many, strict=True))


def test_deletes_do_not_shuffle_what_stays(spark, folder, monkeypatch):
    main = spark.range(300).selectExpr("concat('i', id) as investigation_id", "concat('u', id % 3) as user_id")
    events = main.selectExpr("investigation_id", "explode(array(1, 2)) as event_id")
    keep = InvestigationStore(spark, str(folder / "s"))
    keep.write({"investigations": main, "events": events})
    hints, hint = [], type(main).hint
    monkeypatch.setattr(type(main), "hint", lambda df, name, *a: (hints.append(name), hint(df, name, *a))[1])
    for start in ("i1%", "i2%"):
        keep.delete(main.where(f"investigation_id like '{start}'"))
    assert "rebalance" not in hints
    left = {r.investigation_id for r in main.collect() if r.investigation_id[1] not in "12"}
    assert sorted(r.investigation_id for r in keep.read().collect()) == sorted(left)
    assert sorted(r.investigation_id for r in keep.read("events").collect()) == sorted([*left, *left])


def test_json_rows(spark):
    frame = spark.createDataFrame(
        [(datetime(2026, 1, 1, 10), float("nan"), [1.0, float("nan")], None, {"a": datetime(2026, 1, 1, 0, 0, 0, 5)})],
        "t timestamp, x double, l array<double>, s struct<y:double>, m map<string,timestamp>")
    assert json.loads(to_json_rows(frame).first().value) == {
        "t": "2026-01-01T10:00:00+00:00", "x": None, "l": [1.0, None], "s": None,
        "m": {"a": "2026-01-01T00:00:00.000005+00:00"}}


def model(prompts):
    """A stand-in for a remote model: sound for the first investigation only."""
    good = json.dumps({"incident_summary": "from model", "mitre_techniques": ["T1110"], "confidence_level": "Low",
                       "incident_next_steps": ["x"], "popia_flags": [], "cybercrimes_flags": [],
                       "sa_patterns_matched": [], "rag_sources_used": ["SA Threat Intelligence"]})
    assert prompts.columns == [INV, "prompt_context"]
    return prompts.select(INV, F.when(F.col(INV) == "inv-0", good).otherwise("sorry").alias("raw_report"))


def test_investigate_store_regenerate(spark, folder):
    events = telemetry_of(spark, "/root/testdata/sf0.001")
    docs = hashed_embedding(spark.createDataFrame(
        [("sa_threat_intel", "P1", "brute force authentication", {"k": "v"}), ("mitre_attack", "T1", "port scan", {})],
        "collection string, id string, document string, metadata map<string,string>"), "document")
    tables = investigate(events, uploads(events), docs, generate=model)
    rejects = write_investigations({k: tables[k] for k in ["investigations", *CHILD_TABLES]}, str(folder))
    assert rejects.count() == 0
    keep = InvestigationStore(spark, str(folder))
    stored = {r[INV]: r for r in keep.read().collect()}
    assert set(stored) == {"inv-0", "inv-1"}
    assert stored["inv-0"].incident_summary == "from model"
    assert stored["inv-0"].rag_sources_used == ["SA Threat Intelligence"]
    assert stored["inv-1"].incident_summary.startswith("350 events were analysed")
    faults = {r[INV]: r.report_error for r in tables["reports"].collect()}
    assert faults == {"inv-0": None, "inv-1": "report is not valid JSON"}
    for name in CHILD_TABLES:
        assert keep.read(name).count() == tables[name].count() > 0
    scored = keep.read("events")
    assert scored.count() == 1000
    assert 0.03 < scored.where("ml_is_anomaly").count() / 1000 < 0.07
    report = text_report(store.incident_view(keep.read())).collect()
    asked = spark.createDataFrame(
        [("owner", "inv-0"), ("owner", "inv-1"), ("stranger", "inv-0")], f"user_id string, {INV} string")
    faults = regenerate(keep, asked, lambda p: model(p).withColumn(
        "raw_report", F.replace("raw_report", F.lit("from model"), F.lit("asked again"))),
        F.lit("2026-02-01 00:00:00").cast("timestamp"))
    assert {r[INV]: r.report_error for r in faults.collect()} == {"inv-0": None, "inv-1": "report is not valid JSON"}
    again = {r[INV]: r for r in keep.read().collect()}
    assert again["inv-0"].incident_summary == "asked again" and again["inv-0"].rag_sources_used == []
    assert again["inv-0"].regenerated_at == datetime(2026, 2, 1) and again["inv-1"].regenerated_at is None
    assert again["inv-1"].incident_summary == stored["inv-1"].incident_summary
    assert keep.read("events").count() == 1000
    assert all(r.report.startswith("INVESTIGATION SUMMARY SHEET\n\nInvestigation ID: inv-") for r in report)


def test_stage_scope(spark, folder):
    with stage_scope(spark):
        kept = cut_lineage(spark.range(5))
        files = kept.inputFiles()
        assert kept.count() == 5
    assert not any(Path(f.removeprefix("file://")).exists() for f in files)


def test_shared_folder(spark):
    assert shared_dir(spark) == spark.sparkContext.getCheckpointDir()
