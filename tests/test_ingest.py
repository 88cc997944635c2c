"""Reading, gates and normalisation."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logvigil.operators.normalise import (
    column_mapping, normalise_logs, normalise_with_quarantine, parse_timestamp, reject_bad_investigations,
    rename_columns, to_bytes, with_event_id,
)
from logvigil.operators.rules import detect_anomalies
from logvigil.plans.registry import QUERIES
from logvigil.sources import logs
from logvigil.sources.knowledge_files import PATTERN_SCHEMA, read_kb_json, read_stix_bundle

INV = "investigation_id"


def test_column_mapping():
    assert column_mapping([" Time ", "SOURCE_IP", "Destination", "Action", "Event"]) == {
        " Time ": "timestamp", "SOURCE_IP": "src_ip", "Destination": "dst_ip", "Action": "event_type"}
    assert column_mapping(["date", "TIMESTAMP", "user_id", "username"]) == {
        "TIMESTAMP": "timestamp", "username": "user_account"}


def test_normalise(spark):
    frame = spark.createDataFrame([
        (" 30/07/2026 14:20:00", " a\u00a0", "b", "c\t", "500", "443.7", "ZA"),
        ("07/08/2026 9:05", "a", "b", "c", "invalid", None, " "),
        ("2026-08-20T19:00:00+02:00", "a", "b", "c", None, "x", "y"),
        ("7/8/2026 1:02:03 PM", "a", "b", "c", "NaN", "99999999999", "y"),
        ("3 Jul 2026 10:00:01", "a", "b", "c", "-1.5", "-7.9", "y"),
        ("", "a", "b", "c", "0", "", "y"),
    ], ["date", "from_ip", "dst", "type", "Size", "dport", "country"])
    out = normalise_logs(frame)
    assert out.columns == ["timestamp", "src_ip", "dst_ip", "event_type", "bytes_transferred", "dst_port", "country"]
    rows = out.collect()
    assert [r.timestamp for r in rows] == [
        datetime(2026, 7, 30, 14, 20), datetime(2026, 7, 8, 9, 5), datetime(2026, 8, 20, 17),
        datetime(2026, 7, 8, 13, 2, 3), datetime(2026, 7, 3, 10, 0, 1), None]
    assert [r.bytes_transferred for r in rows] == [500.0, 0.0, 0.0, 0.0, -1.5, 0.0]
    assert [r.dst_port for r in rows] == [443, 0, 0, 0, -7, 0]
    assert (rows[0].src_ip, rows[0].event_type, rows[1].country) == ("a", "c", "")

    bad = frame.withColumn("date", F.lit("soon"))
    with pytest.raises(Exception, match="Unable to parse one or more timestamp values"):
        normalise_logs(bad).collect()
    kept, aside = normalise_with_quarantine(frame.unionByName(bad))
    assert (kept.count(), aside.count()) == (6, 6)
    many = frame.withColumn(INV, F.lit("good")).unionByName(bad.limit(1).withColumn(INV, F.lit("bad"))).unionByName(
        frame.withColumn(INV, F.lit("bad")))
    kept, rejected = reject_bad_investigations(many)
    assert kept.select(INV).distinct().collect() == [("good",)] and rejected.first().bad_rows == 1
    with pytest.raises(ValueError, match="Missing required columns: dst_ip, event_type$"):
        normalise_logs(frame.select("date", "from_ip"))


def test_timestamp_forms(spark):
    at = datetime(2026, 7, 20, 8)
    forms = {
        "2026-07-20 08:00 AM": at, "20260720": datetime(2026, 7, 20), "20260720T080000": at,
        "7/20/26 8:00": at, "7/30/2026 14:20:00Z": datetime(2026, 7, 30, 14, 20),
        "30/07/2026T14:20:00": datetime(2026, 7, 30, 14, 20), "Mon, 20 Jul 2026 08:00:00 GMT": at,
        "Jul 20 2026 08:00:00": at, "July 20, 2026 08:00": at, "2026-07-20 08:00:00,123": at.replace(microsecond=123_000),
        "20/07/26 10:00:00+02:00": at, "2026-07-20 8:00pm": datetime(2026, 7, 20, 20), "7/8/2026": datetime(2026, 7, 8),
        "13/13/2026": None, "2/30/2026": None, "soon": None, "2026-13-01": None,
    }
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(forms)], "i int, t string")
    found = rows.select("i", parse_timestamp(F.col("t")).alias("t")).orderBy("i").collect()
    assert dict(zip(forms, (r.t for r in found), strict=True)) == forms


def test_numbers(spark):
    texts = ["1d", "1f", "0x1p3", "1e3", " -2.5 ", ".5", "5.", "inf", "-Infinity", "nan", "1_000", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = rows.select("i", to_bytes(F.col("t")).alias("b")).orderBy("i").collect()
    assert [r.b for r in found] == [0, 0, 0, 1000, -2.5, 0.5, 5, float("inf"), float("-inf"), 0, 0, 0, 0]


def test_headers_must_agree(spark, folder):
    (folder / "one.csv").write_text("time,src,dst,type\n2026-01-01,a,b,c\n")
    (folder / "two.csv").write_text("src,time,dst,type\na,2026-01-01,b,c\n")
    with pytest.raises(Exception, match="(?i)header"):
        logs.read_logs(spark, str(folder)).collect()
    (folder / "two.csv").write_text('time,src,dst,type\n2026-01-01,a,b,"two\nlines"\n')
    rows = logs.read_logs(spark, str(folder), multi_line=True).collect()
    assert sorted(r.type for r in rows) == ["c", "two\nlines"]


def test_surplus_cells(spark, folder):
    (folder / "one.csv").write_text('time,src,dst,type\n2026-01-01,a,b,c\n2026-01-01,a,"b,x"\n2026-01-02,a,b,c,d,"e,f"\n')
    with pytest.raises(Exception, match="more cells than the header"):
        logs.read_logs(spark, str(folder)).select("src").collect()
    marked = logs.read_logs(spark, str(folder), surplus="mark")
    assert [tuple(r) for r in marked.select("time", "dst", "type", "reject_reason").collect()] == [
        ("2026-01-01", "b", "c", None), ("2026-01-01", "b,x", None, None), ("2026-01-02", "b", "c", logs.SURPLUS)]


def test_event_ids_cover_maps(spark):
    rows = spark.createDataFrame([("a", {"x": "1"}), ("a", {"x": "2"})], "src string, extra map<string,string>")
    assert with_event_id(rows).select("event_id").distinct().count() == 2


def test_duplicate_names(spark):
    frame = spark.createDataFrame([("1", "2", "3")], ["Src", "src_ip", "x"]).toDF("src", "src_ip", "SRC")
    assert rename_columns(frame).columns == ["src", "src_ip", "SRC__dup1"]


def test_pasted_text(spark):
    documents = spark.createDataFrame([
        ("a", 'Time, SOURCE_IP ,dst,type,country\r\n30/07/2026 14:20:00,1.2.3.4,"5,6","x ""q"" y",ZA\n\n'
              "2026-01-01T00:00:00Z,NA,b,c"),
        ("b", "  \n "), ("c", "time,src\n1,2"), ("d", "timestamp,src_ip,dst_ip,event_type\n1,2,3,4,5"),
        ("e", 'type,time,dst,src\n"two\nlines",2026-01-01,b,a\n'),
    ], f"{INV} string, text string")
    rows, rejected = logs.parse_text_logs(documents)
    got = {(r[INV], r.line_number): r for r in rows.collect()}
    assert set(got) == {("a", 0), ("a", 1), ("e", 0)}
    assert (got["a", 0].dst_ip, got["a", 0].event_type, got["a", 0].extra) == ("5,6", 'x "q" y', {"country": "ZA"})
    assert got["a", 1].src_ip is None and got["a", 1].extra == {"country": None}
    assert (got["e", 0].event_type, got["e", 0].src_ip) == ("two\nlines", "a")
    assert {r[INV]: r.reject_reason for r in rejected.collect()} == {
        "b": "Log text must not be empty", "c": "Missing required columns: dst_ip, event_type",
        "d": "Unable to parse pasted CSV log text"}


def test_log_folder(spark, folder):
    (folder / "one.csv").write_text("time,src,dst,type\n2026-01-01,a,b,c\n2026-01-02,a,b,c\n")
    (folder / "two.CSV").write_text("Action,Source_IP,dest_ip,date,extra\nx,y,z,2026-01-01,e\n")
    (folder / "fake.csv").write_bytes(b"\x89PNG\r\n")
    (folder / "nul.csv").write_bytes(b"time,src\x00,dst,type\n")
    (folder / "latin.csv").write_bytes(b"time,src,dst,type\n2026-01-01,caf\xe9,b,c\n")
    (folder / "short.csv").write_text("time,src\n1,2\n")
    (folder / "notes.txt").write_text("time,src,dst,type\n")
    (folder / "book.xlsx").write_bytes(b"PK\x03\x04")
    (folder / "big.csv").write_bytes(b"a" * (10 * 1024 * 1024 + 1))
    rows, rejected = logs.read_log_files(spark, str(folder))
    assert normalise_logs(rows).groupBy(INV).count().orderBy("count").select("count").collect() == [(1,), (2,)]
    reasons = {r.path.rsplit("/", 1)[1]: r.reject_reason for r in rejected.collect()}
    binary = "CSV upload contains unsupported binary content"
    assert reasons == {
        "latin.csv": "Unable to read .csv log file", "short.csv": "Missing required columns: dst_ip, event_type",
        "fake.csv": binary, "nul.csv": binary, "big.csv": "File exceeds the upload limit",
        "notes.txt": "Unsupported file type. Supported types are .csv, .xlsx and .xls",
        "book.xlsx": "Convert Excel files to CSV first"}
    detected = detect_anomalies(with_event_id(normalise_logs(rows)), forest=True)
    assert sorted(r.extra.get("extra", "") for r in detected.collect()) == ["", "", "e"]
    one = logs.read_logs(spark, str(folder / "one.csv"))
    assert with_event_id(one).select("event_id").distinct().count() == 2
    assert one.columns == ["time", "src", "dst", "type"] and one.count() == 2


def test_names(spark):
    paths = ["C:\\a\\b.CSV ", "../../x.xlsx", "dir/", "..", "", None, ".csv", "a.txt"]
    rows = logs.with_provenance(spark.createDataFrame([(p,) for p in paths], "path string")).collect()
    assert [(r.filename, r.upload_source) for r in rows] == [
        ("b.CSV", "csv"), ("x.xlsx", "excel"), ("dir", None), (None, None), (None, None), (None, None),
        (".csv", None), ("a.txt", None)]
    gate = logs.size_gate(spark.createDataFrame([("x" * 50_000,), ("x" * 50_001,)], "text string"))
    assert [r.size_reason is None for r in gate.collect()] == [True, False]


def test_knowledge_files(spark, folder):
    good, single, broken, mixed, bundle = (folder / n for n in ("g", "s", "b", "m", "x"))
    good.write_text('[{"id": "a", "indicators": ["x"]}, {"id": "b"}]')
    single.write_text('{"id": "a"}')
    broken.write_text('[{"id": ')
    mixed.write_text('[{"id": "a"}, 3]')
    assert [r.id for r in read_kb_json(spark, str(good), PATTERN_SCHEMA).collect()] == ["a", "b"]
    for path, message in ((single, "array of objects"), (broken, "invalid JSON"), (mixed, "array of objects")):
        with pytest.raises(Exception, match=message):
            read_kb_json(spark, str(path), PATTERN_SCHEMA).collect()
    bundle.write_text('{"objects": [{"id": "x", "type": "attack-pattern"}, {"id": "y"}]}')
    assert [(r.position, r.id) for r in read_stix_bundle(spark, str(bundle)).collect()] == [(0, "x"), (1, "y")]
    bundle.write_text('{"other": 1}')
    with pytest.raises(Exception, match="objects array"):
        read_stix_bundle(spark, str(bundle)).collect()


def test_bundles_by_line(spark, folder):
    """Many bundles in few files: one a line, each with its own places."""
    bundles = folder / "lines"
    bundles.write_text('{"objects": [{"id": "a"}, {"id": "b"}]}\n{"objects": [{"id": "c"}]}\n')
    rows = read_stix_bundle(spark, str(bundles), lines=True).collect()
    assert sorted((r.position, r.id) for r in rows) == [(0, "a"), (0, "c"), (1, "b")]
    for wrong in ('{"objects": []}\n{"other": 1}\n', '{"objects": []}\n{"objects": [\n'):
        bundles.write_text(wrong)
        with pytest.raises(Exception):
            read_stix_bundle(spark, str(bundles), lines=True).collect()


@pytest.mark.parametrize("name", ["normalised_logs", "pasted_logs", "rejected_texts", "quarantined_rows", "csv_round_trip"])
def test_generated_code_compiles(spark, name):
    """No fall-back to interpreted expressions because a method grew too large."""
    spark.conf.set("spark.sql.codegen.fallback", "false")
    spark.conf.set("spark.sql.codegen.factoryMode", "CODEGEN_ONLY")
    try:
        assert QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    finally:
        spark.conf.set("spark.sql.codegen.fallback", "true")
        spark.conf.set("spark.sql.codegen.factoryMode", "FALLBACK")
