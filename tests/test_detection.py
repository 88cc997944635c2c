"""Rules, scoring, flags and summary on small cases."""

import ipaddress
import random
from collections import deque
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from logvigil.constants import POPIA_FLAGS
from logvigil.functions.network import cross_border
from logvigil.functions.text import strip
from logvigil.operators import forest
from logvigil.operators.features import BURSTS, SOURCE, burst_spans, hourly_ports, source_ledger, sparse_burst_spans
from logvigil.operators.forest import isolation_forest
from logvigil.operators.features import with_source_context
from logvigil.operators.graph import graph_edges, graph_nodes, graph_summary
from logvigil.operators.regulatory import classify, investigation_flags
from logvigil.operators.rules import detect_anomalies, prepare
from logvigil.operators.scoring import score_threats
from logvigil.operators.summary import (
    distribution_shares, events_at_level, threat_summary, top_events, top_events_list,
)
from logvigil.session import cut_lineage

INV = "investigation_id"
LOG = (f"{INV} string, event_id long, timestamp timestamp, src_ip string, dst_ip string, "
       "event_type string, dst_port int, bytes_transferred double")
DAY = datetime(2026, 3, 2, 12, 0, 0)


def log_frame(spark, rows):
    """rows: (source, seconds after noon, and any of the other columns)"""
    out = []
    for i, row in enumerate(rows):
        at = None if row["at"] is None else DAY + timedelta(seconds=row["at"])
        out.append((row.get("inv", "i"), i, at, row["src"], row.get("dst", "10.0.0.1"),
                    row.get("type", "x"), row.get("port", 0), float(row.get("bytes", 1.5))))
    return spark.createDataFrame(out, LOG)


def reasons(frame, **kw):
    rows = detect_anomalies(frame, **kw).select("event_id", "anomaly_reasons").collect()
    return {r.event_id: r.anomaly_reasons for r in rows}


def test_golden_log(spark):
    stamp = "2026-08-20 19:0{}".format
    rows = [("0:00", "10.0.0.12", "login_failed", "admin", "PC-001", 120.0),
            ("0:05", "10.0.0.12", "login_failed", "admin", "PC-001", 120.0),
            ("0:09", "10.0.0.12", "login_failed", "admin", "PC-001", 120.0),
            ("0:15", "10.0.0.12", "port_scan", "admin", "PC-001", 800.0),
            ("0:30", "10.0.0.12", "login_failed", "admin", "PC-001", 120.0),
            ("1:00", "10.0.0.15", "file_access", "jdoe", "PC-002", 2400.0)]
    frame = spark.createDataFrame(
        [("g", i, stamp(t), "196.25.10.5", *rest, 0) for i, (t, *rest) in enumerate(rows)],
        f"{INV} string, event_id long, timestamp string, src_ip string, dst_ip string, event_type string, "
        "user_account string, device_id string, bytes_transferred double, dst_port int",
    ).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    scored = score_threats(detect_anomalies(frame)).cache()
    got = [(r.threat_score, r.threat_level, r.anomaly_reasons) for r in scored.orderBy("event_id").collect()]
    assert got == [(30, "Medium", ["RAPID_SUCCESSION"])] * 5 + [
        (55, "High", ["AMOUNT_SPIKE", "RAPID_SUCCESSION"])]
    nodes, edges = graph_nodes(scored), graph_edges(scored)
    assert {r.node_id: r.is_suspicious for r in nodes.collect()} == {
        "ip:196.25.10.5": True, "ip:10.0.0.12": False, "ip:10.0.0.15": True,
        "user_account:admin": False, "user_account:jdoe": True,
        "device_id:PC-001": False, "device_id:PC-002": True}
    assert sorted((r.target, r.event_count, r.total_bytes, r.dominant_event_type) for r in edges.collect()) == [
        ("ip:10.0.0.12", 5, 1280.0, "login_failed"), ("ip:10.0.0.15", 1, 2400.0, "file_access")]
    summary = threat_summary(scored).first()
    assert (summary.medium, summary.high, summary.critical, summary.anomaly_count) == (5, 1, 0, 6)
    flags = classify(scored).first()
    assert flags.popia_flags == ["POPIA_PERSONAL_DATA", "POPIA_SECTION_22"]
    assert flags.cybercrimes_flags == [] and flags.sa_patterns_matched == []
    empty = graph_summary(spark.createDataFrame([("none",)], f"{INV} string"), nodes, edges)
    assert tuple(empty.first())[1:] == (0, 0, 0, 0, 0)


def test_rules_one_by_one(spark):
    rows = (
        [dict(src="night", at=-10 * 3600), dict(src="day", at=0)]
        + [dict(src="scan", at=i * 4000, port=i) for i in range(10)]
        + [dict(src="nine", at=i * 4000, port=i) for i in range(9)]
        + [dict(src="rapid", at=t) for t in (0, 20, 60)]
        + [dict(src="slow", at=t) for t in (0, 20, 61)]
        + [dict(src="brute", at=t * 60, type="Login_FAILED") for t in range(5)]
        + [dict(src="mixed", at=t * 60, type="denied" if t % 2 else "ok") for t in range(9)]
        + [dict(src="spike", at=i * 5000, bytes=b) for i, b in enumerate((1, 1, 1, 100))]
        + [dict(src="round", at=i * 5000, bytes=b) for i, b in enumerate((5000, 5001, 0))]
        + [dict(src=None, at=t) for t in (0, 1, 2)]
        + [dict(src="", at=t) for t in (0, 1, 2)]
        + [dict(src="timeless", at=None) for _ in range(3)]
    )
    frame = log_frame(spark, rows)
    got = reasons(frame)
    def of(source):
        return [got[i] for i, r in enumerate(rows) if r["src"] == source]
    assert of("night") == [["OFF_HOURS", "NEW_SOURCE"]] and of("day") == [["NEW_SOURCE"]]
    assert all("PORT_SCAN" in r for r in of("scan")) and not any("PORT_SCAN" in r for r in of("nine"))
    assert of("rapid") == [["RAPID_SUCCESSION"]] * 3 and of("slow") == [[]] * 3
    assert of("brute") == [["BRUTE_FORCE"]] * 5
    assert not any("BRUTE_FORCE" in r for r in of("mixed"))
    assert ["AMOUNT_SPIKE" in r for r in of("spike")] == [False, False, False, True]
    assert ["ROUND_BYTES" in r for r in of("round")] == [True, False, False]
    assert of(None) == [[]] * 3 and of("") == [["RAPID_SUCCESSION"]] * 3
    assert of("timeless") == [[]] * 3
    # the same with every source cut in slices
    assert reasons(frame, unit=2) == got
    with pytest.raises(ValueError, match="Missing required columns: dst_ip, dst_port"):
        prepare(frame.drop("dst_ip", "dst_port"))
    with pytest.raises(ValueError, match="no events to look at"):
        prepare(frame.limit(0), require_nonempty=True)


def test_hours_zone(spark):
    frame = log_frame(spark, [dict(src="a", at=-9 * 3600), dict(src="b", at=-14 * 3600)])
    assert ["OFF_HOURS" in reasons(frame)[i] for i in (0, 1)] == [True, False]
    assert ["OFF_HOURS" in reasons(frame, zone="Africa/Johannesburg")[i] for i in (0, 1)] == [False, True]


def deque_members(times, minimum, width):
    """Positions in any window of the width that holds enough events."""
    queue, members = deque(), set()
    for t, i in sorted((t, i) for i, t in enumerate(times)):
        while queue and t - queue[0][0] > width:
            queue.popleft()
        queue.append((t, i))
        if len(queue) >= minimum:
            members.update(j for _, j in queue)
    return members


def test_bursts_against_sliding_window(spark):
    rnd = random.Random(11)
    groups, rows = {}, []
    for g in range(120):
        minimum, seconds = BURSTS["rapid" if g % 2 else "brute"]
        step = rnd.choice([1, seconds / 4, seconds / 2, seconds])
        base = 1_767_225_600_000_000
        times = [base + int(rnd.random() * rnd.choice([3, 12]) * step * 1e6) for _ in range(rnd.randint(1, 40))]
        if g % 3 == 0:   # exact borders and equal times
            times = [base + rnd.randint(-6, 6) * seconds * 1_000_000 // 2 for _ in times]
        groups[f"s{g}"] = (times, deque_members(times, minimum, seconds * 1_000_000))
        rows += [("i", f"s{g}", t, ["rapid" if g % 2 else "brute"]) for t in times]
    frame = spark.createDataFrame(rows, f"{INV} string, src_ip string, ts_us long, burst array<string>")
    spans = burst_spans(frame, SOURCE, BURSTS).collect()
    for source, (times, members) in groups.items():
        mine = [(s.lo, s.hi) for s in spans if s.src_ip == source]
        found = {i for i, t in enumerate(times) if any(lo <= t <= hi for lo, hi in mine)}
        assert found == members, source


def stdlib_abroad(text):
    try:
        ip = ipaddress.ip_address(text.strip())
    except ValueError:
        return False
    if (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved
            or ip.is_unspecified):
        return False
    return not str(ip).startswith(("196.", "197.", "105.", "41."))


def test_cross_border_agrees_with_ipaddress(spark):
    rnd = random.Random(3)
    texts = ["8.8.8.8", "192.168.1.1", "bad-ip", "41.1.1.1", "411.1.1.1", "4.1.1.1", "100.64.0.1",
             "192.0.2.1", "192.0.0.9", "192.0.0.10", "192.0.0.11", "192.0.0.100", "198.18.0.1",
             "198.20.0.1", "224.0.0.1", "240.0.0.1", "255.255.255.255", "010.1.1.1", " 8.8.4.4\t", "",
             "1.2.3", "1.2.3.256", "::1", "::", "2606:4700::1111", "fe80::1%eth0", "2606:4700::1%eth0",
             "2001:db8::1", "2001:1::1", "2001:20::5", "::ffff:8.8.8.8", "64:ff9b::1", "fec0::1", "ff02::1",
             "1:2:3:4:5:6:7:8", "1::2::3", "1:2:3", "2606:4700::8.8.8.8", "2606:4700::8.8.8.08", ":", "2606:",
             "2606:1:2:3:4:5:6:7::", "2606:1:2:3:4:5:6::", "12345::1", "2606::g"]
    for _ in range(300):
        texts.append(str(ipaddress.ip_address(rnd.getrandbits(32))))
        texts.append(str(ipaddress.ip_address((0x2000 << 112) | rnd.getrandbits(125))))
        texts.append(str(ipaddress.ip_address(rnd.getrandbits(128))))
    rows = spark.createDataFrame([(t,) for t in texts], "d string").select("d", cross_border("d").alias("x"))
    assert [r.d for r in rows.collect() if r.x != stdlib_abroad(r.d)] == []


SCORE = ("anomaly_reasons array<string>, ml_is_anomaly boolean, is_anomaly boolean, event_type string, "
         "dst_port int, protocol string, bytes_transferred double")


def test_scoring(spark):
    cases = [
        ((["AMOUNT_SPIKE"], False, "x", 0, None, 0.0), 25, "Medium", ["Unusual data volume"]),
        ((["OFF_HOURS", "OFF_HOURS"], False, "x", 0, None, 0.0), 10, "Low", ["Off-hours activity"]),
        ((None, False, "x", 0, None, 0.0), 0, "None", []),
        (([], True, "x", 0, None, 0.0), 15, "Low", ["Statistical outlier (ML)"]),
        (([], False, "Monitor", 0, None, 0.0), 20, "Low", ["High-risk service category"]),
        (([], False, "x", 443, " http ", 0.0), 20, "Low", ["Protocol anomaly"]),
        (([], False, "x", 443, "tls", 0.0), 0, "None", []),
        (([], False, "x", 80, "  ", 0.0), 0, "None", []),
        (([], False, "x", 8080, "SSH", 0.0), 0, "None", []),
        (([], False, "x", 0, None, 50_000_000.0), 0, "None", []),
        (([], False, "x", 0, None, 50_000_001.0), 25, "Medium", ["Large data transfer (exfiltration risk)"]),
        ((["NEW_SOURCE", "BRUTE_FORCE"], False, "x", 0, None, 0.0), 50, "High",
         ["Unknown source", "Brute force authentication attempt"]),
        ((["BRUTE_FORCE", "AMOUNT_SPIKE", "CROSS_BORDER"], False, "x", 0, None, 0.0), 75, "Critical",
         ["Unusual data volume", "Cross-border network activity", "Brute force authentication attempt"]),
        ((["AMOUNT_SPIKE", "RAPID_SUCCESSION", "PORT_SCAN", "BRUTE_FORCE"], True, "tor", 22, "x", 6e7), 100,
         "Critical", None),
    ]
    rows = [(r, ml, False, *rest) for (r, ml, *rest), *_ in cases]
    got = score_threats(spark.createDataFrame(rows, SCORE).coalesce(1)).collect()
    for row, (_, score, level, signals) in zip(got, cases, strict=True):
        assert (row.threat_score, row.threat_level) == (score, level), row
        assert signals is None or row.threat_signals == signals
    with pytest.raises(ValueError, match="anomaly_reasons"):
        score_threats(spark.createDataFrame([(True, True)], "is_anomaly boolean, ml_is_anomaly boolean"))


EVENT = (f"{INV} string, event_id long, event_type string, user_account string, dst_ip string, "
         "threat_level string, threat_score int, threat_signals array<string>, anomaly_reasons array<string>")


def flagged(spark, *rows, clusters=None):
    """Each row: dict over the defaults; one investigation per call is enough."""
    made = [(r.get("inv", "i"), i, r.get("type", "x"), r.get("user"), r.get("dst"), r.get("level", "None"),
             r.get("score", 0), r.get("signals", []), r.get("reasons", [])) for i, r in enumerate(rows)]
    return spark.createDataFrame(made, EVENT)


def test_flags(spark):
    cases = {
        "login": ([dict(type="User_Login")], {"POPIA_PERSONAL_DATA"}),
        "s22": ([dict(type="login"), dict(score=50)], {"POPIA_PERSONAL_DATA", "POPIA_SECTION_22"}),
        "s22no": ([dict(type="login"), dict(score=49)], {"POPIA_PERSONAL_DATA"}),
        "signal": ([dict(signals=["Brute force authentication attempt"])], {"POPIA_PERSONAL_DATA"}),
        "abroad": ([dict(type="login", reasons=["CROSS_BORDER"])], {"POPIA_PERSONAL_DATA", "POPIA_CROSS_BORDER"}),
        "abroad2": ([dict(type="login"), dict(reasons=["CROSS_BORDER"])], {"POPIA_PERSONAL_DATA"}),
        "operator": ([dict(user="SVC_x", level="High")], {"POPIA_OPERATOR"}),
        "operator2": ([dict(user="SVC_x", level="Medium")], set()),
        "scan": ([dict(reasons=["PORT_SCAN"])], {"CYBERCRIMES_ACT_REPORTABLE"}),
        "referral": ([dict(reasons=["PORT_SCAN"])], {"CYBERCRIMES_ACT_REPORTABLE", "SAPS_REFERRAL"}),
        "bank": ([dict(type="swift", level="Critical")], {"CYBERCRIMES_ACT_REPORTABLE", "SARB_REPORTABLE"}),
        "power": ([dict(type="x", signals=["planned OUTAGE"])], {"ESKOM_SOCIAL_ENG"}),
        "portal": ([dict(dst="a.gov.za", reasons=["BRUTE_FORCE"])],
                   {"CYBERCRIMES_ACT_REPORTABLE", "GOVPORTAL_CREDENTIAL_STUFFING"}),
        "portal2": ([dict(dst="axgovxza", reasons=["BRUTE_FORCE"])], {"CYBERCRIMES_ACT_REPORTABLE"}),
        "money": ([dict(type="USSD")], {"MOBILE_MONEY_FRAUD"}),
        "ransom": ([dict(type="encrypt", dst="municipality")], {"MUNICIPALITY_RANSOMWARE"}),
        "fica": ([dict(type="kyc", score=50)], {"FICA_BYPASS_ATTEMPT"}),
        "fica2": ([dict(type="kyc", score=49)], set()),
    }
    rows = [dict(r, inv=name) for name, (group, _) in cases.items() for r in group]
    counts = spark.createDataFrame([("referral", 1), ("portal", 0)], f"{INV} string, attack_clusters_detected long")
    frame = flagged(spark, *rows)
    for row in investigation_flags(frame, counts).collect():
        true = {k for k, v in row.asDict().items() if v is True}
        assert true == cases[row[INV]][1], row[INV]
    listed = {r[INV]: r for r in classify(frame, counts).collect()}
    assert listed["fica2"].compliance_summary == "No immediate compliance obligations identified."
    assert listed["s22"].popia_flags == list(POPIA_FLAGS[:2])
    assert len(listed["referral"].reporting_obligations) == 2


def test_summary_and_top(spark):
    rows = [dict(score=i % 12, level=["None", "low", " x", None][i % 4], type=f"t{i}") for i in range(24)]
    frame = flagged(spark, *rows).withColumn("is_anomaly", F.lit(None).cast("boolean"))
    top = top_events(frame).orderBy("position").collect()
    assert [r.threat_score for r in top] == [11, 11, 10, 10, 9, 9, 8, 8, 7, 7]
    assert [r.event_id for r in top][:4] == [11, 23, 10, 22]
    assert [t["threat_score"] for t in top_events_list(frame).first().top_threats] == [r.threat_score for r in top]
    summary = threat_summary(frame)
    first = summary.first()
    assert (first.event_count, first.low, first.none, first.anomaly_count) == (24, 6, 12, 0)
    shares = {r.level: r.share for r in distribution_shares(summary).collect()}
    assert shares["low"] == pytest.approx(6 / 18)
    assert events_at_level(frame, "None").count() == 18 and events_at_level(frame, "all").count() == 24
    assert top_events(frame.select(INV, "event_id")).first().threat_signals == []


def test_forest(spark):
    rnd = random.Random(7)
    rows = [dict(inv=f"i{i % 2}", src=f"10.1.0.{i % 20}", at=rnd.randint(0, 20000), port=443,
                 bytes=rnd.gauss(500, 50)) for i in range(600)]
    rows += [dict(inv=f"i{i}", src="10.1.0.1", at=-39000, port=60000, bytes=9e8) for i in range(2)]
    context = with_source_context(prepare(log_frame(spark, rows))).cache()
    once = isolation_forest(context)
    flags = {r.event_id: r.ml_is_anomaly for r in once.collect()}
    assert flags[600] and flags[601]
    assert 0.03 <= sum(flags.values()) / len(flags) <= 0.06
    again = isolation_forest(context.repartition(7, "event_id"), unit=50)
    assert {r.event_id: r.ml_is_anomaly for r in again.collect()} == flags
    detected = detect_anomalies(log_frame(spark, rows), forest=True)
    assert detected.where("ml_is_anomaly and not is_anomaly").count() == 0




def test_outlier_cutoffs_are_those_of_a_sort(spark):
    """Percentiles of many sizes, with ties and equal scores, in two scans of the scores and no nested joins."""
    rng = np.random.default_rng(3)
    scores = {"one": rng.random(1), "two": rng.random(2), "equal": np.full(50, 0.5), "ties": rng.integers(0, 4, 300) / 4,
              "close": 0.6 + rng.random(2000) * 1e-7, "wide": rng.random(3001), "ends": np.array([0.0, 1.0] * 40)}
    rows = [(name, i, float(x)) for name, values in scores.items() for i, x in enumerate(values)]
    scored = cut_lineage(spark.createDataFrame(rows, f"{INV} string, event_id long, ml_score double"))
    weights = cut_lineage(scored.groupBy(INV).agg(F.count(F.lit(1)).alias("events")))
    for share in (0.05, 0.5, 1.0):
        found = forest.outlier_cutoffs(scored, weights, share)
        got = {r[INV]: (r.events, r.cutoff) for r in found.collect()}
        for name, values in scores.items():
            assert got[name] == (len(values), pytest.approx(np.quantile(values, 1 - share), abs=1e-15))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    scans = [line for line in plan.splitlines() if "Relation" in line and "ml_score" in line]
    assert len(scans) == 2 and plan.count("Join ") == 2


def test_forest_flags_of_a_small_table(spark):
    """The flagged events against scores computed tree by tree from the same fitted forest."""
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame(
        [(n, i, rng.normal(size=3).tolist() if i % 40 else [9.0, 9.0, float(i)]) for n in ("a", "b") for i in range(160)],
        f"{INV} string, event_id long, features array<double>")
    weights = rows.groupBy(INV).agg(F.count(F.lit(1)).alias("events"))
    trees = cut_lineage(forest.fit_forests(forest.training_sample(rows, weights)))
    scored = cut_lineage(forest.score_events(rows, trees, weights))
    fitted = {}
    for t in trees.collect():
        fitted.setdefault(t[INV], []).append(t)
    expected = {}
    for r in rows.collect():
        depths = []
        for t in fitted[r[INV]]:
            at = 0
            while t.low[at] != at:
                at = t.low[at] if r.features[t.feature[at]] <= t.cut[at] else t.high[at]
            depths.append(t.depth[at])
        expected[r[INV], r.event_id] = 2 ** (-np.mean(depths) / fitted[r[INV]][0].scale)
    got = {(r[INV], r.event_id): r.ml_score for r in scored.collect()}
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k], rel=1e-6) for k in got)
    cutoffs = {r[INV]: r.cutoff for r in forest.outlier_cutoffs(scored, weights).collect()}
    for name in ("a", "b"):
        mine = np.array([expected[name, i] for i in range(160)])
        assert cutoffs[name] == pytest.approx(np.quantile(mine, 0.95), rel=1e-6)
        assert {0, 40, 80, 120} <= set(np.flatnonzero(mine > cutoffs[name]))


def test_bursts_of_quiet_sources_need_one_row_an_event(spark):
    """An event is in a burst by either way of looking, at hour borders and between them; and few rows move."""
    rng = random.Random(5)
    rows = [("i", f"s{rng.randrange(6)}", int((3600 * 1_000_000) * rng.choice([1, 2, 2.5, -3]) + rng.randrange(-400, 400) * 1_000_000),
             ["rapid", "brute"] if rng.random() < 0.5 else ["rapid"]) for _ in range(900)]
    frame = spark.createDataFrame(rows, "investigation_id string, src_ip string, ts_us long, burst array<string>")
    found = []
    for spans in (burst_spans(frame, SOURCE, BURSTS), sparse_burst_spans(frame, SOURCE, BURSTS)):
        held = {}
        for r in spans.collect():
            held.setdefault((r.src_ip, r.burst), []).append((r.lo, r.hi))
        found.append({(s, b, t) for _, s, t, bursts in rows for b in bursts
                      if any(lo <= t <= hi for lo, hi in held.get((s, b), []))})
    assert found[0] == found[1] and 0 < len(found[0]) < sum(len(r[3]) for r in rows)


def test_quiet_sources_are_not_dealt_into_cells(spark):
    """Without a very busy hour no row is sent once per end of a cell; with one, both ways meet in one ledger."""
    events = log_frame(spark, [
        {"src": "a", "at": 30 * i, "type": "login_failed" if i % 2 else "x"} for i in range(9)
    ] + [{"src": "b", "at": 3595 + 4 * i} for i in range(4)])
    hourly = cut_lineage(hourly_ports(events))
    quiet, mixed = source_ledger(events, hourly), source_ledger(events, hourly, dense=6)
    plan = quiet._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" not in plan
    inside = lambda ledger: {
        (r.src_ip, r.at) for r in events.select("src_ip", F.unix_micros("timestamp").alias("at")).distinct().join(
            ledger.select("src_ip", F.explode("rapid").alias("s")), "src_ip")
        .where("at between s.lo and s.hi").collect()}
    assert inside(quiet) == inside(mixed) and len(inside(quiet)) == 13


def test_trimmed_ends_and_number_columns(spark):
    """A trim takes what Python's strip takes; a column of numbers is not written out as a text first."""
    blanks = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000 and chr(i).isspace()]
    frame = spark.createDataFrame([(b + "a" + b + "c" + b + b,) for b in [*blanks, "\u200b", "\ufeff"]], "v string")
    assert [r.s for r in frame.select(strip(F.col("v")).alias("s")).collect()] == [r.v.strip() for r in frame.collect()]
    numbers = log_frame(spark, [{"src": "a", "at": 0, "bytes": x} for x in (2.5, float("nan"), float("inf"), -1e300)])
    ready = prepare(numbers)
    assert [r.bytes_transferred for r in ready.collect()] == [2.5, 0.0, float("inf"), -1e300]
    assert "RLIKE" not in ready._jdf.queryExecution().optimizedPlan().toString()
