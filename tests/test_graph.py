"""Graph, components, clusters, ranking and balanced joins."""

import random

from pyspark.sql import functions as F

from logvigil.functions.skew import balanced_join
from logvigil.operators import components
from logvigil.operators.components import connected_components
from logvigil.operators.graph import (
    attack_clusters, display_value, edge_events, graph_edges, graph_nodes, incident_edges,
)
from logvigil.operators.ranking import number_rows

INV = "investigation_id"
SCORED = (f"{INV} string, event_id long, src_ip string, dst_ip string, user_account string, device_id string, "
          "event_type string, threat_score int, threat_level string, bytes_transferred double")


def scored(spark, rows):
    made = [("i", n, *row) for n, row in enumerate(rows)]
    return spark.createDataFrame(made, SCORED)


def union_find(links):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in parent}


def test_nodes_and_edges(spark):
    frame = scored(spark, [
        ("a", "b", "u", "d", "x", 10, "Low", 5.0),
        (" a ", "b", None, " ", "y", 60, "High", None),
        ("b", "b", "u", None, "x", 80, "Critical", 1.0),
        ("a", "b", None, None, " ", 0, "weird", 1.0),
        (None, "c", "u", None, "x", 0, "None", 1.0),
    ])
    nodes = {r.node_id: r for r in graph_nodes(frame).collect()}
    assert {k: v.event_count for k, v in nodes.items()} == {
        "ip:a": 3, "ip:b": 5, "ip:c": 1, "user_account:u": 3, "device_id:d": 1}
    assert (nodes["ip:b"].type, nodes["ip:b"].max_threat_level, nodes["ip:c"].type) == (
        "src_ip", "Critical", "dst_ip")
    assert nodes["ip:a"].is_suspicious and not nodes["ip:c"].is_suspicious
    edges = {(r.source, r.target): r for r in graph_edges(frame).collect()}
    ab = edges["ip:a", "ip:b"]
    assert (ab.event_count, ab.total_bytes, ab.max_threat_score, ab.dominant_event_type) == (3, 6.0, 60, "x")
    assert incident_edges(graph_edges(frame), "ip:b").count() == 2
    shown = spark.createDataFrame([("ip:::1",), ("plain",), (None,)], "n string")
    assert [r[0] for r in shown.select(display_value(F.col("n"))).collect()] == ["::1", "plain", "Unknown"]
    assert graph_edges(frame.limit(0)).count() == 0
    assert graph_nodes(frame.drop("user_account", "device_id")).count() == 3


def test_components_against_union_find(spark):
    rnd = random.Random(4)
    graphs = {
        "random": [(f"ip:{rnd.randint(0, 120)}", f"ip:{rnd.randint(0, 120)}") for _ in range(90)],
        "chain": [(f"ip:{i:03d}", f"ip:{i + 1:03d}") for i in range(150)],
        "star": [("ip:zz", f"ip:{i}") for i in range(60)],
        "loop": [("ip:x", "ip:x")],
    }
    links = [(g, a, b) for g, pairs in graphs.items() for a, b in pairs]
    edges = spark.createDataFrame(links, f"{INV} string, source string, target string")
    nodes = spark.createDataFrame(
        sorted({(g, n) for g, a, b in links for n in (a, b)}) + [("star", "device_id:d")],
        f"{INV} string, node_id string")
    expected = {(g, n): c for g, pairs in graphs.items() for n, c in union_find(pairs).items()}
    for unit in (1_000_000, 7):
        got = {(r[INV], r.node_id): r.component for r in connected_components(edges, nodes, unit).collect()}
        assert got == expected


def test_heavy_node_is_cut(spark):
    """One node with half of all links: no task joins more than twice the median rows."""
    half, unit = 8000, 200
    pairs = spark.range(2 * half).select(
        F.lit("i").alias(INV), F.when(F.col("id") < half, F.lit("ip:hub")).otherwise(F.concat(F.lit("ip:"), F.col("id") % 997)).alias("u"),
        F.concat(F.lit("ip:"), "id").alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = components._with_smallest(pairs, components._around(pairs), unit, small=False)
        rows = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(rows) == 2 * half and rows[-1] <= 2 * rows[len(rows) // 2]


def test_clusters(spark):
    rows = [("a1", "a2", None, None, "x", 95, "Critical", 10.0), ("a1", "a3", None, None, "y", 60, "High", 5.0),
            ("b1", "b2", None, None, "x", 60, "High", 1.0), ("b2", "b3", None, None, "x", 60, "High", 1.0),
            ("b3", "b4", None, None, " ", 0, "None", 1.0),
            ("c1", "c2", "svc", "pc", "x", 99, "Critical", 1.0)]
    frame = scored(spark, rows)
    nodes, edges = graph_nodes(frame), graph_edges(frame)
    for unit in (1_000_000, 1):
        parts = connected_components(edges, nodes)
        found = attack_clusters(nodes, parts, edge_events(frame), unit)
        got = found["clusters"].orderBy("position").collect()
        assert [(r.cluster_id, r.first_node, r.node_count, r.suspicious_nodes, r.edge_count, r.total_bytes,
                 r.max_threat_score, r.dominant_threat_level) for r in got] == [
            ("CLUSTER-001", "ip:a1", 3, 3, 2, 15.0, 95, "Critical"),
            ("CLUSTER-002", "ip:b1", 4, 3, 3, 3.0, 60, "High")]
        assert found["members"].count() == 7
        assert sorted(map(tuple, found["event_types"].select("cluster_id", "event_type").collect())) == [
            ("CLUSTER-001", "x"), ("CLUSTER-001", "y"), ("CLUSTER-002", "x")]


def test_number_rows(spark):
    rnd = random.Random(1)
    rows = [("big" if i % 10 else f"g{i % 7}", rnd.randint(0, 5), i) for i in range(2000)]
    frame = spark.createDataFrame(rows, "g string, s int, i long")
    numbered = number_rows(frame, ["g"], [F.desc("s"), F.asc("i")], "n").collect()
    expected = {}
    for g in {r[0] for r in rows}:
        ranked = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        expected.update({r[2]: n for n, r in enumerate(ranked, 1)})
    assert {r.i: r.n for r in numbered} == expected


def test_balanced_join(spark):
    rows = spark.range(3000).selectExpr(
        "id", "case when id % 3 = 0 then 'hot' when id % 50 = 1 then null else concat('k', id % 40) end as k")
    lookup = rows.where("k is not null and k <> 'k7'").groupBy("k").agg(F.count(F.lit(1)).alias("w"))
    whole = balanced_join(rows, lookup, ["k"], weights=lookup, weight="w", row_id=["id"], unit=100)
    plain = rows.join(lookup, "k", "left")
    columns = ["id", "k", "w"]
    assert whole.count() == 3000
    assert whole.select(columns).exceptAll(plain.select(columns)).count() == 0
