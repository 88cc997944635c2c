"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from logvigil.plans.registry import QUERIES  # noqa: E402
from logvigil.session import build_session, stage_scope  # noqa: E402

HEADLINE = (
    "normalised_logs", "source_profile", "anomaly_reasons", "threat_scores", "threat_distribution",
    "top_events", "regulatory_flags", "graph_nodes", "graph_edges", "attack_clusters",
    "isolation_forest_flags", "nearest_documents", "parsed_reports", "owned_page", "pasted_logs",
    "investigations",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", int(cpus), "logvigil-bench", spark__ui__enabled="false",
        spark__driver__memory="16g", spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="run-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    # one small query first, so that starting the engine is not charged to any
    QUERIES["threat_distribution"](spark, "/root/testdata/sf0.001").collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        with stage_scope(spark):
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total wall time",
        "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": int(cpus), "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
