"""All registered queries and their SQL statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logvigil.plans import (
    checks_detection, checks_graph, checks_ingest, checks_knowledge, checks_store,
)

_GROUPS = (checks_detection, checks_graph, checks_knowledge, checks_store, checks_ingest)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: query for group in _GROUPS for name, (query, _) in group.CHECKS.items()
}
STATEMENTS: dict[str, str] = {
    name: text.strip()
    for group in _GROUPS for name, (_, text) in group.CHECKS.items() if text is not None
}
