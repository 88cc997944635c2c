"""Every registered query against its SQL statement, on the smallest tables."""

import glob
import math
from pathlib import Path

import duckdb
import pytest

from logvigil.plans.registry import QUERIES, STATEMENTS

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in glob.glob(f"{SF_DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {Path(file).stem} AS SELECT * FROM '{file}'")
    return con


def plain(rows):
    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v, 9))
        return repr(v)
    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    result = QUERIES[name](spark, SF_DIR)
    columns = sorted(result.columns)
    rows = result.select(*[f"`{c}`" for c in columns]).collect()
    if name not in STATEMENTS:
        assert rows
        return
    expected = duck.sql(STATEMENTS[name])
    assert sorted(expected.columns) == columns
    listed = ", ".join(f'"{c}"' for c in columns)
    assert plain(rows) == plain(expected.select(listed).fetchall())


def test_registry_contract():
    assert set(STATEMENTS) <= set(QUERIES)
    assert not [n for n in QUERIES if "pipeline" in n or n.startswith("op")]
