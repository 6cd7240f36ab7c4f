"""Registered text queries against their SQL over the whole given tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from tenderglow.llm import catalog

SF_DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="given tables not present")


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for path in SF_DIR.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    cursor = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in cursor.description]
    result = catalog.QUERIES[name](spark, str(SF_DIR))
    assert sorted(result.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, result.select(*names).collect()))) == sorted(map(repr, cursor.fetchall()))


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 14))
