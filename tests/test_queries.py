"""Every registered query against its SQL on the smallest given tables."""

from __future__ import annotations

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from tenderglow.plans import catalog

SF_DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="given tables not present")

QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in SF_DIR.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    yield con
    con.close()


def plain(value):
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return value


def ordered(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    result = QUERIES[name](spark, str(SF_DIR))
    columns = sorted(result.columns)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    position = [names.index(c) for c in columns]
    wanted = ordered([tuple(r[i] for i in position) for r in cursor.fetchall()])
    assert ordered([tuple(r) for r in result.select(*columns).collect()]) == wanted


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_entry_lists_every_query():
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(ORACLES) <= set(entry_points.oracle_sql())


def test_entry_without_the_text_queries():
    import subprocess
    import sys

    code = "import sys; sys.modules['tenderglow.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(entry_points.__file__).parent)
    assert done.stdout.split() == [str(len(QUERIES)), "False", str(len(ORACLES))], done.stderr
