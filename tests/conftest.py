from __future__ import annotations

import sys
from datetime import datetime, timezone
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from tenderglow.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[4]",
        app="tests",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def utc(*parts: int) -> datetime:
    return datetime(*parts, tzinfo=timezone.utc)


@pytest.fixture
def table(spark):
    """Rows (tuples) under a DDL schema."""

    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture
def column(spark):
    """Values of one column expression over literal inputs, in input order."""
    from pyspark.sql import functions as F

    def run(inputs, builder, kind="string"):
        df = spark.createDataFrame(list(enumerate(inputs)), f"i INT, c {kind}")
        rows = df.select("i", builder(F.col("c")).alias("out")).collect()
        return [r.out for r in sorted(rows, key=lambda r: r.i)]

    return run
