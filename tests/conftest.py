"""One session for all tests, set up as a query would find it."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from repomine.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "repomine-tests", "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """``values(rows, function)``: what a column function gives for each of the rows, as a list."""

    def run(rows, function, kind="string"):
        df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
        return [r["y"] for r in df.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()]

    return run
