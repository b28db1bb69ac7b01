"""Report files and the history of searches."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repomine.operators.report import REPORT_HEADERS

# The name of a report is this prefix and the time it was made.
REPORT_PREFIX = "GitHubCommits_"
REPORT_STAMP = "%Y%m%d_%H%M%S"

# Messages hold quotes and line ends, so every field is quoted and a quote inside is doubled.
CSV_OPTIONS = {"header": "true", "quoteAll": "true", "escape": '"', "encoding": "UTF-8"}


def report_path(base: str, at: datetime | None = None) -> str:
    return f"{base.rstrip('/')}/{REPORT_PREFIX}{(at or datetime.now()).strftime(REPORT_STAMP)}"


def write_report(report: DataFrame, base: str, fmt: str = "csv", at: datetime | None = None) -> str:
    """Write report rows in their order, as CSV or Parquet; gives the folder.

    The first five columns get the titles of the report, further ones keep their names.
    """
    path = report_path(base, at)
    titled = report.select(*[F.col(c).alias(REPORT_HEADERS.get(c, c)) for c in report.columns])
    titled.write.format(fmt).options(**(CSV_OPTIONS if fmt == "csv" else {})).save(path)
    return path


def read_report(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Rows of a written report under their snake_case names."""
    options = {**CSV_OPTIONS, "multiLine": "true"} if fmt == "csv" else {}
    rows = spark.read.format(fmt).options(**options).load(path)
    names = {title: name for name, title in REPORT_HEADERS.items()}
    return rows.toDF(*[names.get(c, c) for c in rows.columns])


def append_history(entry: DataFrame, path: str) -> None:
    """Add one run (its parameters and its summary) to the table of past searches."""
    entry.write.mode("append").parquet(path)
