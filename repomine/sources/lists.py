"""Repository lists as text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repomine.functions.urls import HOST, HOST_PATTERN
from repomine.operators.repos import repos_from_lines


def scan_repo_list(
    spark: SparkSession, path: str, host: str = HOST, host_pattern: str = HOST_PATTERN, legacy: bool = False
) -> DataFrame:
    """``repo_id, clone_url, repo_ord`` of a list with one URL per line and ``#`` comments."""
    # The id rises with the line within a file, which is all the report order needs.
    lines = spark.read.text(path).withColumn("repo_ord", F.monotonically_increasing_id())
    return repos_from_lines(lines, "value", host, host_pattern, legacy)
