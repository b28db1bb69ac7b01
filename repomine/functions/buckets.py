"""Folders of the landed tables: one per group of repositories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Partition column of a landed table. A search keeps few repositories, so most folders are never opened.
BUCKET = "repo_bucket"
# Part of the layout on disk: tables written with another number would no longer meet.
BUCKETS = 1024


def repo_bucket(repo_id: Column) -> Column:
    return F.pmod(F.xxhash64(repo_id), F.lit(BUCKETS)).cast("int")


def bucketed(table: DataFrame, other: DataFrame, on: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The other side of a join with a table, and the keys, with the folder among them if the table has it.

    The folder follows from the repository, so the result is the same; as a partition column in the keys it
    lets Spark skip folders once it knows the other side.
    """
    if BUCKET not in table.columns:
        return other, list(on)
    return other.withColumn(BUCKET, repo_bucket(F.col("repo_id"))), [BUCKET, *on]
