"""Landed history tables: commits, tree entries, changed files, and their layout on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repomine.functions.buckets import BUCKET, repo_bucket
from repomine.schemas import COMMITS, DIFF_OK, FILE_CHANGES, REPOS, TREE_ENTRIES


def land(df: DataFrame, path: str, mode: str = "append") -> None:
    """Write a table with ``repo_id`` in folders by :func:`repo_bucket`.

    The rebalancing exchange gathers a folder's rows into few files; adaptive execution cuts the folder of
    a hot repository into as many files as its size asks for.
    """
    placed = df.withColumn(BUCKET, repo_bucket(F.col("repo_id")))
    placed.hint("rebalance", BUCKET).write.mode(mode).partitionBy(BUCKET).parquet(path)


def _scan(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    return spark.read.format(fmt).schema(schema).load(path)


def scan_repos(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _scan(spark, path, REPOS, fmt)


def scan_commits(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Commits, with ``diff_ok`` where the table has it and null where not."""
    return _scan(spark, path, T.StructType([*COMMITS.fields, DIFF_OK]), fmt)


def scan_tree_entries(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _scan(spark, path, TREE_ENTRIES, fmt)


def scan_file_changes(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _scan(spark, path, FILE_CHANGES, fmt)
