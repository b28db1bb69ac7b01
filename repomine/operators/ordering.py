"""Positions and pages over a total order, without a window that holds a whole table or repository."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repomine.session import cut_lineage

PAGE_SIZE = 100
# Rows of a slice, about, and rows up to which one task may sort out a page.
SLICE_ROWS = 1_000_000
TOP_ROWS = 100_000


def number_rows(
    df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (), name: str = "row_number", slices: int = 0
) -> DataFrame:
    """Number the rows of each key group from 1, however large a group is.

    The rows are cut into ranges of (keys, order). A row's number is its place within its range plus the
    rows of its group in earlier ranges. Only the first group of a range can reach back, so there is at
    most one such offset per range, and that bounds the broadcast. The ranges are written out first: they
    come from a sample and must not be drawn anew when a lost task is repeated.
    """
    n = slices or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // SLICE_ROWS + 1)
    ranged = df.repartitionByRange(n, *keys, *order).withColumn("_slice", F.spark_partition_id())
    placed = cut_lineage(ranged)

    sizes = placed.groupBy("_slice", *keys).agg(F.count("*").alias("_n"))
    earlier = (
        Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.withColumn("_before", F.sum("_n").over(earlier)).where("_before > 0").drop("_n")
    within = F.row_number().over(Window.partitionBy("_slice", *keys).orderBy(*order)).cast("bigint")
    numbered = placed.withColumn(name, within).join(F.broadcast(offsets), ["_slice", *keys], "left")
    return numbered.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_slice", "_before")


def log_position(commits: DataFrame) -> DataFrame:
    """Place of every commit in the log of its repository: newest first, then by hash."""
    order = [F.desc("committed_at"), F.asc("hash")]
    keyed = commits.select("repo_id", "hash", "committed_at")
    return number_rows(keyed, order, ["repo_id"], "log_position").drop("committed_at")


def result_page(df: DataFrame, page: int, order: Sequence[Column], size: int = PAGE_SIZE) -> DataFrame:
    """Page ``page`` (from 1) of the ordered rows. A deep page is cut out of all pages, not sorted in one task."""
    if size * page > TOP_ROWS:
        numbered = number_rows(df, order, name="_page_row")
        return numbered.where(F.col("_page_row").between(size * (page - 1) + 1, size * page)).drop("_page_row")
    return df.orderBy(*order).offset(size * (page - 1)).limit(size)


def all_pages(df: DataFrame, order: Sequence[Column], size: int = PAGE_SIZE) -> DataFrame:
    """Every row with the number of its page."""
    numbered = number_rows(df, order, name="page")
    return numbered.withColumn("page", F.floor((F.col("page") - 1) / size).cast("int") + 1)
