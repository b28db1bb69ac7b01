"""Report rows and the message of a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repomine.functions.dates import java_date_text
from repomine.functions.text import truncate_text
from repomine.functions.urls import commit_url

# Report columns as written, in order, and what a run answers when there is nothing to report.
REPORT_HEADERS = {
    "commit_url": "Commit URL",
    "commit_hash": "Commit Hash",
    "author": "Author",
    "date": "Date",
    "message": "Message",
    "repository": "Repository",
    "files_changed": "Files Changed",
}
# Input order of the repositories, then the log, newest first. The keys end in the hash.
REPORT_ORDER = ["repo_ord", "-committed_at", "hash"]
NO_REPOSITORIES = "No repositories found."
NO_COMMITS = "No relevant commits found."


def to_report(
    commits: DataFrame, legacy: bool = False, files: bool = False, keep: Sequence[str] = ()
) -> DataFrame:
    """Report rows of commits that carry ``clone_url``. ``files`` adds the repository and its file count.

    ``keep`` names columns of the commits to carry along, such as those of the order.
    """
    columns = [
        commit_url(F.col("clone_url"), F.col("hash"), legacy).alias("commit_url"),
        F.col("hash").alias("commit_hash"),
        "author",
        java_date_text(F.col("authored_at")).alias("date"),
        truncate_text(F.col("message")).alias("message"),
    ]
    if files:
        columns += [F.col("clone_url").alias("repository"), "files_changed"]
    return commits.select(*columns, *keep)


def in_report_order(commits: DataFrame) -> DataFrame:
    """Input order of the repositories, then the log: a range sort on keys that end in the hash."""
    return commits.orderBy("repo_ord", F.desc("committed_at"), "hash")


def status_text(repos: Column, commits: Column) -> Column:
    done = F.concat(
        F.lit("Successfully generated report with "), commits.cast("string"), F.lit(" commits from "),
        repos.cast("string"), F.lit(" repositories"),
    )
    return F.when(repos == 0, NO_REPOSITORIES).when(commits == 0, NO_COMMITS).otherwise(done)


def run_totals(spark: SparkSession, repos: int, commits: int) -> DataFrame:
    """The row of :func:`run_summary` where both numbers are known."""
    totals = spark.range(1).select(
        F.lit(repos).cast("bigint").alias("repos_scanned"), F.lit(commits).cast("bigint").alias("commits_matched")
    )
    return totals.withColumn("status", status_text(F.col("repos_scanned"), F.col("commits_matched")))


def run_summary(repos: DataFrame, report: DataFrame) -> DataFrame:
    """One row: length of the repository list, rows of the report, and the message of the run."""
    rows = repos.select(F.lit(1).alias("r"), F.lit(0).alias("c")).unionAll(
        report.select(F.lit(0).alias("r"), F.lit(1).alias("c"))
    )
    totals = rows.agg(
        F.coalesce(F.sum("r"), F.lit(0)).cast("bigint").alias("repos_scanned"),
        F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("commits_matched"),
    )
    return totals.withColumn("status", status_text(F.col("repos_scanned"), F.col("commits_matched")))
