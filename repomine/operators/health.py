"""Summaries of a repository's history over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def commit_frequency(commits: DataFrame, unit: str = "week") -> DataFrame:
    """Commits per repository and calendar unit (day, week, month, quarter, year)."""
    period = F.date_trunc(unit, "authored_at").alias("period")
    return commits.groupBy("repo_id", period).agg(F.count("*").alias("commits"))


def repo_health(commits: DataFrame) -> DataFrame:
    """Per repository: commits, first and last time, active days and the longest pause in seconds.

    Pauses are taken within a day and between a day and the active day before it, in whole seconds as in a
    commit's time. So a window holds at most the seconds of one day or the days of one repository, and a
    repository with very many commits is spread by day. One commit only: no pause, given as -1.
    """
    second = F.unix_seconds(F.col("authored_at").cast("timestamp"))
    times = commits.groupBy("repo_id", second.alias("sec")).agg(F.count("*").alias("n"))
    times = times.withColumn("day", F.floor(F.col("sec") / DAY))
    step = F.col("sec") - F.lag("sec").over(Window.partitionBy("repo_id", "day").orderBy("sec"))
    days = times.withColumn("pause", step).groupBy("repo_id", "day").agg(
        F.sum("n").alias("n"),
        F.min("sec").alias("first"),
        F.max("sec").alias("last"),
        F.max("pause").alias("pause"),
    )
    night = F.col("first") - F.lag("last").over(Window.partitionBy("repo_id").orderBy("day"))
    return days.withColumn("pause", F.greatest("pause", night)).groupBy("repo_id").agg(
        F.sum("n").alias("commits"),
        F.timestamp_seconds(F.min("first")).alias("first_at"),
        F.timestamp_seconds(F.max("last")).alias("last_at"),
        F.count("*").alias("active_days"),
        F.coalesce(F.max("pause"), F.lit(-1)).cast("bigint").alias("longest_gap_seconds"),
    )
