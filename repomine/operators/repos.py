"""Choosing repositories."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repomine.functions.text import array_contains_any, contains_any, trim_line
from repomine.functions.urls import (
    HOST, HOST_PATTERN, is_repo_url, normalize_repo_url, repo_key,
)
from repomine.operators.joins import small_side_join

DOMAIN_COLUMNS = ("full_name", "description", "topics")


def drop_comments(lines: DataFrame, column: str = "value") -> DataFrame:
    """Trim the lines and drop those that are blank or start with ``#``."""
    return lines.withColumn(column, trim_line(F.col(column))).where(
        (F.col(column) != "") & ~F.startswith(F.col(column), F.lit("#"))
    )


def repos_from_lines(
    lines: DataFrame,
    column: str = "value",
    host: str = HOST,
    host_pattern: str = HOST_PATTERN,
    legacy: bool = False,
) -> DataFrame:
    """Lines of a repository list as ``repo_id, clone_url`` (and ``repo_ord`` if the input has it)."""
    kept = drop_comments(lines, column).where(is_repo_url(F.col(column), host_pattern))
    urls = kept.withColumn("clone_url", normalize_repo_url(F.col(column), host, legacy))
    order = ["repo_ord"] if "repo_ord" in lines.columns else []
    return urls.select(repo_key(F.col("clone_url")).alias("repo_id"), "clone_url", *order)


def match_domains(
    repos: DataFrame, domains: Sequence[str], columns: Sequence[str] = DOMAIN_COLUMNS
) -> DataFrame:
    """Repositories with any domain term in any of the columns, ignoring case. A blank term lets all pass."""
    if not domains or any(term == "" for term in domains):
        return repos
    kinds = dict(repos.dtypes)
    hits = [
        F.coalesce(
            (array_contains_any if kinds[c].startswith("array") else contains_any)(F.col(c), domains),
            F.lit(False),
        )
        for c in columns
    ]
    return repos.where(functools.reduce(operator.or_, hits))


def min_stars(repos: DataFrame, stars: int, column: str = "stars") -> DataFrame:
    return repos.where(F.col(column) >= stars)


def complete_repos(repos: DataFrame) -> DataFrame:
    return repos.dropna(subset=["clone_url", "full_name"])


def count_filter_active(mode: str | None, threshold: int) -> bool:
    return mode is not None and threshold > 0 and mode.lower() in ("greater", "less")


def commit_count_filter(
    repos: DataFrame, mode: str | None, threshold: int, column: str = "commit_count"
) -> DataFrame:
    """Strictly more or strictly fewer commits than the threshold; any other mode, or 0, filters nothing."""
    if not count_filter_active(mode, threshold):
        return repos
    count = F.col(column)
    return repos.where(count > threshold if mode.lower() == "greater" else count < threshold)


def with_commit_count(repos: DataFrame, counts: DataFrame, broadcast: bool = False) -> DataFrame:
    """Repositories with their commit count; 0 where none is known.

    ``broadcast`` says that ``counts`` was measured to fit. Otherwise the repositories are salted by their
    position, since one may be listed many times. Of several counts of a repository the greatest is taken.
    """
    spread = F.col("repo_ord") if "repo_ord" in repos.columns else F.col("clone_url")
    counts = counts.groupBy("repo_id").agg(F.max("commit_count").alias("commit_count"))
    joined = small_side_join(repos, counts, ["repo_id"], spread, "left", broadcast)
    return joined.withColumn("commit_count", F.coalesce("commit_count", F.lit(0)).cast("bigint"))


def append_pages(first: DataFrame, *more: DataFrame) -> DataFrame:
    """All rows of all tables, duplicates kept."""
    return functools.reduce(lambda a, b: a.unionByName(b), more, first)
