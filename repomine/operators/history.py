"""Commit history: parents, counts, tallies, new commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repomine.functions.buckets import BUCKET, bucketed, repo_bucket
from repomine.operators.joins import small_side_join
from repomine.schemas import COMMIT_KEY


def commits_of(repos: DataFrame, commits: DataFrame, broadcast: bool | None = None) -> DataFrame:
    """All commits of the given repositories. A repository listed twice gives its commits twice."""
    repos, on = bucketed(commits, repos, ["repo_id"])
    return small_side_join(commits, repos, on, F.col("hash"), broadcast=broadcast)


def parent_columns(commits: DataFrame) -> DataFrame:
    """Add ``parent``, the first parent, and ``is_root``. Other parents of a merge play no part."""
    parent = F.try_element_at("parents", F.lit(1))
    return commits.withColumn("parent", parent).withColumn("is_root", F.col("parent").isNull())


def first_parent(commits: DataFrame, all_commits: DataFrame | None = None) -> DataFrame:
    """Add ``parent``, ``is_root`` and ``diff_ok``: false where the parent is named but not in the table.

    Give ``all_commits`` where ``commits`` is only a part of the table.
    """
    known = (commits if all_commits is None else all_commits).select(
        "repo_id", F.col("hash").alias("_key"), F.lit(True).alias("_found")
    )
    # A root gets a key of its own that no commit has: null keys would all meet in one task.
    key = F.coalesce("parent", F.concat(F.lit("\0"), F.col("hash")))
    joined = parent_columns(commits).withColumn("_key", key).join(known, ["repo_id", "_key"], "left")
    ok = F.col("is_root") | F.col("_found").isNotNull()
    return joined.withColumn("diff_ok", ok).drop("_key", "_found")


def commit_counts(commits: DataFrame) -> DataFrame:
    """Commits per repository. Counts are combined before the shuffle, so a hot repository costs nothing."""
    return commits.groupBy("repo_id").agg(F.count("*").alias("commit_count"))


def match_tally(repos: DataFrame, commits: DataFrame, kept: Column) -> DataFrame:
    """Per repository: commits scanned and commits for which ``kept`` holds."""
    tally = commits.groupBy("repo_id").agg(
        F.count("*").alias("scanned"), F.count_if(kept).alias("matched")
    )
    spread = F.col("repo_ord") if "repo_ord" in repos.columns else F.col("clone_url")
    # One row per repository with a commit: broadcast if measured to fit.
    joined = small_side_join(repos, tally, ["repo_id"], spread, "left")
    return joined.na.fill(0, ["scanned", "matched"])


def new_commits(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming commits that the table does not hold yet, each once. Only the key of ``existing`` is read.

    Where the table has its folders, those of the incoming repositories are looked up first (their number is
    bounded by the layout) and no others are opened. A refresh delivers mostly what is held, so that is
    dropped before copies are; the rest is already placed by its key.
    """
    if BUCKET in existing.columns:
        touched = incoming.select(repo_bucket(F.col("repo_id")).alias(BUCKET)).distinct().collect()
        existing = existing.where(F.col(BUCKET).isin([r[BUCKET] for r in touched]))
    unseen = incoming.join(existing.select(*COMMIT_KEY), COMMIT_KEY, "left_anti")
    return unseen.dropDuplicates(COMMIT_KEY)
