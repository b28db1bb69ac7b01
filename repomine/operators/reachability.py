"""Which commits a head leads to, over all parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repomine.operators.joins import measured_join
from repomine.schemas import COMMIT_KEY
from repomine.session import cut_lineage

_TO = ["repo_id", "to"]


def newest_commits(commits: DataFrame) -> DataFrame:
    """``repo_id, hash`` of the newest commit of every repository, the greatest hash among equals."""
    newest = commits.groupBy("repo_id").agg(F.max(F.struct("committed_at", "hash")).alias("last"))
    return newest.select("repo_id", "last.hash")


def _parent_edges(commits: DataFrame) -> DataFrame:
    """``repo_id, hash, pos, to``: every parent of a commit that the table holds; position 0 is the first."""
    edges = commits.select(*COMMIT_KEY, F.posexplode("parents").alias("pos", "to"))
    known = commits.select("repo_id", F.col("hash").alias("to"))
    return edges.join(known, _TO, "left_semi")


def _jumps(first: DataFrame, most: int) -> list[DataFrame]:
    """Tables ``repo_id, hash, to``: the first parent, the one 2 steps up, then 4, 8 … up to ``most`` steps.

    Each is the one before joined with itself. Histories shorter than a jump are no longer in its table.
    """
    jumps, steps = [first], 1
    while 2 * steps <= most:
        last = jumps[-1]
        onward = last.select("repo_id", F.col("hash").alias("to"), F.col("to").alias("end"))
        longer = cut_lineage(last.join(onward, _TO).select(*COMMIT_KEY, F.col("end").alias("to")))
        if longer.isEmpty():
            break
        jumps.append(longer)
        steps *= 2
    return jumps


def _ancestors(starts: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """``starts`` and all their ancestors by first parents: the reach doubles with every jump.

    As long as what is reached fits a broadcast, the jumps are not shuffled.
    """
    reached = starts
    for jump in jumps:
        further = measured_join(jump, reached, COMMIT_KEY).select("repo_id", F.col("to").alias("hash"))
        reached = cut_lineage(reached.union(further).distinct())
    return reached


def reachable_commits(commits: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """The rows of ``commits`` that a log started at the heads shows: the heads and all their ancestors.

    ``heads`` has ``repo_id, hash``; without it the newest commit of a repository is its head. All parents are
    followed, as a log does, so commits of branches that were never merged are left out.

    A line of first parents is walked by pointer doubling: after k rounds everything up to 2^k - 1 steps away
    is reached, 17 rounds for 100,000 commits. The other parents of all merges met are the starts of the next
    walk; there are as many walks as branches are nested within branches, not as there are merges. A walk ends
    at what is reached already, so it has jumps between the other commits only. The rounds end with the number of commits of the largest repository, so a cycle, which only broken data has, ends
    too. Parents that the table does not hold, heads among them, are passed over. Every round is written.
    """
    heads = newest_commits(commits) if heads is None else heads
    edges = cut_lineage(_parent_edges(commits))
    first = edges.where("pos = 0").select(*COMMIT_KEY, "to")
    others = edges.where("pos > 0").select(*COMMIT_KEY, "to")
    most = commits.groupBy("repo_id").count().agg(F.max("count")).first()[0] or 0
    starts = cut_lineage(heads.select(*COMMIT_KEY).join(commits.select(*COMMIT_KEY), COMMIT_KEY, "left_semi").distinct())
    reached = starts.limit(0)
    while not starts.isEmpty():
        grown = _ancestors(starts, _jumps(first, most))
        reached = cut_lineage(reached.union(grown).distinct())
        merged = others.join(grown, COMMIT_KEY, "left_semi").select("repo_id", F.col("to").alias("hash")).distinct()
        starts = cut_lineage(merged.join(reached, COMMIT_KEY, "left_anti"))
        if not starts.isEmpty():
            open_ends = first.join(reached, COMMIT_KEY, "left_anti")
            first = cut_lineage(open_ends.join(reached.withColumnRenamed("hash", "to"), _TO, "left_anti").select(*first.columns))
    return commits.join(reached, COMMIT_KEY, "left_semi")
