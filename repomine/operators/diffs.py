"""Changed files of a commit against its first parent."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repomine.functions.buckets import bucketed
from repomine.operators.history import parent_columns
from repomine.operators.joins import measured_join
from repomine.schemas import COMMIT_KEY, commit_key
from repomine.session import cut_lineage

# Directories from the root that a digest of a tree goes down.
DIGEST_DEPTH = 4


def tree_diff(commits: DataFrame, trees: DataFrame) -> DataFrame:
    """Changed paths of every commit that has a parent; a rename is a DELETE and an ADD.

    Each commit asks for two trees, its own and its parent's. The trees are shuffled once to answer;
    adaptive execution splits that join for a commit with a huge tree. The answers are shuffled once by
    path, where entries that are equal on both sides cancel first and the rest is named. No map-side
    combine is asked for: the two sides of a path rarely meet before the shuffle.
    """
    asked = parent_columns(commits).where(~F.col("is_root")).select(
        "repo_id",
        F.col("hash").alias("child"),
        F.explode(
            F.array(
                F.struct(F.col("hash").alias("hash"), F.lit(True).alias("is_new")),
                F.struct(F.col("parent").alias("hash"), F.lit(False).alias("is_new")),
            )
        ).alias("tree"),
    )
    asked = asked.select("repo_id", "tree.hash", "child", "tree.is_new")
    asked, on = bucketed(trees, asked, COMMIT_KEY)
    return _compared(measured_join(trees, asked, on))


def _compared(sides: DataFrame, blobs: bool = False) -> DataFrame:
    """Changed paths from the entries of both sides, shuffled once by path.

    ``blobs`` adds ``blob_id``: of the new entry, or of the old one where it was deleted.
    """
    entry = ["repo_id", "child", "path"]
    sides = sides.select(*entry, "mode", "blob_id", "is_new").repartition(*entry)
    # Boolean aggregates keep both steps hash aggregations; a max over the entry itself would sort.
    states = sides.groupBy(*entry, "mode", "blob_id").agg(
        F.bool_or("is_new").alias("new"), F.bool_or(~F.col("is_new")).alias("old")
    )
    contents = [F.coalesce(*[F.max(F.when(F.col(side), F.col("blob_id"))) for side in ("new", "old")]).alias("blob_id")]
    changed = states.where(~(F.col("new") & F.col("old"))).groupBy(*entry).agg(
        F.bool_or("new").alias("new"), F.bool_or("old").alias("old"), *(contents if blobs else [])
    )
    return changed.select(
        "repo_id", F.col("child").alias("hash"), "path", _change_type(F.col("old"), F.col("new")),
        *(["blob_id"] if blobs else []),
    )


def path_directory(path: Column, depth: int = DIGEST_DEPTH) -> Column:
    """The first ``depth`` directories of a path; files above that have what they have."""
    # By places, not by a pattern: it runs for every entry of every tree.
    above = F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1
    return F.substring_index(F.left(path, above), "/", depth)


def directory_digests(trees: DataFrame, depth: int = DIGEST_DEPTH) -> DataFrame:
    """``repo_id, hash, directory`` with the number of entries below it and a digest of them.

    The digest is the exclusive or of two hashes of path, mode and blob, 128 bits, so it does not depend on
    order and is combined before the shuffle: a row per directory is moved, not one per entry. Paths of a
    tree are unique. A tree table that keeps its digests makes them once, when a commit lands.
    """
    entry = [F.coalesce(F.col(c), F.lit("\0")) for c in ("path", "mode", "blob_id")]
    sums = [F.bit_xor(F.xxhash64(F.lit(seed), *entry)).alias(name) for seed, name in ((1, "one"), (2, "two"))]
    grouped = trees.groupBy(*COMMIT_KEY, path_directory(F.col("path"), depth).alias("directory"))
    return grouped.agg(F.count("*").alias("entries"), *sums)


def changed_directories(commits: DataFrame, digests: DataFrame) -> DataFrame:
    """``repo_id, child, parent, directory``: where the digests of a commit and its first parent differ."""
    edges = parent_columns(commits).where(~F.col("is_root")).select("repo_id", F.col("hash").alias("child"), "parent")
    asked = edges.select(
        "repo_id", "child", "parent",
        F.explode(F.array(F.struct(F.col("child").alias("hash"), F.lit(True).alias("is_new")),
                          F.struct(F.col("parent").alias("hash"), F.lit(False).alias("is_new")))).alias("tree"),
    ).select("repo_id", "child", "parent", "tree.hash", "tree.is_new")
    sides = measured_join(digests, asked, COMMIT_KEY)
    digest = F.struct("entries", "one", "two")
    both = sides.groupBy("repo_id", "child", "parent", "directory").agg(
        F.max(F.when(F.col("is_new"), digest)).alias("new"), F.max(F.when(~F.col("is_new"), digest)).alias("old")
    )
    return both.where(~F.col("new").eqNullSafe(F.col("old"))).drop("new", "old")


def tree_diff_by_directory(
    commits: DataFrame, trees: DataFrame, digests: DataFrame | None = None, depth: int = DIGEST_DEPTH,
    blobs: bool = False,
) -> DataFrame:
    """The rows of :func:`tree_diff`, for trees of which little changes from commit to commit.

    Digests of directories are compared first. Only entries of directories that differ go on to the shuffle
    by path; equal directories are never looked into, as a walk of two trees passes over equal subtrees.
    Give ``digests`` where they are kept beside the trees; they must be of the same ``depth``. ``blobs`` adds
    the contents, ``blob_id``, of the new entry, or of the old one where it was deleted.
    """
    digests = directory_digests(trees, depth) if digests is None else digests
    # Written: it is used twice, and a join with a written table is one adaptive execution can split.
    changed = cut_lineage(changed_directories(commits, digests))
    asked = changed.select(
        "repo_id", "child", "directory",
        F.explode(F.array(F.struct(F.col("child").alias("hash"), F.lit(True).alias("is_new")),
                          F.struct(F.col("parent").alias("hash"), F.lit(False).alias("is_new")))).alias("tree"),
    ).select("repo_id", "child", "directory", "tree.hash", "tree.is_new")
    asked, on = bucketed(trees, asked, [*COMMIT_KEY, "directory"])
    placed = trees.withColumn("directory", path_directory(F.col("path"), depth))
    return _compared(measured_join(placed, asked, on), blobs)


def _change_type(old: Column, new: Column) -> Column:
    return F.when(~old, "ADD").when(~new, "DELETE").otherwise("MODIFY").alias("change_type")


def tree_diff_joined(commits: DataFrame, trees: DataFrame) -> DataFrame:
    """The same rows by a full outer join: two scans and two more shuffles of the trees. For comparison."""
    edges = parent_columns(commits).where(~F.col("is_root")).select("repo_id", "hash", "parent")
    state = F.struct("mode", "blob_id")
    new = trees.join(edges, COMMIT_KEY, "left_semi").select(*COMMIT_KEY, "path", state.alias("new"))
    parents = trees.select("repo_id", F.col("hash").alias("parent"), "path", state.alias("old"))
    old = parents.join(edges, ["repo_id", "parent"]).select(*COMMIT_KEY, "path", "old")
    both = old.join(new, [*COMMIT_KEY, "path"], "full_outer")
    changed = both.where(~F.col("old").eqNullSafe(F.col("new")))
    return changed.select(
        *COMMIT_KEY, "path", _change_type(F.col("old").isNotNull(), F.col("new").isNotNull())
    )


def files_changed(changes: DataFrame, unique: bool = True) -> DataFrame:
    """Changed files per commit that has any.

    With ``unique`` (the contract of ``file_changes``, and what :func:`tree_diff` gives) rows are counted:
    the path is not even read and the counts are combined before the shuffle. Otherwise every path counts
    once; that is planned as a shuffle on commit and path, then one of partial counts, so in neither form
    is a commit with very many files a single task.
    """
    count = F.count("*") if unique else F.count_distinct("path")
    return changes.groupBy(*commit_key(changes)).agg(count.alias("files_changed"))


def with_files_changed(commits: DataFrame, counts: DataFrame) -> DataFrame:
    """Commits with ``files_changed``; 0 where nothing changed."""
    joined = commits.join(counts, commit_key(counts), "left")
    return joined.withColumn("files_changed", F.coalesce("files_changed", F.lit(0)).cast("bigint"))


def max_files(commits: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` changed files; a commit without parent passes whatever its size."""
    return commits.where(F.col("is_root") | (F.col("files_changed") <= limit))


def within_file_limit(commits: DataFrame, counts: DataFrame, limit: int) -> DataFrame:
    """:func:`max_files` where the count itself is not wanted: only the commits above the limit are joined."""
    key = commit_key(counts)
    above = counts.where(F.col("files_changed") > limit).select(*[F.col(c).alias(f"_{c}") for c in key])
    same = functools.reduce(operator.and_, [F.col(c) == F.col(f"_{c}") for c in key])
    return commits.join(above, same & ~F.col("is_root"), "left_anti")
