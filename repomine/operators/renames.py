"""Moved and renamed files of a commit, and what kind of restructuring they add up to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repomine.operators.ordering import number_rows
from repomine.schemas import COMMIT_KEY
from repomine.session import cut_lineage

# By what a deleted and an added file of a commit are paired, the surest first.
PASSES = (("blob_id", "name"), ("blob_id",), ("folder", "name"), ("name",))

# Files that go from one directory to one other make it a move of the directory.
DIRECTORY_FILES = 2


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    return F.left(path, F.length(path) - F.length(file_name(path)) - 1)


def _pair(sides: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Deleted and added files with equal ``keys`` in one commit, the first with the first by path, and the rest.

    The files are numbered without a window over a group, so a commit that moves very many equal files is
    no single task. A null key pairs nothing.
    """
    group = [*COMMIT_KEY, *keys]
    known = sides.dropna(subset=list(keys))
    numbered = number_rows(known, [F.asc("path")], [*group, "added"], "n")
    met = cut_lineage(numbered.groupBy(*group, "n").agg(
        F.max(F.when(~F.col("added"), F.struct("path", "blob_id"))).alias("old"),
        F.max(F.when(F.col("added"), F.struct("path", "blob_id"))).alias("new"),
    ).where("old is not null and new is not null").select(*COMMIT_KEY, "old", "new"))
    used = met.select(*COMMIT_KEY, F.explode(F.array(
        F.struct(F.col("old.path").alias("path"), F.lit(False).alias("added")),
        F.struct(F.col("new.path").alias("path"), F.lit(True).alias("added")),
    )).alias("side")).select(*COMMIT_KEY, "side.*")
    return met, cut_lineage(sides.join(used, [*COMMIT_KEY, "path", "added"], "left_anti"))


def renamed_paths(changes: DataFrame) -> DataFrame:
    """``repo_id, hash, old_path, new_path, edited, found_by``: files that a commit moved or renamed.

    ``changes`` are unique on (repo_id, hash, path) and have ``change_type`` and ``blob_id``, that of the old
    file for DELETE and of the new one for ADD. A deleted and an added file of one commit are paired one to
    one: by equal contents and file name, then by contents alone, then, for files that were edited on the way,
    by the last directory and the file name, then by the file name. Among several with one key the first by
    path goes with the first by path, and so on. What is left was deleted or added. ``found_by`` names the key.
    """
    pieces = [file_name(F.col("path")).alias("name"), file_name(directory(F.col("path"))).alias("folder")]
    sides = cut_lineage(changes.where("change_type in ('ADD', 'DELETE')").select(
        *COMMIT_KEY, "path", "blob_id", (F.col("change_type") == "ADD").alias("added"), *pieces))
    found = None
    for keys in PASSES:
        met, sides = _pair(sides, keys)
        met = met.select(
            *COMMIT_KEY, F.col("old.path").alias("old_path"), F.col("new.path").alias("new_path"),
            (~F.col("old.blob_id").eqNullSafe(F.col("new.blob_id"))).alias("edited"), F.lit("+".join(keys)).alias("found_by"),
        )
        found = met if found is None else found.union(met)
        if sides.isEmpty():
            break
    return found


def refactoring_moves(changes: DataFrame, renames: DataFrame | None = None) -> DataFrame:
    """One row per commit that moves or renames a file: ``repo_id, hash, moved, renamed, edited, other, tags``.

    ``moved`` files changed their directory and ``renamed`` ones their name, ``edited`` ones their contents
    too; ``other`` counts the remaining changes of the commit. The tags come from the shape of the change, not
    from words: ``move_file``, ``rename_file``, ``move_directory`` where some files went from one directory to
    one other, ``move_with_edit``, and ``pure_move`` where nothing else changed.
    """
    renames = cut_lineage(renamed_paths(changes)) if renames is None else renames
    old, new = F.col("old_path"), F.col("new_path")
    marked = renames.select(
        *COMMIT_KEY, "edited", directory(old).alias("from"), directory(new).alias("to"),
        (directory(old) != directory(new)).alias("moved"), (file_name(old) != file_name(new)).alias("renamed"),
    )
    # Counted by pair of directories first, so a commit with very many moves is combined before it meets.
    pairs = marked.groupBy(*COMMIT_KEY, "from", "to").agg(
        F.count_if("moved").alias("moved"), F.count_if("renamed").alias("renamed"), F.count_if("edited").alias("edited"),
        F.count("*").alias("files"),
    )
    commits = pairs.groupBy(*COMMIT_KEY).agg(
        *[F.sum(c).alias(c) for c in ("moved", "renamed", "edited", "files")], F.max("moved").alias("together"))
    total = changes.groupBy(*COMMIT_KEY).agg(F.count("*").alias("changes"))
    counted = commits.join(total, COMMIT_KEY).withColumn("other", F.col("changes") - 2 * F.col("files"))
    tags = {
        "move_directory": F.col("together") >= DIRECTORY_FILES, "move_file": F.col("moved") > 0,
        "move_with_edit": F.col("edited") > 0, "pure_move": (F.col("other") == 0) & (F.col("edited") == 0),
        "rename_file": F.col("renamed") > 0,
    }
    listed = F.array_compact(F.array(*[F.when(held, tag) for tag, held in tags.items()]))
    return counted.select(*COMMIT_KEY, "moved", "renamed", "edited", "other", listed.alias("tags"))
