"""Reachable histories, kept searches, renames: against plain Python, with broken and odd histories."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from repomine import MiningQuery, MiningTables, mine
from repomine.operators import diffs, reachability, renames
from repomine.plans import upkeep
from repomine.schemas import COMMITS, FILE_CHANGES, REPOS, TREE_ENTRIES

START = datetime(2024, 1, 1)


def commit(repo, name, parents=(), message="m", minutes=0):
    at = START + timedelta(minutes=minutes)
    return (repo, name, list(parents), "me", at, at, message)


def keys(df):
    return sorted(tuple(r) for r in df.select("repo_id", "hash").collect())


# Reachable commits


def reached_by_force(rows, heads):
    parents = {(r[0], r[1]): r[2] for r in rows}
    found, todo = set(), [h for h in heads if h in parents]
    while todo:
        at = todo.pop()
        if at not in found:
            found.add(at)
            todo += [(at[0], p) for p in parents[at] if (at[0], p) in parents]
    return sorted(found)


@pytest.mark.parametrize("seed", range(3))
def test_reachable_commits_of_random_histories(spark, seed):
    rng = random.Random(seed)
    rows = []
    for repo in "ab":
        for i in range(40):
            some = [str(rng.randrange(max(0, i - 9), i)) for _ in range(rng.choice([1, 1, 1, 2, 3]))] if i else []
            rows.append(commit(repo, str(i), some + (["lost"] if rng.random() < 0.1 else []), minutes=i))
    # A cycle, and a commit that is its own parent.
    rows += [commit("c", "x", ["z"]), commit("c", "y", ["x"]), commit("c", "z", ["y", "side"]), commit("c", "side", ["side"]), commit("c", "off")]
    heads = [("a", "39"), ("a", "39"), ("a", "17"), ("b", "20"), ("c", "y"), ("c", "nowhere"), ("d", "1")]
    table = spark.createDataFrame(rows, COMMITS)
    found = reachability.reachable_commits(table, spark.createDataFrame(heads, "repo_id string, hash string"))
    assert keys(found) == reached_by_force(rows, heads)
    assert found.columns == table.columns


def test_newest_commit_is_the_head(spark):
    rows = [commit("r", "a"), commit("r", "b", ["a"], minutes=1), commit("r", "c", ["a"], minutes=2), commit("s", "a")]
    assert keys(reachability.reachable_commits(spark.createDataFrame(rows, COMMITS))) == [("r", "a"), ("r", "c"), ("s", "a")]
    assert reachability.reachable_commits(spark.createDataFrame([], COMMITS)).count() == 0


def test_long_line_takes_few_rounds(spark, monkeypatch):
    rounds = []
    real = reachability._jumps
    monkeypatch.setattr(reachability, "_jumps", lambda first, most: rounds.append(real(first, most)) or rounds[-1])
    line = spark.range(100_000).select(
        F.lit("r").alias("repo_id"), F.col("id").cast("string").alias("hash"),
        F.when(F.col("id") > 0, F.array((F.col("id") - 1).cast("string"))).otherwise(F.array().cast("array<string>")).alias("parents"),
        F.timestamp_seconds("id").alias("committed_at"),
    )
    heads = spark.createDataFrame([("r", "90000")], "repo_id string, hash string")
    assert reachability.reachable_commits(line, heads).count() == 90_001
    assert len(rounds) == 1 and len(rounds[0]) <= 17


# Kept searches


def world(spark, rng, trees):
    rows, changes, entries = [], [], []
    for repo in ("o/a", "o/b", "o/c"):
        for i in range(25):
            name = f"{repo[-1]}{i}"
            rows.append(commit(repo, name, [f"{repo[-1]}{i - 1}"] if i else [], rng.choice(["Fix x", "add", "prefix", "é" * 2100 + "fix"]), i))
            for f in range(rng.randrange(6)):
                changes.append((repo, name, f"f{f}", "ADD"))
                entries.append((repo, name, f"f{f}", "m", str(rng.randrange(3))))
    repos = [(r, r, f"https://github.com/{r}.git", "d", [], n, n) for n, r in enumerate(("o/a", "o/b", "o/c"))]
    tables = {"tree_entries": spark.createDataFrame(entries, TREE_ENTRIES)} if trees else {"file_changes": spark.createDataFrame(changes, FILE_CHANGES)}
    return rows, MiningTables(spark.createDataFrame(rows, COMMITS), spark.createDataFrame(repos, REPOS), **tables)


@pytest.mark.parametrize("trees", [False, True])
def test_refreshes_keep_the_result_of_a_whole_search(spark, trees):
    rng = random.Random(1)
    rows, tables = world(spark, rng, trees)
    # With 12 commits no repository passes the threshold, with all of them each does.
    query = MiningQuery(["d"], ["fix"], "greater", 20, 1, 3)
    kept, held = None, spark.createDataFrame([], COMMITS)
    for upto in (5, 12, 25):
        part = spark.createDataFrame([r for r in rows if int(r[1][1:]) < upto], COMMITS)
        now = MiningTables(part, tables.repos, tables.file_changes, tables.tree_entries)
        kept = upkeep.search_hits(part, query, now) if kept is None else upkeep.refresh_hits(kept, held, part.union(part), query, now)
        held = part
        want = sorted(map(tuple, mine(query, now).collect()))
        assert sorted(map(tuple, upkeep.mine_kept(query, now, kept).collect())) == want
    assert want
    left = tables.commits.where("hash not in ('a24', 'b24', 'b23')")
    now = MiningTables(left, tables.repos, tables.file_changes, tables.tree_entries)
    got = upkeep.mine_kept(query, now, upkeep.retract_hits(kept, left))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mine(query, now).collect()))


def test_a_refresh_does_not_read_held_messages(spark, tmp_path, monkeypatch):
    rows, tables = world(spark, random.Random(2), False)
    held_path, in_path = str(tmp_path / "held"), str(tmp_path / "incoming")
    tables.commits.where("cast(substring(hash, 2) as int) < 20").write.parquet(held_path)
    tables.commits.write.parquet(in_path)
    held, incoming = spark.read.parquet(held_path), spark.read.parquet(in_path)
    query, plans, real = MiningQuery(["d"], ["fix"], "greater", 20, 1, 3), [], upkeep.cut_lineage
    monkeypatch.setattr(upkeep, "cut_lineage", lambda df: plans.append(df) or real(df))
    kept = real(upkeep.search_hits(held, query, tables))
    plans.clear()
    hits = upkeep.refresh_hits(kept, held, incoming, query, tables)
    report = upkeep.mine_kept(query, MiningTables(held, tables.repos, tables.file_changes), hits)
    for df in [*plans, hits, report]:
        own = [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if held_path in line]
        assert all("message" not in line for line in own)
    assert any(held_path in p._jdf.queryExecution().executedPlan().toString() for p in plans)


# Renames

CHANGES = "repo_id string, hash string, path string, change_type string, blob_id string"


def renamed(spark, *rows):
    found = renames.renamed_paths(spark.createDataFrame([("r", *r) for r in rows], CHANGES))
    return sorted((r["hash"], r["old_path"], r["new_path"], r["edited"], r["found_by"]) for r in found.collect())


def test_renames_by_contents_and_by_name(spark):
    assert renamed(
        spark,
        # same contents and name before same contents
        ("1", "a/x", "DELETE", "b"), ("1", "c/y", "ADD", "b"), ("1", "d/x", "ADD", "b"), ("1", "a/z", "DELETE", "b"),
        # edited on the way: last directory and name, then the name
        ("2", "src/main/f", "DELETE", "1"), ("2", "lib/main/f", "ADD", "2"), ("2", "x/f", "ADD", "3"), ("2", "y/f", "DELETE", "4"),
        # other commits, kinds and contents do not meet
        ("3", "q", "DELETE", "k"), ("4", "q2", "ADD", "k"), ("3", "p", "MODIFY", "k"), ("3", "new", "ADD", "other"),
        # no contents known: by name alone
        ("5", "a/n", "DELETE", None), ("5", "b/n", "ADD", None),
    ) == [
        ("1", "a/x", "d/x", False, "blob_id+name"), ("1", "a/z", "c/y", False, "blob_id"),
        ("2", "src/main/f", "lib/main/f", True, "folder+name"), ("2", "y/f", "x/f", True, "name"),
        ("5", "a/n", "b/n", False, "name"),
    ]


def test_equal_files_are_paired_one_to_one_in_order(spark):
    rng = random.Random(3)
    rows = [("1", f"o/{i:02}", "DELETE", "same") for i in range(30)] + [("1", f"n/q{i:02}", "ADD", "same") for i in range(20)]
    rng.shuffle(rows)
    assert renamed(spark, *rows) == [("1", f"o/{i:02}", f"n/q{i:02}", False, "blob_id") for i in range(20)]
    assert renamed(spark, ("1", "a", "ADD", "x")) == []


def test_refactoring_moves(spark):
    rows = [
        ("r", "dir", f"old/{i}", "DELETE", str(i)) for i in range(3)
    ] + [("r", "dir", f"new/{i}", "ADD", str(i)) for i in range(3)] + [
        ("r", "ren", "a/x", "DELETE", "1"), ("r", "ren", "a/y", "ADD", "1"), ("r", "ren", "b", "MODIFY", "7"),
        ("r", "edit", "a/x", "DELETE", "1"), ("r", "edit", "b/x", "ADD", "2"),
        ("r", "none", "a", "ADD", "1"), ("r", "none", "b", "MODIFY", "1"),
    ]
    found = renames.refactoring_moves(spark.createDataFrame(rows, CHANGES))
    assert {r["hash"]: (r["moved"], r["renamed"], r["edited"], r["other"], r["tags"]) for r in found.collect()} == {
        "dir": (3, 0, 0, 0, ["move_directory", "move_file", "pure_move"]),
        "ren": (0, 1, 0, 1, ["rename_file"]),
        "edit": (1, 0, 1, 0, ["move_file", "move_with_edit"]),
    }


def test_renames_of_compared_trees(spark):
    trees = [("r", "1", "a/f", "m", "x"), ("r", "1", "a/g", "m", "y"), ("r", "2", "b/f", "m", "x"), ("r", "2", "a/g", "m", "z")]
    commits = spark.createDataFrame([commit("r", "1"), commit("r", "2", ["1"])], COMMITS)
    changes = diffs.tree_diff_by_directory(commits, spark.createDataFrame(trees, TREE_ENTRIES), blobs=True)
    assert sorted(map(tuple, changes.select("path", "change_type", "blob_id").collect())) == [
        ("a/f", "DELETE", "x"), ("a/g", "MODIFY", "z"), ("b/f", "ADD", "x")]
    assert [tuple(r)[2:4] for r in renames.renamed_paths(changes).collect()] == [("a/f", "b/f")]


def test_later_walks_have_jumps_between_unreached_commits(spark, monkeypatch):
    edges = "repo_id string, hash string, parents array<string>, committed_at long"
    rows = [("r", str(i), [str(i - 1)] if i else [], i) for i in range(20)]
    rows += [("r", "s1", ["3"], 4), ("r", "s2", ["s1"], 5), ("r", "m", ["19", "s2"], 30), ("r", "lost", ["2"], 3)]
    seen, real = [], reachability._jumps
    monkeypatch.setattr(reachability, "_jumps", lambda first, most: seen.append(first.count()) or real(first, most))
    found = reachability.reachable_commits(spark.createDataFrame(rows, edges))
    assert sorted(r["hash"] for r in found.collect()) == sorted(r[1] for r in rows if r[1] != "lost")
    assert seen == [23, 1]
