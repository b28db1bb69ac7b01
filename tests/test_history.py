"""Histories, trees, order and refreshes on small tables, against plain Python where that is shorter."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from repomine.operators import diffs, health, history, joins, keywords, ordering
from repomine.plans import roles
from repomine.schemas import COMMIT_KEY, COMMITS, FILE_CHANGES, TREE_ENTRIES
from repomine.sources.tables import land, scan_commits

START = datetime(2024, 1, 1)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def commit(repo, name, parents=(), message="m", minutes=0):
    at = START + timedelta(minutes=minutes)
    return (repo, name, list(parents), "me", at, at, message)


def commit_table(spark, *commits):
    return spark.createDataFrame(list(commits), COMMITS)


def test_first_parent(spark):
    commits = commit_table(
        spark,
        commit("r", "a"), commit("r", "b", ["a"]), commit("r", "m", ["b", "x"]), commit("r", "lost", ["gone"]),
        commit("s", "c", ["a"]),
    )
    found = history.first_parent(commits)
    assert rows(found, "hash", "parent", "is_root", "diff_ok") == sorted(
        [("a", None, True, True), ("b", "a", False, True), ("m", "b", False, True),
         ("lost", "gone", False, False), ("c", "a", False, False)], key=str,
    )
    part = history.first_parent(commits.where("hash = 'b'"), commits)
    assert rows(part, "hash", "diff_ok") == [("b", True)]


@pytest.mark.parametrize("broadcast", [True, False, None])
def test_commits_of_is_a_bag(spark, broadcast):
    commits = commit_table(spark, commit("r", "a"), commit("r", "b"), commit("s", "c"))
    repos = spark.createDataFrame([("r", "u"), ("r", "u"), ("t", "v")], "repo_id string, clone_url string")
    assert rows(history.commits_of(repos, commits, broadcast), "hash", "clone_url") == [
        ("a", "u"), ("a", "u"), ("b", "u"), ("b", "u")
    ]


TREES = [
    ("r", "a", "f1", "100644", "1"), ("r", "a", "f2", "100644", "2"), ("r", "a", "f3", "100644", "3"),
    # against a: f1 kept, f2 other mode, f3 gone, f4 new; old is f5 under a new name
    ("r", "b", "f1", "100644", "1"), ("r", "b", "f2", "100755", "2"), ("r", "b", "f4", "100644", "4"),
    ("r", "m", "f1", "100644", "9"), ("r", "m", "f2", "100755", "2"), ("r", "m", "f4", "100644", "4"),
    ("r", "x", "f1", "100644", "7"),
    ("s", "a", "f1", "100644", "5"),
]
TREE_COMMITS = [
    commit("r", "a"), commit("r", "b", ["a"]), commit("r", "m", ["b", "x"]), commit("r", "x", ["a"]),
    commit("r", "same", ["a"]), commit("s", "a"),
]


TREE_FORMS = [diffs.tree_diff, diffs.tree_diff_joined, diffs.tree_diff_by_directory]


@pytest.mark.parametrize("form", TREE_FORMS)
def test_tree_diff(spark, form):
    same = [("r", "same", path, mode, blob) for repo, name, path, mode, blob in TREES if (repo, name) == ("r", "a")]
    trees = spark.createDataFrame(TREES + same, TREE_ENTRIES)
    changed = form(commit_table(spark, *TREE_COMMITS), trees)
    assert rows(changed, "hash", "path", "change_type") == [
        ("b", "f2", "MODIFY"), ("b", "f3", "DELETE"), ("b", "f4", "ADD"),
        ("m", "f1", "MODIFY"),
        ("x", "f1", "MODIFY"), ("x", "f2", "DELETE"), ("x", "f3", "DELETE"),
    ]


def test_tree_diff_forms_agree_on_random_trees(spark):
    rng = random.Random(3)
    commits, trees = [], []
    for i in range(60):
        parents = [str(rng.randrange(i)) for _ in range(rng.choice([1, 1, 2]))] if i else []
        commits.append(commit("r", str(i), parents))
        for path in rng.sample(range(12), rng.randrange(12)):
            trees.append(("r", str(i), f"p{path}", rng.choice(["1", "2", None]), rng.choice(["x", "y"])))
    state = {}
    for _, name, path, mode, blob in trees:
        state.setdefault(name, {})[path] = (mode, blob)
    want = []
    for _, name, parents, *_ in commits:
        if parents:
            old, new = state.get(parents[0], {}), state.get(name, {})
            for path in old.keys() | new.keys():
                if old.get(path) != new.get(path):
                    want.append((name, path, "ADD" if path not in old else "DELETE" if path not in new else "MODIFY"))
    c, t = commit_table(spark, *commits), spark.createDataFrame(trees, TREE_ENTRIES)
    for form in TREE_FORMS:
        assert rows(form(c, t), "hash", "path", "change_type") == sorted(want)


@pytest.mark.parametrize("depth", [1, 2, 9])
@pytest.mark.parametrize("broadcast", [True, False])
def test_tree_diff_by_directory_on_nested_trees(spark, monkeypatch, depth, broadcast):
    monkeypatch.setattr(joins, "fits_broadcast", lambda df, max_bytes=0: broadcast)
    rng = random.Random(depth)
    paths = ["/".join(rng.choice("ab") for _ in range(rng.randrange(1, 6))) + f"/{i}" for i in range(40)] + ["top", "a", "a/b"]
    state, commits, trees = {p: 0 for p in paths}, [], []
    for i in range(12):
        for p in rng.sample(paths, 2):
            state[p] = rng.choice([None, 1, 2, 3])
        commits.append(commit("r", str(i), [str(i - 1)] if i else []))
        trees += [("r", str(i), p, "m", str(b)) for p, b in state.items() if b is not None]
    c, t = commit_table(spark, *commits), spark.createDataFrame(trees, TREE_ENTRIES)
    want = rows(diffs.tree_diff(c, t), "hash", "path", "change_type")
    kept = diffs.directory_digests(t, depth)
    assert rows(diffs.tree_diff_by_directory(c, t, kept, depth), "hash", "path", "change_type") == want
    moved = diffs.changed_directories(c, kept).count()
    assert 0 < moved < kept.count() / 2


def test_path_directory(values):
    paths = ["f", "a/f", "a/b/f", "a/b/c/f", "/f", "/a/f", ""]
    assert values(paths, lambda p: diffs.path_directory(p, 2)) == ["", "a", "a/b", "a/b", "", "/a", ""]


def test_files_changed_and_limits(spark):
    changes = [("r", "ten", f"p{i}", "ADD") for i in range(10)] + [("r", "eleven", f"p{i}", "ADD") for i in range(11)]
    changes += [("r", "root", f"p{i}", "ADD") for i in range(500)]
    table = spark.createDataFrame(changes, FILE_CHANGES)
    commits = history.parent_columns(
        commit_table(spark, commit("r", "root"), commit("r", "ten", ["root"]), commit("r", "eleven", ["ten"]),
                     commit("r", "none", ["ten"]))
    )
    counts = diffs.files_changed(table)
    counted = diffs.with_files_changed(commits, counts)
    assert rows(counted, "hash", "files_changed") == [("eleven", 11), ("none", 0), ("root", 500), ("ten", 10)]
    kept = [("none",), ("root",), ("ten",)]
    assert rows(diffs.max_files(counted, 10), "hash") == kept
    assert rows(diffs.within_file_limit(commits, counts, 10), "hash") == kept
    # the key may be the hash alone, and paths may repeat
    by_hash = table.unionAll(table).drop("repo_id")
    assert rows(diffs.within_file_limit(commits, diffs.files_changed(by_hash, unique=False), 10), "hash") == kept


def test_match_tally(spark):
    commits = commit_table(spark, commit("r", "a", message="fix"), commit("r", "b"), commit("s", "c"))
    repos = spark.createDataFrame([("r", 0), ("s", 1), ("t", 2), ("r", 3)], "repo_id string, repo_ord bigint")
    tally = history.match_tally(repos, commits, F.contains("message", F.lit("fix")))
    assert rows(tally, "repo_id", "scanned", "matched") == [("r", 2, 1), ("r", 2, 1), ("s", 1, 0), ("t", 0, 0)]


def test_new_commits(spark):
    held = commit_table(spark, commit("r", "a"), commit("s", "b"))
    incoming = commit_table(spark, commit("r", "a"), commit("r", "b"), commit("r", "b"), commit("s", "a"))
    assert rows(history.new_commits(held, incoming), *COMMIT_KEY) == [("r", "b"), ("s", "a")]


def test_new_commits_of_a_landed_table(spark, tmp_path):
    path = str(tmp_path / "commits")
    land(commit_table(spark, *[commit(f"r{i}", "a") for i in range(30)]), path)
    incoming = commit_table(spark, commit("r1", "a"), commit("r1", "b"), commit("new", "a"))
    found = history.new_commits(scan_commits(spark, path), incoming)
    assert rows(found, *COMMIT_KEY) == [("new", "a"), ("r1", "b")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [repo_bucket" in plan or "PartitionFilters: [isnotnull(repo_bucket" in plan


def test_log_position_with_a_hot_repository(spark):
    rng = random.Random(5)
    data = [commit("hot", f"h{i:04}", minutes=rng.randrange(40)) for i in range(900)]
    data += [commit(f"r{rng.randrange(150)}", f"c{i:04}", minutes=rng.randrange(40)) for i in range(900)]
    want = []
    for repo in {d[0] for d in data}:
        log = sorted((d for d in data if d[0] == repo), key=lambda d: (-d[5].timestamp(), d[1]))
        want += [(repo, d[1], i + 1) for i, d in enumerate(log)]
    found = ordering.log_position(commit_table(spark, *data))
    assert rows(found, "repo_id", "hash", "log_position") == sorted(want, key=str)


def test_pages(spark):
    df = spark.createDataFrame([(i, (i * 7919) % 1000) for i in range(450)], "id int, stars int")
    order = [F.desc("stars"), F.asc("id")]
    ranked = [r["id"] for r in df.orderBy(*order).collect()]
    paged = ordering.all_pages(df, order)
    assert rows(paged, "page", "id") == sorted([(i // 100 + 1, n) for i, n in enumerate(ranked)], key=str)
    for k in (1, 2, 5, 6):
        assert [r["id"] for r in ordering.result_page(df, k, order).collect()] == ranked[100 * (k - 1):100 * k]


def test_number_rows_of_nothing(spark):
    empty = spark.createDataFrame([], "id int")
    assert ordering.number_rows(empty, [F.asc("id")]).count() == 0


def test_salted_join_equals_plain_join(spark):
    rng = random.Random(1)
    big = spark.createDataFrame(
        [("hot" if rng.random() < 0.4 else f"k{rng.randrange(9)}", i) for i in range(500)], "k string, i int"
    )
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("zz", 4)], "k string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = big.join(small, "k", how)
        salted = joins.salted_join(big, small, ["k"], F.col("i"), how)
        assert rows(salted, *plain.columns) == rows(plain, *plain.columns)


def test_salted_copies_are_not_broadcast(spark):
    big, small = spark.range(50).selectExpr("id % 5 AS k", "id AS i"), spark.range(5).selectExpr("id AS k", "id AS v")
    plan = joins.salted_join(big, small, ["k"], F.col("i"))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


@pytest.mark.parametrize("form", [diffs.tree_diff, diffs.tree_diff_by_directory])
def test_sides_of_trees_that_do_not_fit_are_shuffled(spark, monkeypatch, form):
    monkeypatch.setattr(joins, "fits_broadcast", lambda df, max_bytes=0: False)
    c = commit_table(spark, commit("r", "a", []), commit("r", "b", ["a"]))
    t = spark.createDataFrame([("r", "a", "d/p", "1", "x"), ("r", "b", "d/p", "1", "y")], TREE_ENTRIES)
    changed = form(c, t)
    assert "Broadcast" not in changed._jdf.queryExecution().executedPlan().toString()
    assert rows(changed, "hash", "path", "change_type") == [("b", "d/p", "MODIFY")]


def test_fits_broadcast(spark):
    df = spark.createDataFrame([("a" * 100, 1), (None, 2)], "s string, n int")
    size = 100 + 2 * (8 + joins.ROW_OVERHEAD)
    assert joins.fits_broadcast(df, size)
    assert not joins.fits_broadcast(df, size - 1)
    assert joins.fits_broadcast(df.limit(0), 0)


WORDS = ["fix", "Fixed", "été", "a", "ab", "abcdef", "x y", "zz.z", "  ", "naïve"]


@pytest.mark.parametrize("terms", [[], [""], ["fix"], ["a", "zz.z"], ["ABCDEF", "X Y", None], WORDS])
def test_keyword_table_forms_agree(spark, terms):
    rng = random.Random(2)
    messages = ["", None, "prefix", "ÉTÉ", *(" ".join(rng.choices(WORDS, k=3)) for _ in range(30))]
    commits = commit_table(spark, *[commit("r", str(i), message=m) for i, m in enumerate(messages)])
    table = spark.createDataFrame([(t,) for t in terms], "keyword string")
    low = [t.lower() for t in terms if t is not None]
    want = sorted((str(i),) for i, m in enumerate(messages) if m is not None and any(t in m.lower() for t in low))
    assert rows(keywords.match_keyword_table(commits, table), "hash") == want
    assert rows(keywords.match_keyword_table(commits, table, max_terms=-1), "hash") == want


def test_health_and_frequency(spark):
    def at(*stamps):
        return [("r", str(i), [], "me", t, t, "m") for i, t in enumerate(stamps)]

    times = [START, START, START + timedelta(hours=1), START + timedelta(hours=23), START + timedelta(days=3)]
    commits = commit_table(spark, *at(*times), ("one", "x", [], "me", START, START, "m"))
    found = rows(health.repo_health(commits), "repo_id", "commits", "active_days", "longest_gap_seconds")
    assert found == [("one", 1, 1, -1), ("r", 5, 2, (24 * 2 + 1) * 3600)]
    weeks = health.commit_frequency(commits.where("repo_id = 'r'"), "day")
    assert rows(weeks, F.dayofmonth("period"), "commits") == [(1, 4), (4, 1)]


def test_health_against_plain_python(spark):
    rng = random.Random(8)
    data, want = [], []
    for r in range(12):
        times = [START + timedelta(seconds=rng.randrange(10 ** rng.randrange(1, 8))) for _ in range(rng.randrange(1, 40))]
        data += [(f"r{r}", f"{r}-{i}", [], "me", t, t, "m") for i, t in enumerate(times)]
        stamps = sorted(set(times))
        gaps = [int((b - a).total_seconds()) for a, b in zip(stamps, stamps[1:])]
        want.append((f"r{r}", len(times), len({t.date() for t in times}), max(gaps, default=-1)))
    found = health.repo_health(commit_table(spark, *data))
    assert rows(found, "repo_id", "commits", "active_days", "longest_gap_seconds") == sorted(want, key=str)


def test_directories_of_odd_paths(spark):
    paths = ["a/b/c/d/e/f", "a", "", "/a", "//a", "a/", "a//b", "/", "é/ü/x", "a\n/b", "a/\n", "a\n", "////////", None]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    for depth in (1, 2, 4, 9):
        old = F.array_join(F.slice(F.split(F.regexp_replace("path", r"/?[^/]*$", ""), "/"), 1, depth), "/")
        new = df.select(old.alias("old"), diffs.path_directory(F.col("path"), depth).alias("new"))
        assert all(r["old"] == r["new"] for r in new.collect())
        assert "regexp" not in new.select("new")._jdf.queryExecution().executedPlan().toString()


def test_snapshot_entries_are_made_by_many_tasks(spark):
    plan = roles.snapshot_trees(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(p_partkey" in plan
