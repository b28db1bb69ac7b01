"""Landed answers with retries and several searches, runs with history, long keyword lists, plans."""

from __future__ import annotations

import json
import random
import re
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from repomine import MiningQuery, MiningTables, mine
from repomine.__main__ import main as command_line
from repomine.functions.text import terms_pattern
from repomine.operators import keywords, ordering
from repomine.operators.diffs import files_changed
from repomine.operators.repos import with_commit_count
from repomine.plans import mining
from repomine.schemas import (
    COMMIT_COUNTS, COMMITS, COUNT_RESPONSES, FILE_CHANGES, REPOS, SEARCH_RESPONSES, TREE_ENTRIES,
)
from repomine.sources import tables as landed_tables
from repomine.sources.search import commit_count_from_responses, pages_until_end, repos_from_responses

AT = datetime(2024, 1, 1)
MORE = '<https://x/s?page=9>; rel="next"'
LAST = '<https://x/c?per_page=1&page={}>; rel="last"'


def answer(search, page, status, link, *names):
    items = [{"clone_url": f"https://github.com/{n}.git", "full_name": n, "stargazers_count": 20} for n in names]
    return (search, page, status, link, json.dumps({"items": items}) if names else None)


def repos_of(spark, rows, search=None):
    found = repos_from_responses(spark.createDataFrame(rows, SEARCH_RESPONSES), search)
    return [r["repo_id"] for r in found.orderBy("repo_ord").collect()]


def test_a_retried_page_does_not_end_the_search(spark):
    rows = [answer("s", 1, 200, MORE, "o/a"), answer("s", 2, 502, None), answer("s", 2, 200, MORE, "o/b"), answer("s", 3, 200, None, "o/c")]
    assert repos_of(spark, rows) == ["o/a", "o/b", "o/c"]
    assert repos_of(spark, rows[:2] + rows[3:]) == ["o/a"]


def test_a_page_answered_twice_counts_once(spark):
    rows = [answer("s", 1, 200, MORE, "o/a", "o/b"), answer("s", 1, 200, MORE, "o/a", "o/b"), answer("s", 2, 200, None, "o/c")]
    assert repos_of(spark, rows) == ["o/a", "o/b", "o/c"]
    assert pages_until_end(spark.createDataFrame(rows, SEARCH_RESPONSES)).count() == 2


def test_searches_follow_each_other_in_the_report(spark):
    names = [f"o/p{i:03}" for i in range(150)]
    rows = [answer("s2", 1, 200, None, "o/x", "o/y"), answer("s1", 2, 200, None, "o/z"), answer("s1", 1, 200, MORE, *names)]
    assert repos_of(spark, rows) == [*names, "o/z", "o/x", "o/y"]
    assert repos_of(spark, rows, "s2") == ["o/x", "o/y"]


@pytest.mark.parametrize("order", [1, -1])
def test_a_retried_count_is_one_number(spark, order):
    rows = [("o/a", 502, None, None), ("o/a", 200, LAST.format(9), None), ("o/b", 500, LAST.format(7), "[{}]"), ("o/c", 200, None, "[{}]")][::order]
    counts = commit_count_from_responses(spark.createDataFrame(rows, COUNT_RESPONSES))
    assert sorted(map(tuple, counts.collect())) == [("o/a", 9), ("o/b", 0), ("o/c", 1)]


def test_repeated_counts_do_not_repeat_a_repository(spark):
    repos = spark.createDataFrame([("o/a", "o/a", "u", None, [], 1, 0)], REPOS)
    counts = spark.createDataFrame([("o/a", 9), ("o/a", 0)], COMMIT_COUNTS)
    for broadcast in (True, False):
        assert [r["commit_count"] for r in with_commit_count(repos, counts, broadcast).collect()] == [9]


def test_answers_of_a_service_are_not_searched_again(spark):
    repos = repos_from_responses(spark.createDataFrame([answer("s", 1, 200, None, "o/a", "o/b")], SEARCH_RESPONSES))
    commits = spark.createDataFrame([("o/a", "a1", [], "Ann", AT, AT, "fix")], COMMITS)
    found = MiningTables(commits, repos, spark.createDataFrame([], FILE_CHANGES), answered=True)
    query = MiningQuery(["virtual reality"], ["fix"])
    assert [r["commit_hash"] for r in mine(query, found).collect()] == ["a1"]
    assert mine(query, MiningTables(commits, repos, found.file_changes)).collect() == []


def test_command_line_with_landed_answers_files_and_history(spark, tmp_path):
    path = {n: str(tmp_path / n) for n in ("answers", "commits", "changes", "out", "past")}
    spark.createDataFrame([answer("s", 1, 200, None, "o/a"), answer("t", 1, 200, None, "o/b")], SEARCH_RESPONSES).write.parquet(path["answers"])
    commits = [("o/a", "a1", [], "Ann", AT, AT, "fix it"), ("o/a", "a2", ["a1"], "Ann", AT, AT, "fix"), ("o/b", "b1", [], "Bo", AT, AT, "fix")]
    marked = spark.createDataFrame(commits, COMMITS).withColumn("diff_ok", F.col("hash") != "a2")
    landed_tables.land(marked, path["commits"])
    spark.createDataFrame([("o/a", "a1", "p", "ADD"), ("o/a", "a1", "q", "ADD")], FILE_CHANGES).write.parquet(path["changes"])
    common = ["search", "--search-responses", path["answers"], "--search-id", "s", "--domains", "virtual reality",
              "--commits", path["commits"], "--file-changes", path["changes"], "--out", path["out"], "--history", path["past"]]
    assert command_line([*common, "--keywords", "fix", "--with-files"]).endswith("with 1 commits from 1 repositories")
    (report,) = (tmp_path / "out").iterdir()
    lines = sorted((r["value"] for r in spark.read.text(str(report)).collect()), reverse=True)
    assert lines[1] == '"Commit URL","Commit Hash","Author","Date","Message","Repository","Files Changed"'
    assert lines[0].endswith('"fix it","https://github.com/o/a.git","2"')
    assert command_line([*common, "--keywords", "absent"]) == "No relevant commits found."
    assert len(list((tmp_path / "out").iterdir())) == 1
    past = {(r["keywords"], r["repos_scanned"], r["commits_matched"], r["status"]) for r in spark.read.parquet(path["past"]).collect()}
    assert past == {("fix", 1, 1, "Successfully generated report with 1 commits from 1 repositories"), ("absent", 1, 0, "No relevant commits found.")}


def test_commits_without_the_mark_are_readable(spark, tmp_path):
    landed_tables.land(spark.createDataFrame([("o/a", "a1", [], "Ann", AT, AT, "fix")], COMMITS), str(tmp_path / "c"))
    rows = landed_tables.scan_commits(spark, str(tmp_path / "c"))
    assert rows.first()["diff_ok"] is None
    repos = spark.createDataFrame([("o/a", "o/a", "https://github.com/o/a.git", None, [], 1, 0)], REPOS)
    assert mine(MiningQuery([], ["fix"]), MiningTables(rows, repos, spark.createDataFrame([], FILE_CHANGES))).count() == 1


# Keyword lists


def test_nested_terms_make_a_pattern():
    terms = ["a" * n + "b" for n in range(1, 1101)]
    pattern = re.compile(terms_pattern(terms))
    assert pattern.search("xx" + "a" * 400 + "b") and not pattern.search("a" * 500)


def test_nested_terms_are_found_by_spark(spark):
    terms = ["c" + "a" * n + "b" for n in range(1, 1101)]
    rows = spark.createDataFrame([(1, "x c" + "a" * 600 + "b"), (2, "c" + "a" * 50), (3, "cb")], "i int, t string")
    from repomine.functions.text import contains_any

    assert [r["i"] for r in rows.where(contains_any(F.col("t"), terms)).collect()] == [1]


@pytest.mark.parametrize("broadcast", [True, False])
def test_long_lists_by_pieces(spark, monkeypatch, broadcast):
    import repomine.operators.joins as joins

    monkeypatch.setattr(joins, "fits_broadcast", lambda df, max_bytes=0: broadcast)
    texts = ["fix it", "see https://github.com/o/repository/9", "https://github.com/o/other", "É là", "x", "", None, "aXb" * 50]
    commits = spark.createDataFrame([("r", str(i), t) for i, t in enumerate(texts)], "repo_id string, hash string, message string")
    terms = [f"https://github.com/o/repository/{i}" for i in range(200)] + ["FIX", "é", "q", "xbax", None]
    for chosen in (terms, ["absent"], [None], ["x"], ["", "fix"]):
        table = spark.createDataFrame([(t,) for t in chosen], "keyword string")
        want = [i for i, t in enumerate(texts) if t is not None and any(k is not None and k.lower() in t.lower() for k in chosen)]
        got = keywords.match_keyword_table(commits, table, max_terms=-1)
        assert sorted(int(r["hash"]) for r in got.collect()) == want


def least_by_force(text, winnow):
    """The pieces that have the least hash of a window, by Spark's hash of each."""
    at = [i + len(winnow.after) for i in range(len(text)) if text.startswith(winnow.after, i)]
    return [text[i : i + winnow.length] for i in at if i + winnow.length <= len(text)]


@pytest.mark.parametrize("winnow", [*keywords.WINNOWS, keywords.Winnow(3, 5, "a"), keywords.Winnow(2, 7)])
def test_winnowing_keeps_the_least_of_every_window(spark, winnow):
    rng = random.Random(4)
    texts = ["", "a", "é a", *("".join(rng.choice("ab cé") for _ in range(rng.randrange(80))) for _ in range(60))]
    frame = spark.createDataFrame([(t, least_by_force(t, winnow)) for t in texts], "t string, p array<string>")
    kind = F.lit(keywords.WINNOWS.index(winnow) if winnow in keywords.WINNOWS else -1)
    both = frame.select(keywords.winnowed(F.col("t"), winnow).alias("got"), F.transform("p", lambda x: F.xxhash64(x, kind)).alias("h"))
    for row in both.collect():
        h = row["h"]
        assert set(row["got"]) == {min(h[i : i + winnow.window]) for i in range(len(h) - winnow.window + 1)}


def test_terms_of_every_length_are_found_wherever_they_stand(spark):
    rng = random.Random(6)
    base = "".join(rng.choice("ab c𝄞") for _ in range(4000))
    terms = [base[i : i + n] for n in [*range(1, 45), 60, 90, 130, 200] for i in rng.sample(range(3000), 2)]
    absent = [t + "#" for t in terms]
    texts = [base[i : i + 300] for i in range(0, 4000, 150)]
    commits = spark.createDataFrame([("r", str(i), t.upper()) for i, t in enumerate(texts)], "repo_id string, hash string, message string")
    for term in rng.sample(terms, 12) + rng.sample(absent, 2):
        table = spark.createDataFrame([(term,), ("no such thing", )], "keyword string")
        got = keywords.match_keyword_table(commits, table, max_terms=-1)
        assert sorted(int(r["hash"]) for r in got.collect()) == [i for i, t in enumerate(texts) if term in t]


def test_winnowing_sends_a_third_of_the_pieces_or_less(spark):
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.lower("text").alias("t"))
    every = F.size(F.array_distinct(F.regexp_extract_all("t", F.lit("(?s)(?=(.{16}))"), 1)))
    sums = text.agg(F.sum(every), *[F.sum(F.size(keywords.winnowed(F.col("t"), w))) for w in keywords.WINNOWS[:2]]).first()
    assert 3 * sums[1] < sums[0] and 3 * sums[2] < sums[0]


def test_pieces_are_linear_in_the_text(spark):
    def seconds(size):
        row = spark.range(1).select(F.expr(f"repeat('abcdefgh ', {size // 9})").alias("t")).repartition(1)
        pieces = row.select(*[F.size(keywords.winnowed(F.col("t"), w)).alias(f"n{i}") for i, w in enumerate(keywords.WINNOWS)])
        pieces.collect()
        start = time.perf_counter()
        pieces.collect()
        return time.perf_counter() - start

    # Eight times the text: far from the 64 times of a search that starts anew at each place.
    assert seconds(160_000) < 24 * max(seconds(20_000), 0.05)


# Plans


def test_changes_that_repeat_a_path_are_shuffled_once(spark, tmp_path, monkeypatch):
    spark.createDataFrame([("o/a", "a1", "p", "ADD")], FILE_CHANGES).drop("repo_id").write.parquet(str(tmp_path / "c"))
    changes = spark.read.parquet(str(tmp_path / "c"))
    commits = spark.createDataFrame([("o/a", "a1", [], "Ann", AT, AT, "fix")], COMMITS)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = commits.select("hash", "repo_id")
        counts = mining.change_counts(hits, MiningTables(commits, file_changes=changes, unique_paths=False))
        plan = counts._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2  # the changes, and the hits
    assert [tuple(r) for r in counts.collect()] == [("a1", 1)]


def test_trees_are_pruned_by_the_repositories(spark, tmp_path):
    trees = spark.createDataFrame([("o/a", "a1", "p", "1", "x"), ("o/b", "b1", "p", "1", "x")], TREE_ENTRIES)
    landed_tables.land(trees, str(tmp_path / "t"))
    landed = spark.read.parquet(str(tmp_path / "t"))
    commits = spark.createDataFrame([("o/a", "a1", ["a0"], "Ann", AT, AT, "fix")], COMMITS)
    repos = spark.createDataFrame([("o/a",), ("p/a",)], "repo_id string").where("repo_id < 'p'")
    counts = mining.change_counts(commits, MiningTables(commits, tree_entries=landed), repos)
    assert "dynamicpruning" in counts._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in counts.collect()] == [("o/a", "a1", 1)]
    assert files_changed(landed).count() == 2


def test_a_deep_page_is_the_same_as_a_sorted_one(spark, monkeypatch):
    rows = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x"))
    want = [r["x"] for r in ordering.result_page(rows, 7, [F.asc("x")], 30).collect()]
    monkeypatch.setattr(ordering, "TOP_ROWS", 10)
    assert sorted(r["x"] for r in ordering.result_page(rows, 7, [F.asc("x")], 30).collect()) == want == list(range(180, 210))
