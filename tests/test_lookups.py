"""The trigram index of repositories and the sieve of keys."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from repomine.operators import sieve, trigrams
from repomine.operators.joins import fits_broadcast
from repomine.operators.repos import match_domains
from repomine.plans import catalog, mining
from repomine.session import cut_lineage

REPO_DDL = "repo_id string, full_name string, description string, topics array<string>"


def repo_rows():
    rng = random.Random(4)
    draw = lambda n: "".join(rng.choice("abAB é😀ß") for _ in range(rng.randrange(n)))
    rows = [(f"r{i % 90}", draw(9), draw(30), [draw(6), None, draw(6)]) for i in range(120)]
    rows += [(None, "no id aba", None, None), ("n", None, None, None), ("e", "", "", []), ("t", "xab", "ax", ["ab", "a"])]
    return rows + rows[:3]


@pytest.mark.parametrize(
    "terms", [["aba"], ["ABé", "b a"], ["ba b a"], ["😀ß", "aab"], ["😀ab"], ["ab"], ["a", "bab"], [""], [], ["zzz"], ["aba", "ABA"], ["abab a"]]
)
def test_indexed_search_equals_plain_search(spark, terms):
    repos = spark.createDataFrame(repo_rows(), REPO_DDL)
    got = trigrams.match_domains_indexed(repos, trigrams.trigram_index(repos), terms)
    assert got.columns == repos.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, match_domains(repos, terms).collect()))


def test_trigrams_of_a_row(spark):
    rows = [("r", "aAAb", "x", ["yz", "w"]), ("r", "aaa", None, None), (None, "abc", None, None), ("s", None, None, None)]
    index = trigrams.trigram_index(spark.createDataFrame(rows, REPO_DDL))
    held = sorted(tuple(r) for r in index.select("repo_id", "gram").collect())
    assert held == sorted({("r", g) for g in ("aaa", "aab", "ab\0", "b\0x", "\0x\0", "x\0y", "\0yz", "yz\0", "z\0w")})
    assert trigrams.indexed_repos(index, ["aab"]).collect()[0][0] == "r" and trigrams.term_grams("ab") == []


def test_trigrams_reach_the_scan(spark, tmp_path):
    repos = spark.createDataFrame(repo_rows(), REPO_DDL)
    trigrams.write_index(trigrams.trigram_index(repos), str(tmp_path / "index"))
    found = trigrams.indexed_repos(spark.read.parquet(str(tmp_path / "index")), ["aba"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "EqualTo(gram,aba)" in pushed or "In(gram" in pushed


@pytest.mark.parametrize("bits", [sieve.BITMAP_BITS, 8 * sieve.BITMAP_BITS, sieve.SIEVE_BITS])
def test_sieve_keeps_all_wanted_and_few_others(spark, bits):
    table = spark.range(200_000).selectExpr("CAST(id AS STRING) AS hash", "id % 7 AS repo", "id")
    wanted = table.where("id % 100 = 3")
    kept = sieve.sift(table, sieve.key_sieve(wanted, ["hash", "repo"], bits), ["hash", "repo"], bits)
    assert kept.columns == table.columns and kept.where("id % 100 = 3").count() == 2_000
    # A false row needs the bit of one of 2,000 keys.
    assert kept.count() - 2_000 <= 198_000 * 2_000 / bits * 1.2 + 10


def test_sieve_of_no_and_null_keys(spark):
    table = spark.createDataFrame([("a",), (None,)], "hash string")
    assert sieve.sift(table, sieve.key_sieve(table.limit(0), ["hash"]), ["hash"]).collect() == []
    assert sieve.sift(table, sieve.key_sieve(table, ["hash"]), ["hash"]).count() == 2
    assert fits_broadcast(cut_lineage(sieve.key_sieve(table, ["hash"]).select("sieve_group")))
    with pytest.raises(ValueError):
        sieve.key_sieve(table, ["hash"], 1000)


def test_sieved_search_equals_plain_search(spark):
    folder = "/root/testdata/sf0.001"
    tables = catalog._mining_tables(spark, folder)
    for unique in (True, False):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            one = mining.MiningTables(commits=tables.commits, repos=tables.repos, file_changes=tables.file_changes.distinct(), unique_paths=unique)
            got = mining.mined_commits(catalog.FLAGSHIP, one, with_count=True, staged=True, small=False, prune=False)
            want = mining.mined_commits(catalog.FLAGSHIP, one, with_count=True)
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sieve_lets_few_changes_into_the_shuffle(spark):
    tables = catalog._mining_tables(spark, "/root/testdata/sf0.01")
    repos = mining.choose_repos(catalog.FLAGSHIP, tables, False)
    hits = cut_lineage(mining.keyword_commits(repos, catalog.FLAGSHIP.keywords, tables, False))
    passed = sieve.sift(tables.file_changes, sieve.key_sieve(hits, ["hash"]), ["hash"])
    exact = tables.file_changes.join(hits.select("hash"), "hash", "left_semi").count()
    assert exact <= passed.count() <= exact * 1.05 + 20
    assert "BroadcastHashJoin" in passed._jdf.queryExecution().executedPlan().toString()


def test_parts_of_a_shuffle_follow_the_data(spark):
    """Their number was that of the setting, 4 here, so a task's rows grew with the table."""
    rows = spark.range(8_000_000).select(F.xxhash64("id").alias("k"))
    assert rows.groupBy("k").count().rdd.getNumPartitions() > 4


def test_trigrams_are_made_in_tasks_of_so_many_rows(spark, monkeypatch):
    monkeypatch.setattr(trigrams, "ROWS_A_TASK", 10)
    repos = spark.createDataFrame(repo_rows(), REPO_DDL).coalesce(1)
    known = repos.where("repo_id is not null").count()
    plan = trigrams.trigram_index(repos)._jdf.queryExecution().executedPlan().toString()
    assert f"RoundRobinPartitioning({known // 10 + 1})" in plan
