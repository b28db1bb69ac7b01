"""Sources and the choice of repositories."""

from __future__ import annotations

import json

from repomine.operators import repos as ops
from repomine.plans import catalog, roles
from repomine.schemas import COUNT_RESPONSES, SEARCH_RESPONSES
from repomine.sources.lists import scan_repo_list
from repomine.sources.search import (
    commit_count_from_responses, pages_until_end, scan_search_pages, search_pages,
)

REPO_DDL = "repo_id string, full_name string, clone_url string, description string, topics array<string>, stars int"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def repo_table(spark):
    data = [
        ("a", "o/VR-kit", "u1", None, ["games"], 10),
        ("b", "o/tool", "u2", "Virtual reality", [], 9),
        ("c", "o/other", "u3", "plain", ["xr", "web"], 50),
        ("d", None, "u4", "vr", None, 99),
        ("e", "o/vr", None, None, None, 0),
    ]
    return spark.createDataFrame(data, REPO_DDL)


def test_repo_list_file(spark, tmp_path):
    lines = [
        "# comment", "", "   ", "\t# c", "https://github.com/o/r", "  github.com/o/s  ", "http://github.com/o/t.git",
        "https://gitlab.com/o/r", "https://github.com/o/r", "https://github.com/o/u/",
    ]
    path = tmp_path / "list.txt"
    path.write_bytes("\r\n".join(lines).encode())
    found = scan_repo_list(spark, str(path))
    ordered = [(r["repo_id"], r["clone_url"]) for r in found.orderBy("repo_ord").collect()]
    assert ordered == [
        ("o/r", "https://github.com/o/r.git"), ("o/s", "https://github.com/o/s.git"),
        ("o/t", "http://github.com/o/t.git"), ("o/r", "https://github.com/o/r.git"),
        ("o/u", "https://github.com/o/u.git"),
    ]


def test_match_domains(spark):
    repos = repo_table(spark)
    assert rows(ops.match_domains(repos, ["VR"]), "repo_id") == [("a",), ("d",), ("e",)]
    assert rows(ops.match_domains(repos, ["xr", "reality"]), "repo_id") == [("b",), ("c",)]
    # a term must not span two topics
    assert rows(ops.match_domains(repos, ["xrweb"]), "repo_id") == []
    assert ops.match_domains(repos, [""]).count() == ops.match_domains(repos, []).count() == 5


def test_stars_and_completeness(spark):
    repos = repo_table(spark)
    assert rows(ops.min_stars(repos, 10), "repo_id") == [("a",), ("c",), ("d",)]
    assert rows(ops.complete_repos(repos), "repo_id") == [("a",), ("b",), ("c",)]


def test_commit_count_filter(spark):
    repos = spark.createDataFrame([("a", "u", 0), ("b", "u", 1), ("a", "u", 2), ("z", "u", 3)],
                                  "repo_id string, clone_url string, repo_ord bigint")
    counts = spark.createDataFrame([("a", 5), ("b", 6)], "repo_id string, commit_count bigint")
    for broadcast in (True, False):
        counted = ops.with_commit_count(repos, counts, broadcast)
        assert rows(counted, "repo_id", "commit_count") == [("a", 5), ("a", 5), ("b", 6), ("z", 0)]

    def kept(mode, n):
        return [r[0] for r in rows(ops.commit_count_filter(counted, mode, n), "repo_id")]

    assert kept("greater", 5) == kept("GREATER", 5) == ["b"]
    assert kept("less", 5) == ["z"]
    assert kept("less", 6) == ["a", "a", "z"]
    for off in ((None, 5), ("", 5), ("other", 5), ("greater", 0), ("less", -1)):
        assert kept(*off) == ["a", "a", "b", "z"]


def page(*items):
    return json.dumps({"items": list(items)})


ITEM = {"clone_url": "https://github.com/o/r.git", "full_name": "o/r", "stargazers_count": 7}


def test_search_pages(spark, tmp_path):
    odd = [
        {"full_name": "o/s", "stargazers_count": "12"},
        {"clone_url": None, "full_name": "o/t"},
        {**ITEM, "stargazers_count": "many", "topics": ["x"], "description": "d"},
    ]
    want = [(None, "o/s", 12), (None, "o/t", 0), ("o/r", "o/r", 0), ("o/r", "o/r", 7)]

    bodies = spark.createDataFrame([(page(ITEM),), (page(*odd),), (page(),), ("junk",), ("{}",)], "body string")
    found = [tuple(r) for r in search_pages(bodies).select("repo_id", "full_name", "stars").collect()]
    assert sorted(found, key=str) == sorted(want, key=str)

    for i, body in enumerate([page(ITEM), page(*odd), page()]):
        (tmp_path / f"{i}.json").write_text(json.dumps(json.loads(body), indent=2))
    landed = scan_search_pages(spark, str(tmp_path))
    assert sorted([tuple(r) for r in landed.select("repo_id", "full_name", "stars").collect()], key=str) == sorted(
        want, key=str
    )
    assert ops.complete_repos(landed).count() == 2


def test_landed_pages_do_not_grow_with_the_table(spark, tmp_path):
    customers = spark.range(1, 1001).selectExpr(
        "id AS c_custkey", "concat('c', id) AS c_name", "7 AS c_nationkey", "'BUILDING' AS c_mktsegment", "1.5D AS c_acctbal"
    )
    customers.write.parquet(f"{tmp_path}/customer.parquet")
    pages = [json.loads(r["value"])["items"] for r in roles.page_bodies(spark, str(tmp_path)).collect()]
    assert len(pages) == 11 and max(map(len, pages)) == 200
    found = catalog.QUERIES["scan_search_pages"](spark, str(tmp_path)).collect()
    assert sorted(r["repo_id"] for r in found) == sorted([""] * 1000 + [f"org/r{i}" for i in range(1, 1001)])


def test_pages_until_end(spark):
    more = '<https://x?page=2>; rel="next"'
    data = [
        ("end", 1, 200, more, page(ITEM)), ("end", 2, 200, None, page(ITEM)), ("end", 3, 200, more, page(ITEM)),
        ("fail", 1, 200, more, page(ITEM)), ("fail", 2, 500, more, page(ITEM)), ("fail", 3, 200, None, page(ITEM)),
        ("empty", 1, 200, more, page()), ("empty", 2, 200, None, page(ITEM)),
        ("open", 1, 200, more, page(ITEM)), ("open", 2, 200, more, page(ITEM)),
    ]
    kept = pages_until_end(spark.createDataFrame(data, SEARCH_RESPONSES))
    assert rows(kept, "search_id", "page") == [("end", 1), ("end", 2), ("fail", 1), ("open", 1), ("open", 2)]


def test_commit_count_from_responses(spark):
    link = '<https://x/c?per_page=1&page=2>; rel="next", <https://x/c?per_page=1&page=734>; rel="last"'
    data = [("a", 200, link, "[{}]"), ("b", 200, None, "[{}]"), ("c", 200, None, "junk"),
            ("d", 404, link, "[{}]"), ("e", None, None, None), ("f", 200, link.replace("734", "x"), "[{}]")]
    counts = commit_count_from_responses(spark.createDataFrame(data, COUNT_RESPONSES))
    assert rows(counts, "full_name", "commit_count") == [
        ("a", 734), ("b", 1), ("c", 0), ("d", 0), ("e", 0), ("f", 0)
    ]


def test_append_pages_keeps_duplicates(spark):
    one = spark.createDataFrame([("a", 1)], "x string, y int")
    two = spark.createDataFrame([(1, "a"), (2, "b")], "y int, x string")
    assert rows(ops.append_pages(one, two, one), "x", "y") == [("a", 1), ("a", 1), ("a", 1), ("b", 2)]


def test_drop_comments(spark):
    lines = spark.createDataFrame([("# c",), ("   ",), ("\t# c",), (" a ",), ("a # b",)], "value string")
    assert rows(ops.drop_comments(lines), "value") == [("a",), ("a # b",)]
