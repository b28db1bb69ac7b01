"""Landed page files and tables written in an order."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from repomine.sources import ordered
from repomine.sources.search import broken_files, pages_until_end, scan_search_files, search_pages


def land(root, search, page, body):
    folder = root / f"search_id={search}" / f"page={page}"
    folder.mkdir(parents=True)
    (folder / "answer.json").write_text(body)


def items(*names):
    found = [{"clone_url": f"https://github.com/o/{n}.git", "full_name": f"o/{n}", "stargazers_count": 1} for n in names]
    return json.dumps({"items": found}, indent=1)


def test_broken_file_ends_its_search(spark, tmp_path):
    land(tmp_path, "whole", 1, items("a", "b"))
    land(tmp_path, "whole", 2, items("c"))
    land(tmp_path, "cut", 1, items("d"))
    land(tmp_path, "cut", 2, items("e", "f")[:-3])  # its first item can still be read
    land(tmp_path, "cut", 3, items("g"))
    land(tmp_path, "none", 1, "")  # not seen at all
    land(tmp_path, "none", 2, items("h"))
    land(tmp_path, "gap", 1, items("l"))
    land(tmp_path, "gap", 2, "")
    land(tmp_path, "gap", 3, items("m"))
    land(tmp_path, "blank", 1, " \n")
    land(tmp_path, "blank", 2, items("n"))
    land(tmp_path, "other", 1, "<html>502</html>")
    land(tmp_path, "empty", 1, items("i"))
    land(tmp_path, "empty", 2, items())
    land(tmp_path, "empty", 3, items("j"))
    land(tmp_path, "shape", 1, '{"items": 5}')
    land(tmp_path, "shape", 2, items("k"))
    read = scan_search_files(spark, str(tmp_path))
    found = search_pages(pages_until_end(read, first=1), ["search_id", "page"])
    want = [
        ("cut", 1, "o/d"), ("empty", 1, "o/i"), ("gap", 1, "o/l"),
        ("whole", 1, "o/a"), ("whole", 1, "o/b"), ("whole", 2, "o/c"),
    ]
    assert sorted((r["search_id"], r["page"], r["full_name"]) for r in found.collect()) == want
    # Without a first number, gaps end nothing.
    found = search_pages(pages_until_end(read), ["search_id", "page"])
    more = [("gap", 3, "o/m"), ("none", 2, "o/h")]
    assert sorted((r["search_id"], r["page"], r["full_name"]) for r in found.collect()) == sorted(want + more)
    broken = {(r["search_id"], r["page"]): r["file"] for r in broken_files(read).collect()}
    assert sorted(broken) == [("blank", 1), ("cut", 2), ("other", 1), ("shape", 1)]
    assert broken["cut", 2].endswith("page=2/answer.json")


def test_small_files_share_tasks(spark, tmp_path):
    for page in range(60):
        land(tmp_path, "s", page, items(str(page)))
    read = scan_search_files(spark, str(tmp_path))
    assert read.rdd.getNumPartitions() < 30
    assert read.where("status = 200").count() == 60


def keyed(rows):
    """Rows in the order (a, b descending, id): nulls first in a, last in b."""
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is None, -(r[1] or 0), r[2]))


ORDER = ["a", "-b", "id"]


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    rng = random.Random(3)
    data = [(rng.choice([None, 1, 1, 1, 2, 3]), rng.choice([None, *range(5)]), i, f"t{i}") for i in range(2_000)]
    path = str(tmp_path_factory.mktemp("ordered") / "t")
    df = spark.createDataFrame(data, "a int, b int, id int, text string").repartition(5)
    ordered.write_in_order(df, ORDER, path, every=50, parts=6)
    return keyed(data), path


def test_order_is_restored_from_files(spark, written):
    data, path = written
    found = ordered.read_in_order(spark, path).repartition(7)
    assert [tuple(r)[:4] for r in found.orderBy("row_number").collect()] == data
    assert sorted(r["row_number"] for r in found.collect()) == [*range(1, len(data) + 1)]


@pytest.mark.parametrize("first, last", [(1, 1), (1, 100), (951, 1_050), (1_999, 2_500), (2_001, 2_100), (0, 0), (1, 2_000)])
def test_rows_by_number(spark, written, first, last):
    data, path = written
    found = ordered.read_rows(spark, path, first, last, every=50).orderBy("row_number").collect()
    assert [tuple(r)[:4] for r in found] == data[max(first - 1, 0):last]


def test_deep_page_opens_the_files_of_its_range(spark, written):
    data, path = written
    every_file = {r["f"] for r in spark.read.parquet(f"{path}/rows").select(F.input_file_name().alias("f")).distinct().collect()}
    page = ordered.read_rows(spark, path, 1_001, 1_020, every=50)
    assert len(every_file) > 3 and len(page.inputFiles()) <= 2
    index = spark.read.parquet(f"{path}/index")
    assert index.count() <= len(data) / 50 + len(every_file)


def test_row_of_a_key(spark, written):
    data, path = written
    for row in (1, 2, 49, 50, 51, 777, 1_300, 2_000):
        assert ordered.row_of(spark, path, data[row - 1][:3], ORDER, every=50) == row
    assert ordered.row_of(spark, path, (9, 0, 0), ORDER, every=50) == len(data) + 1
    assert ordered.row_of(spark, path, (2, 9, -1), ORDER, every=50) == 1 + sum(r[0] in (None, 1) for r in data)


def test_order_of_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    ordered.write_in_order(spark.createDataFrame([], "a int, b int, id int"), ORDER, path)
    assert ordered.read_in_order(spark, path).count() == 0
    assert ordered.read_rows(spark, path, 1, 10).count() == 0
    assert ordered.row_of(spark, path, (1, 2, 3), ORDER) == 1
