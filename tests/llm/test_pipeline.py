"""The pipeline against brute force, and the queries that have SQL against it."""

from __future__ import annotations

import hashlib
import os
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import check_oracle  # noqa: E402
import corpus_pipeline  # noqa: E402
from repomine.llm import packing, quality, queries  # noqa: E402
from test_text_operators import cut_by_force, held_by_force, simhash_of_rows  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"

needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the driver's tables")

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def run_by_force(spark, docs, labels, benchmark):
    """``doc_id -> words`` of the documents that reach the last stage. The classifier itself is the operator's."""
    model = quality.fit_quality(docs, labels)
    scored = quality.score_quality(docs, model).collect()
    rows = [(r["doc_id"], r["text"]) for r in scored if r["predicted"] == 1]
    groups = {}
    for (i, t), (_, _, component) in zip(rows, simhash_of_rows(rows)):
        if i is not None:
            groups.setdefault(component, []).append((i, hashlib.sha256((t or "").encode()).hexdigest(), t))
    rows = [(min(g)[0], min(g, key=lambda r: r[:2])[2]) for g in groups.values()] + [r for r in rows if r[0] is None]
    cut = [(i, kept) for i, n, gone, kept in cut_by_force(rows, 50) if not n or gone < n]
    items = [tuple(r) for r in benchmark.select("item_id", "text").collect()]
    bad = {h[0] for h in held_by_force(list(enumerate(t for _, t in cut)), items)}
    return [row for n, row in enumerate(cut) if n not in bad]


def check_run(spark, sf_dir):
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    want = run_by_force(spark, read("documents"), read("labels"), read("benchmark"))
    got = corpus_pipeline.run(spark, sf_dir).collect()
    encode = packing.encoder(packing.default_tokenizer()).encode
    expected = {i: np.append(encode(t.encode()), np.uint32(1)) for i, t in want}
    pieces = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == set(expected)
    for i, ids in expected.items():
        own = sorted(pieces[i], key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == len(ids) == own[0]["doc_tokens"]
        for r in own:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert zlib.crc32(part.astype("<u4").tobytes()) == r["ids_crc32"]
    return want


@needs_data
def test_pipeline_equals_brute_force(spark):
    assert check_run(spark, SF_DIR)


def test_stages_of_the_pipeline():
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "packing"]


def planted(spark, folder, rows, labels=(), items=()):
    spark.createDataFrame(list(rows), DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items), "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def prose(seed, count):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdeinorst"), rng.integers(2, 9))) for _ in range(count))


def test_planted_cases(spark, tmp_path):
    passage, item = prose(1, 70), prose(2, 30)
    rows = [(1, prose(3, 200)), (2, prose(3, 200)), (3, prose(4, 90) + " " + passage), (4, passage + "\n" + prose(5, 90)),
            (5, prose(6, 50) + " " + item.upper() + ". " + prose(7, 50)), (6, passage), (7, prose(8, 120)), (None, prose(9, 60)), (7, prose(8, 120))]
    sf_dir = planted(spark, tmp_path, [(i, t, "en", "s", len(t)) for i, t in rows], items=[(0, item), (1, None)])
    want = dict(check_run(spark, sf_dir))
    assert set(want) == {1, 3, 4, 7, None}  # 2 is a copy, 6 all repeated, 5 contaminated
    assert len(want[4].split()) == 90 and len(want[3].split()) == 160


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, None, None, None, None), (2, "", None, "s", 0), (3, "one", "en", None, 3), (3, "one", "en", None, 3), (4, "word " * 30000, "en", "s", 150000)]
    sf_dir = planted(spark, tmp_path / "odd", rows, labels=[(1, None, None), (None, 1, 0), (9, 1, 1)], items=[(None, "one")])
    check_run(spark, sf_dir)
    assert corpus_pipeline.run(spark, planted(spark, tmp_path / "none", [])).collect() == []


def test_no_text_is_lost_where_an_id_repeats(spark):
    a, b = prose(11, 80), prose(12, 80)
    rows = [(1, a), (5, a), (5, b)]
    for order in ([0, 1, 2], [2, 1, 0], [1, 2, 0]):
        docs = spark.createDataFrame([(*rows[n], "en", "s", 1) for n in order], DOCUMENTS)
        kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
        assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, a), (5, b)]


def test_contaminated_rows_go_without_id_too(spark, tmp_path):
    item, clean = prose(13, 30), prose(14, 50)
    rows = [(None, prose(15, 40) + " " + item), (None, clean), (3, clean + " x"), (3, item), (None, None)]
    sf_dir = planted(spark, tmp_path, [(i, t, "en", "s", 1) for i, t in rows], items=[(1, item)])
    kept = corpus_pipeline.drop_contaminated(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    assert sorted((r["text"] or "") for r in kept.collect()) == ["", clean, clean + " x"]


@needs_data
def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF_DIR)
        assert kept.columns == docs.columns and dict(kept.dtypes) == dict(docs.dtypes)


@needs_data
@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query_equals_sql(spark, name):
    _, difference = check_oracle.compare(spark, check_oracle.connect(SF_DIR), SF_DIR, name)
    assert difference == ""


def test_queries_are_named_by_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))
