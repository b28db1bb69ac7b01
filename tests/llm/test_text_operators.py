"""Substring removal, SimHash, SpotSigs and decontamination against brute force, and their odd rows."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from repomine.llm import decontaminate, simhash, spotsigs, substring, text

DOCS = "doc_id bigint, text string"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def groups(links, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# Words


def test_hash_words_follows_bytes_split():
    rng = random.Random(1)
    for _ in range(200):
        raw = bytes(rng.choice(b"ab \t\n\x0b\x0c\r\x1c\xc3\xa9") for _ in range(rng.randrange(40)))
        hashes, starts, ends = text.hash_words(raw)
        assert [raw[i:j] for i, j in zip(starts, ends)] == raw.split()
        seen = dict(zip(raw.split(), hashes.tolist()))
        assert [seen[w] for w in raw.split()] == hashes.tolist()
        assert len(set(seen.values())) == len(seen)


def test_hash_words_agrees_over_blocks_and_long_words(monkeypatch):
    raw = b" ".join([b"w%d" % (i % 50) for i in range(3000)] + [b"x" * 300, b"y" * 5000, b"x" * 300])
    whole = text.hash_words(raw)[0].tolist()
    monkeypatch.setattr(text, "_BLOCK_BYTES", 64)
    assert text.hash_words(raw)[0].tolist() == whole
    assert whole[-1] == whole[-3] != whole[-2]


# Substring removal


def cut_by_force(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, ws in words:
        if i is not None:
            for k in range(len(ws) - window + 1):
                w = tuple(ws[k : k + window])
                first[w] = min(first.get(w, i), i)
    out = []
    for i, ws in words:
        gone = set()
        for k in range(len(ws) - window + 1):
            if i is not None and first[tuple(ws[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(ws), len(gone), b" ".join(w for k, w in enumerate(ws) if k not in gone).decode()))
    return sorted(out, key=str)


def cut(df, **options):
    rows = substring.remove_repeats(df, **options).select("doc_id", "n_words", "n_removed", "text").collect()
    return sorted(((r[0], r[1], r[2], " ".join(r[3].encode().decode().split())) for r in rows), key=str)


@pytest.mark.parametrize("window,period,cover", [(6, 3, (0, 1)), (5, 1, (0,)), (50, 31, substring.COVER)])
def test_substring_equals_brute_force(spark, window, period, cover):
    rng = random.Random(window)
    passages = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(window + rng.randrange(20))) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choice("klmnop") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(5))]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(100, rows[5][1]), (101, rows[5][1]), (101, passages[1] + " tail of its own"), (101, " ".join(f"own{i}" for i in range(70))), (102, ""), (103, None), (None, passages[0]), (104, passages[0] * 1 + " " + passages[0])]
    assert cut(frame(spark, rows), window=window, period=period, cover=cover) == cut_by_force(rows, window)


def test_substring_keeps_other_columns_rows_and_gaps(spark):
    shared = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"a\n\nb  {shared}", "x", 9), (2, f"c\n d {shared}\te", "y", 9), (2, f"c\n d {shared}\te", "y", 9), (3, None, None, None)]
    got = substring.remove_repeats(frame(spark, rows, "doc_id bigint, text string, removed string, n_words int")).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == [rows[0][1], "c\n d\ne", "c\n d\ne", ""]
    assert [(r["n_words"], r["n_removed"]) for r in got] == [(62, 0), (63, 60), (63, 60), (0, 0)]
    assert [(s["start"], s["end"]) for s in got[1]["removed"]] == [(2, 62)]
    assert substring.remove_repeats(frame(spark, [])).collect() == []


def test_substring_refuses_a_cover_with_gaps(spark):
    with pytest.raises(ValueError):
        substring.remove_repeats(frame(spark, []), 10, 5, (0, 1))


# SimHash


def test_covering_masks_meet_every_pair_within_the_radius():
    rng = random.Random(3)
    for radius in (1, 2, 3, 4):
        masks = simhash.covering_masks(radius)
        for _ in range(3000):
            difference = sum(1 << i for i in rng.sample(range(64), radius))
            assert any(difference & m == 0 for m in masks)


def simhash_of_rows(rows, radius=3, shingle=3):
    fps = [simhash.fingerprint((t or "").encode(), shingle) for _, t in rows]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= radius]
    root = groups(near, range(len(rows)))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(least.get(root[k], i), i)
    return [(i, f"{f:016x}", least.get(root[k])) for k, ((i, _), f) in enumerate(zip(rows, fps))]


def simhash_by_force(rows, radius=3, shingle=3):
    return sorted(simhash_of_rows(rows, radius, shingle), key=str)


@pytest.mark.parametrize("compared_at_once", [simhash.COMPARED_AT_ONCE, 1])
def test_simhash_equals_brute_force(spark, compared_at_once):
    rng = random.Random(7)
    base = [" ".join(rng.choice("abcdefghij") * 2 for _ in range(80)) for _ in range(6)]
    rows = []
    for i in range(120):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = rng.choice("xyz")
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, " \n"), (203, "One"), (204, "one"), (205, "a b"), (None, base[0]), (None, "alone here now"), (3, rows[3][1])]
    got = simhash.near_duplicates(frame(spark, rows), compared_at_once=compared_at_once)
    assert sorted(map(tuple, got.collect()), key=str) == simhash_by_force(rows)


def test_simhash_of_nothing_and_with_clashing_columns(spark):
    assert simhash.near_duplicates(frame(spark, [])).collect() == []
    rows = frame(spark, [(4, "a b c d", 1, "k"), (2, "A b C d", 2, "l")], "doc_id bigint, text string, fp int, component_id string")
    assert {(r[0], r[2]) for r in simhash.near_duplicates(rows).collect()} == {(4, 2), (2, 2)}


def test_components_of_a_long_chain(spark):
    from repomine.llm.components import connected_components

    links = [(i, i + 1) for i in range(300)] + [(500, 501), (7, 7), (None, 3)]
    got = dict(map(tuple, connected_components(frame(spark, links, "a bigint, b bigint")).collect()))
    assert got == {i: 0 for i in range(301)} | {500: 500, 501: 500}


# SpotSigs

COMMON = set(spotsigs.COMMON_WORDS)


def spots_by_force(raw):
    pieces, run = [], ()
    for word in re.findall(r"[^\W_]+", (raw or "").lower()):
        if word in COMMON:
            run += (word,)
        else:
            pieces.append((run, word))
            run = ()
    if run:
        pieces.append((run[:-1], run[-1]))
    chains = {(a, *(w for _, w in pieces[i : i + 3])) for i, (a, _) in enumerate(pieces) if a or i == 0}
    return chains


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def spot_rows(seed, count):
    rng = random.Random(seed)
    words = ["the", "of", "und", "que", "cat", "dog", "Tree", "été", "x1", "run", "sky.", "(sea)", "--"]
    return [(3 * i, " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for i in range(count)]


def test_spots_and_likeness_equal_brute_force(spark):
    rows = spot_rows(1, 60) + [(905, "to " * 40000), (906, "cat " + "to the " * 30000 + "dog"), (907, "x" * 100000), (900, None), (901, ""), (902, "the of"), (903, "..."), (904, "cat")]
    signed = {r[0]: r for r in spotsigs.fingerprints(frame(spark, rows)).collect()}
    sets = {i: spots_by_force(t) for i, t in rows}
    assert {i: len(r["signatures"]) for i, r in signed.items()} == {i: len(s) for i, s in sets.items()}
    for a, b in zip(list(sets), list(sets)[1:]):
        x, y = set(signed[a]["signatures"]), set(signed[b]["signatures"])
        assert jaccard(x, y) == jaccard(sets[a], sets[b])
        assert (signed[a]["fingerprint"] == signed[b]["fingerprint"]) == (sets[a] == sets[b])


def sparse_spots_by_force(raw):
    pieces, run = [], ()
    for word in re.findall(r"[^\W_]+", raw.lower()):
        if word in COMMON:
            run += (word,)
        else:
            pieces.append((run, word))
            run = ()
    if run:
        pieces.append((run[:-1], run[-1]))
    anchored = [i for i, (a, _) in enumerate(pieces) if a or i == 0]
    begin = [i for i in range(len(pieces)) if i in anchored or i - max(k for k in anchored if k <= i) >= 12]
    return {(pieces[i][0], *(w for _, w in pieces[i : i + 3])) for i in begin}


def test_texts_with_few_common_words_are_covered(spark):
    rng = random.Random(12)
    plain = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    other = plain[:3] + [f"v{rng.randrange(10**6)}" for _ in range(397)]
    texts = [plain, other, ["opening"] + plain, plain[:300] + ["the"] + other[300:], plain[:20] + ["of", "the"] + plain[20:200], plain[:12], plain[:13]]
    texts += [[rng.choice(["the", *plain[:30]]) for _ in range(rng.randrange(90))] for _ in range(30)]
    texts = [" ".join(t) for t in texts]
    signed = dict(spotsigs.fingerprints(frame(spark, list(enumerate(texts)))).select("doc_id", "signatures").collect())
    sets = [sparse_spots_by_force(t) if t else set() for t in texts]
    assert [len(signed[i]) for i in range(len(texts))] == [len(s) for s in sets]
    alike = lambda a, b: jaccard(set(signed[a]), set(signed[b]))
    assert all(alike(a, b) == jaccard(sets[a], sets[b]) for a in range(8) for b in range(len(texts)))
    # Only the first words are equal; only the first word is new; the last quarter is new.
    assert alike(0, 1) < 0.01 and alike(0, 2) > 0.98 and 0.5 < alike(0, 3) < 0.7
    pairs, members = spotsigs.near_duplicates(frame(spark, [(i, texts[i]) for i in range(3)]))
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(0, 2)} and len(set(members.select("class_id").collect())) == 3


@pytest.mark.parametrize("slice_chars", [1 << 24, 50, 400])
def test_next_text_goes_round_whatever_the_slices(spark, slice_chars):
    rows = spot_rows(2, 50) + [(30, "again"), (30, "again"), (None, "no id"), (7, None)]
    random.Random(5).shuffle(rows)
    order = sorted([(-1 if i is None else i, t or "") for i, t in rows])
    want = sorted((i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order))
    got = spotsigs.with_next_text(frame(spark, rows), slice_chars).collect()
    assert sorted((-1 if r[0] is None else r[0], r[1], r[2]) for r in got) == want


def test_next_text_of_one_and_no_row(spark):
    assert spotsigs.with_next_text(frame(spark, [])).collect() == []
    assert [tuple(r) for r in spotsigs.with_next_text(frame(spark, [(5, "a")])).collect()] == [(5, "a", "a")]


def test_edited_text_counts_code_points(spark):
    row = frame(spark, [("añb😀cdeé", "😀😀ü")], "a string, b string").select(spotsigs.edited_text(F.col("a"), F.col("b"))).first()
    assert row[0] == "añb😀cd😀😀"
    row = frame(spark, [("abcdefgh", "z")], "a string, b string").select(spotsigs.edited_text(F.col("a"), F.col("b"))).first()
    assert row[0] == "abcdefz"


def test_spotsigs_near_duplicates_equal_brute_force(spark):
    rng = random.Random(9)
    rows = spot_rows(4, 30)
    for i, (_, raw) in enumerate(rows[:12]):
        words = raw.split()
        if words:
            words[rng.randrange(len(words))] = "moon"
        rows += [(1000 + i, " ".join(words)), (2000 + i, raw)]
    rows += [(3000, None), (3001, ""), (None, "the cat")]
    pairs, members = spotsigs.near_duplicates(frame(spark, rows), 0.6)
    sets = {i: frozenset(spots_by_force(t)) for i, t in rows if i is not None}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    assert {tuple(r) for r in members.collect()} == {(i, first[s]) for i, s in sets.items()}
    ids = sorted(first.values())
    want = {(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= 0.6}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want


# Decontamination


def held_by_force(docs, items, least=0.8, shingle=5):
    out = []
    for doc, raw in docs:
        words = decontaminate.text_words(raw)
        for item, wanted in items:
            target = decontaminate.text_words(wanted)
            if item is None or not target:
                continue
            size = min(shingle, len(target))
            grams = set(zip(*(target[k:] for k in range(size))))
            own = set(zip(*(words[k:] for k in range(size))))
            if len(grams & own) >= least * len(grams) - 1e-9:
                out.append((doc, item, len(grams & own), len(grams)))
    return sorted(out, key=str)


def test_a_worker_sketches_a_block_once(monkeypatch):
    class Block:
        value = [(1, "one two three four five six")]

    made = []
    monkeypatch.setattr(decontaminate, "sketch_items", lambda *args: made.append(args) or [len(made)])
    monkeypatch.setattr(decontaminate, "_held", {})
    got = [decontaminate._sketches_of(name, Block, 5, 0.8) for name in ("a", "a", "b", "b", "a")]
    assert got == [[1], [1], [2], [2], [3]] and len(decontaminate._held) == 1


@pytest.mark.parametrize("block_chars", [1 << 25, 300])
def test_decontamination_equals_brute_force(spark, block_chars):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 6, 12, 30, 60])))) for i in range(25)]
    items += [(90, None), (91, "..."), (None, "w1 w2"), (92, items[4][1])]
    docs = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(120))]
        if rng.random() < 0.7:
            planted = decontaminate.text_words(rng.choice(items[:25])[1])
            for _ in range(rng.randrange(3)):
                planted[rng.randrange(len(planted))] = "other"
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() + "," for w in planted]
        docs.append((i, " ".join(words)))
    docs += [(100, None), (101, ""), (None, docs[0][1]), (0, docs[0][1])]
    got = decontaminate.benchmark_matches(frame(spark, docs), frame(spark, items, "item_id bigint, text string"), block_chars=block_chars)
    assert sorted(((r[0], r[1], r[2], r[3]) for r in got.collect()), key=str) == held_by_force(docs, items)


def test_decontamination_of_nothing(spark):
    some, none = frame(spark, [(1, "a b c d e f")]), frame(spark, [], "item_id bigint, text string")
    assert decontaminate.benchmark_matches(some, none).collect() == []
    items = frame(spark, [(1, "a b c d e f")], "item_id bigint, text string")
    assert decontaminate.benchmark_matches(frame(spark, []), items).collect() == []
    clash = frame(spark, [(1, "x a b c d e f", 5, 6)], "doc_id bigint, text string, item_id int, matched int")
    assert [tuple(r)[:2] for r in decontaminate.benchmark_matches(clash, items).collect()] == [(1, 1)]


def test_columns_of_any_name_pass_through_the_cut(spark):
    same = " ".join(f"w{i}" for i in range(60))
    odd = frame(spark, [(1, same), (2, same), (3, None)]).select("*", *[F.lit("k").alias(c) for c in ("_keys", "_checks", "_Copies", "key", "low")])
    got = {r["doc_id"]: r for r in substring.remove_repeats(odd).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["n_removed"] == 60 and got[3]["_Copies"] == "k"


def test_hot_joins_of_links_have_exchanges_of_their_own(spark):
    """With broadcasts off no side of a join that goes by a hot key is an aggregate right below it."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        from repomine.llm import components

        edges = spark.range(50).selectExpr("id AS a", "id + 1 AS b")
        for larger_only in (True, False):
            plan = components._stars(edges, larger_only)._jdf.queryExecution().executedPlan().toString()
            join = plan.index("SortMergeJoin")
            assert "HashAggregate" not in plan[join:]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
