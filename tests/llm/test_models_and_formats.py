"""Quality, toxicity, packing, chat format, token counts and HTML: round trips, accuracy and odd rows."""

from __future__ import annotations

import os
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from repomine.llm import chat_format, html_extract, packing, quality, token_counts, toxicity
from repomine.llm.stats import NAMES, text_statistics

SF_DIR = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string"

needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the driver's tables")


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def table(spark, name):
    return spark.read.parquet(f"{SF_DIR}/{name}.parquet")


ODD = [(1, None), (2, ""), (None, "Some words here."), (3, "x" * 20000 + " \n\t é😀"), (4, "a"), (4, "a"), (5, " \n ")]

# Quality


def test_statistics_are_finite_for_any_text():
    for _, text in ODD:
        values = text_statistics((text or "").encode())
        assert len(values) == len(NAMES) and np.isfinite(values).all()


def test_isotonic_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(20):
        n = int(rng.integers(1, 12))
        weight, total = rng.integers(1, 5, n).astype(float), rng.integers(0, 5, n).astype(float)
        knots, levels = quality.isotonic(np.arange(n, dtype=float), total, weight)
        got = np.interp(np.arange(n), knots, levels)
        # The i-th fitted value is the greatest mean from below of the least mean from above.
        mean = lambda a, b: total[a:b].sum() / weight[a:b].sum()
        want = [max(min(mean(a, b) for b in range(i + 1, n + 1)) for a in range(i + 1)) for i in range(n)]
        assert np.allclose(got, want)


def test_random_features_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(1)
    kernel = quality.Kernel.draw(np.zeros(4), np.ones(4), 4000, 3)
    x = rng.normal(size=(6, 4))
    z = kernel.features(x)[:, :-1] / np.sqrt(4000)
    distance = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.allclose(z @ z.T, np.exp(-distance / (2 * 4)), atol=0.08)


@needs_data
def test_quality_on_held_out_rows(spark):
    got = quality.op9_quality(spark, SF_DIR).toPandas()
    assert len(got) == table(spark, "documents").count() and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    held = got[got.held_out].merge(table(spark, "labels").toPandas(), on="doc_id")
    good, bad = held[held.quality == 1], held[held.quality == 0]
    assert len(bad) >= 5 and (good.predicted == 1).mean() > 0.97 and (bad.predicted == 0).mean() > 0.8


@needs_data
def test_quality_does_not_look_at_held_out_labels(spark):
    docs, labels = table(spark, "documents").limit(300).cache(), table(spark, "labels")
    flipped = labels.withColumn("quality", F.when(quality.fold_of(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (quality.fit_quality(docs, x) for x in (labels, flipped))
    assert np.array_equal(one.weights, two.weights) and np.array_equal(one.levels, two.levels)


def test_quality_of_odd_rows_and_without_labels(spark):
    labels = "doc_id bigint, quality int"
    docs = frame(spark, [(i, t, 0.5, "k") for i, t in ODD], "doc_id bigint, text string, score double, note string")
    for rows, share in (([], 1.0), ([(1, 1), (None, 0), (2, None)], 1.0), ([(1, 0), (2, 0), (3, 0), (4, 0)], 0.0)):
        model = quality.fit_quality(docs, frame(spark, rows, labels))
        got = quality.score_quality(docs, model)
        assert got.columns == ["doc_id", "text", "note", "score", "predicted"]
        assert {r["score"] for r in got.collect()} == {share} and got.count() == len(ODD)
        short = quality.score_statistics(quality.statistics(docs), model)
        assert [r[0] for r in short.select("score").collect()] == [share] * len(ODD)
    empty = frame(spark, [])
    assert quality.score_quality(empty, quality.fit_quality(empty, frame(spark, [], labels))).collect() == []


@needs_data
def test_scores_of_written_statistics(spark):
    docs = table(spark, "documents").limit(300).cache()
    model = quality.fit_quality(docs, table(spark, "labels"))
    want = quality.score_quality(docs, model).select("doc_id", "score", "predicted")
    got = quality.score_statistics(quality.statistics(docs), model)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


# Toxicity


@needs_data
def test_toxicity_on_held_out_rows(spark):
    got = toxicity.op4_toxicity(spark, SF_DIR).toPandas()
    assert len(got) == table(spark, "documents").count()
    held = got[got.held_out].merge(table(spark, "labels").toPandas().rename(columns={"toxic": "label"}), on="doc_id")
    toxic, clean = held[held.label == 1], held[held.label == 0]
    assert (toxic.toxic == 1).mean() >= 0.5 and (clean.toxic == 0).mean() > 0.97


def test_chain_feeds_earlier_probabilities_to_later_models():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (400, 3)).astype(float)
    first = x[:, 0]
    second = ((first + x[:, 1]) == 2).astype(float)
    chain = toxicity.fit_chain(x, np.stack([first, second], 1), np.arange(400) % 4, np.ones(400), ["a", "b"], ["u", "v", "w"])
    assert [len(m.weights) for m in chain.models] == [3, 4]
    p = chain.probabilities(x)
    assert ((p[:, 0] > 0.5) == first).all() and ((p[:, 1] > 0.5) == second).all()
    # The second model sees the first one's answer: without it, the answer changes.
    changed = chain.models[1].probability(np.hstack([x, 1 - p[:, :1]]))
    assert np.abs(changed - p[:, 1]).max() > 0.05


def test_later_toxic_categories_are_learned_in_every_language(spark):
    rng = random.Random(8)
    rows, labels, stems = [], [], {"en": ("idiot", "stupid"), "fr": ("réeux", "carot"), "de": ("achli", "keitz"), "": ("bomen", "zutta")}
    for i in range(480):
        lang = [*stems][i % 4]
        words = [f"{lang}{rng.randrange(60)}" for _ in range(40)]
        toxic = int(i % 3 == 0)
        if toxic:
            ending = "" if lang == "en" else "qwe"[rng.randrange(3)]
            words[rng.randrange(40)] = rng.choice(stems[lang]) + ending
        rows.append((i, " ".join(words), lang or None))
        labels.append((i, toxic))
    docs = frame(spark, rows, "doc_id bigint, text string, lang string")
    chain = toxicity.fit_toxicity(docs, frame(spark, labels, "doc_id bigint, toxic int"), ["toxic"], toxicity.KINDS)
    assert set(chain.terms) == {"fr", "de", ""}
    got = toxicity.score_toxicity(docs, chain).toPandas()
    for i, lang in enumerate(stems):
        held = got[(got.doc_id % 4 == i) & (got.doc_id % 3 == 0)]
        assert (held.toxic == 1).mean() > 0.9 and ((held.insult == 1) ^ (held.contempt == 1)).mean() > 0.9
        assert held.insult.sum() > 5 and held.contempt.sum() > 5
        if lang in chain.terms:  # Forms of a word are one kind.
            for kind, other in (("insult", "contempt"), ("contempt", "insult")):
                ours, theirs = chain.terms[lang][kind], {t.rstrip("*") for t in chain.terms[lang][other]}
                assert ours and not any(t.startswith(x) for t in ours for x in theirs)
    assert got[got.doc_id % 3 != 0][["toxic", "insult", "contempt"]].to_numpy().mean() < 0.03


def test_every_language_has_terms_however_many_there_are(spark):
    rows = []
    for lang in range(80):
        for i in range(30):
            word = ("badly" if i < 3 else "worse") if i < 6 else "nice"
            rows.append((f"{word}{lang:02d}q w{i}", f"l{lang:02d}", int(i < 6), 0, 0))
    sample = frame(spark, rows, "text string, lang string, y0 int, y1 int, y2 int")
    terms = toxicity.own_terms(sample, "y0", ["y1", "y2"], ["insult", "contempt"])
    assert set(terms) == {f"l{n:02d}" for n in range(80)} and toxicity.own_terms(sample.limit(0), "y0", ["y1", "y2"], ["a", "b"]) == {}


def test_a_left_out_fold_uses_its_own_columns():
    rng = np.random.default_rng(1)
    x = rng.random((200, 3))
    y = np.stack([x[:, 0] > 0.5, x[:, 0] > 0.4], 1).astype(float)
    folds = np.arange(200) % 2
    asked = ["a", "b"], ["u", "v"]
    blind = toxicity.fit_chain(x, y, folds, np.ones(200), *asked, {0: np.array([2]), 1: np.array([2])})
    seeing = toxicity.fit_chain(x, y, folds, np.ones(200), *asked)
    assert [len(m.weights) for m in blind.models] == [len(m.weights) for m in seeing.models] == [2, 3]
    # Probabilities from a column that says nothing get less weight in the later model.
    assert np.allclose(blind.models[0].weights, seeing.models[0].weights)
    assert abs(blind.models[1].weights[-1]) < abs(seeing.models[1].weights[-1])


def test_doubled_documents_count_once_by_their_first_text(spark):
    docs = frame(spark, [(i, t, "en") for i in range(40) for t in (f"zz{i}", "vile words" if i % 2 else "kind words")], "doc_id bigint, text string, lang string")
    labels = frame(spark, [(i, i % 2) for i in range(40)], "doc_id bigint, toxic int")
    one, two = (toxicity.fit_toxicity(d, labels, ["toxic"]) for d in (docs, docs.orderBy("text", "doc_id")))
    assert one.words == two.words and "vile" in one.words and all(np.array_equal(a.weights, b.weights) for a, b in zip(one.models, two.models))


def test_toxicity_of_odd_rows_and_without_labels(spark):
    labels = "doc_id bigint, toxic int"
    docs = frame(spark, [(i, t, "k") for i, t in ODD], "doc_id bigint, text string, p_toxic string")
    for rows in ([], [(1, 1), (2, None), (None, 1)], [(i, i % 2) for i in range(6)]):
        chain = toxicity.fit_toxicity(docs, frame(spark, rows, labels), ["toxic"], toxicity.KINDS)
        got = toxicity.score_toxicity(docs, chain)
        assert got.count() == len(ODD) and all(0 <= r["p_toxic"] <= 1 for r in got.collect())
    empty = frame(spark, [])
    chain = toxicity.fit_toxicity(empty, frame(spark, [], labels), ["toxic"])
    assert toxicity.score_toxicity(empty, chain).collect() == []


# Packing


def whole_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    return [np.append(np.array(e.ids, np.uint32), np.uint32(packing.END_ID)) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_encoder_equals_the_tokenizer():
    texts = [
        "Hello, WORLD's end... it's we'll 3.14 x2", "naïve ÀÉÎ straße İstanbul Σίσυφος ΟΔΟΣ", "é ẛ̣ ﬁ", "日本語 テスト",
        "a b c d\x1ce\x85f", "<|endoftext|> <|startoftext|>x", "x <|endoftext|> y", "a<|startoftext|>b", "A<|ENDOFTEXT|>É<|endoftext|>'s", "😀👩‍👩‍👧 ok!?;:", "", "  \n", "×÷ ªº ß", "x" * 3000, "don't.'s",
    ]
    encoder = packing.Encoder(packing.default_tokenizer())
    for text, want in zip(texts, whole_ids(texts)):
        assert encoder.encode(text.encode()).tolist() == want[:-1].tolist(), text


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_encoder_equals_the_tokenizer_on_any_text(text):
    encoder = packing.encoder(packing.default_tokenizer())
    assert encoder.encode(text.encode("utf-8", "replace")).tolist() == whole_ids([text.encode("utf-8", "replace").decode()])[0][:-1].tolist()


def check_packing(pieces, texts):
    """Every id lies in one piece, sequences have no gaps, and little is padded."""
    rows = [r.asDict() for r in pieces.collect()]
    documents, sequences = {}, {}
    for r in rows:
        documents.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    ids = whole_ids([t or "" for _, t in texts])
    for (doc, _), want in zip(texts, ids):
        own = sorted(documents[doc], key=lambda r: r["start"])
        assert b"".join(r["token_ids"] for r in own) == want.astype("<u4").tobytes()
        assert [r["start"] for r in own] == np.cumsum([0] + [r["length"] for r in own])[:-1].tolist()
        assert {r["doc_tokens"] for r in own} == {len(want)} and sum(r["length"] for r in own) == len(want)
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        size = sum(r["length"] for r in own)
        assert [r["offset"] for r in own] == np.cumsum([0] + [r["length"] for r in own])[:-1].tolist()
        assert size == own[0]["sequence_length"] <= 2048 and size & (size - 1) == 0
        assert len({(r["step_group"], r["sequence_length"]) for r in own}) == 1
    assert sum(r["length"] for r in rows) == sum(map(len, ids))


@pytest.mark.parametrize("pool", [1, 16])
def test_packing_keeps_every_id_once(spark, pool):
    rng = random.Random(pool)
    texts = [(i, " ".join(rng.choice(["alpha", "bé", "Gamma.", "delta42"]) for _ in range(int(rng.paretovariate(0.6)) % 4000))) for i in range(150)]
    texts += [(900, None), (901, ""), (None, "no id"), (902, "word " * 9000)]
    check_packing(packing.pack_documents(frame(spark, texts).repartition(3), pool_sequences=pool), texts)


def test_packing_routes_documents_to_tiers():
    packer = packing.Packer((256, 512, 1024, 2048), 4)
    sequences = []
    for i in range(2000):
        sequences += packer.add((i, 0), np.full(20 + 37 * i % (2300 if i % 20 == 0 else 230 if i % 2 else 500), i, np.uint32))
    by_size = {s.size for s in sequences}
    assert by_size == {256, 512, 1024, 2048} and all(s.used == s.size for s in sequences)


def test_packing_of_nothing_and_repeated_rows(spark):
    assert packing.pack_documents(frame(spark, [])).collect() == []
    clash = frame(spark, [(1, "a b", 1), (1, "a b", 1)], "doc_id bigint, text string, offset int")
    got = packing.pack_documents(clash, checksums=True).collect()
    want = zlib.crc32(whole_ids(["a b"])[0].astype("<u4").tobytes())
    whole = [r for r in got if r["length"] == r["doc_tokens"]]
    assert sum(r["length"] for r in got) == 2 * got[0]["doc_tokens"] and all(r["ids_crc32"] == want for r in whole)


# Chat format

TEMPLATE = chat_format.Template()
PIECES = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "/", "s>", "INST]", "\n", "a", "é", " ", "n"]), max_size=12).map("".join)


@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), PIECES), st.one_of(PIECES, st.text(max_size=20))), max_size=5))
@settings(max_examples=400, deadline=None)
def test_rendered_conversations_parse_back(turns):
    rendered = "".join(chat_format.render_turn(role, text, TEMPLATE) for role, text in turns)
    read = chat_format.parse(rendered, TEMPLATE)
    assert [(t.role, t.text) for t in read] == turns
    for turn, (role, text) in zip(read, turns):
        assert (turn.loss is not None) == (role == "assistant")
        if turn.loss:
            assert TEMPLATE.unescape(rendered[slice(*turn.loss)]) == text


def test_only_conflicting_text_is_escaped():
    assert chat_format.render_turn("user", "plain \\ < [x]", TEMPLATE) == "<s>[INST]user\nplain \\ < [x][/INST]</s>"
    assert chat_format.render_turn("assistant", "a </s> b", TEMPLATE) == "<s>assistant\na <\\/s> b</s>"
    with pytest.raises(ValueError):
        chat_format.parse("<s>user\na [INST] b</s>", TEMPLATE)


def test_chat_of_odd_rows(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, rendered int"
    rows = [(1, 1, "assistant", "b", 0), (1, 0, "user", None, 0), (1, None, None, "first", 0), (2, 0, "assistant", "x", 0), (2, 0, "assistant", "x", 0), (None, 0, "user", "y", 0)]
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_turns(frame(spark, rows, schema))).collect()}
    assert {k: (r["n_turns"], r["loss_chars"]) for k, r in got.items()} == {1: (3, 1), 2: (2, 2), None: (1, 0)}
    import hashlib

    assert got[1]["turns_sha256"] == hashlib.sha256(b"\nfirst\nuser\n\nassistant\nb\n").hexdigest()
    assert chat_format.read_back(chat_format.format_turns(frame(spark, [], schema))).collect() == []


# Token counts


def spans_by_force(text):
    encoding, _ = token_counts._encoding(*token_counts.default_ranks())
    ends, at = [], 0
    for token in encoding.encode_ordinary(text):
        at += len(encoding.decode_single_token_bytes(token))
        ends.append(at)
    return list(zip([0, *ends[:-1]], ends))


def counts_by_force(text, sections, rule):
    tokens = spans_by_force(text)
    bytes_at = [len(text[:i].encode()) for i in range(len(text) + 1)]
    counts, crossing = [0.0] * len(sections), [0] * len(sections)
    for first, end in tokens:
        shares = [max(0, min(end, bytes_at[e]) - max(first, bytes_at[s])) if e > s else 0 for s, e in sections]
        for k, share in enumerate(shares):
            crossing[k] += 0 < share < end - first
            if rule == "share":
                counts[k] += share / (end - first)
            elif rule == "first":
                counts[k] += share > 0 and bytes_at[sections[k][0]] <= first
            else:
                counts[k] += share > 0 and shares.index(max(shares)) == k
    return counts, crossing


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_equal_brute_force(spark, rule):
    rng = random.Random(4)
    texts, rows, want = [], [], {}
    for i in range(25):
        text = "".join(rng.choice(["the", "straße ", "日本", "😀", "\n", " counting", "x1", "."]) for _ in range(rng.randrange(40)))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text), 6)))
        sections = list(zip(cuts[::2], cuts[1::2]))
        texts.append((i, text))
        rows += [(i, f"s{k}", s, e) for k, (s, e) in enumerate(sections)]
        want[i] = (sections, *counts_by_force(text, sections, rule), len(spans_by_force(text)))
    got = token_counts.count_tokens(frame(spark, texts), frame(spark, rows, "doc_id bigint, section string, start int, end int"), rule)
    found = {}
    for r in got.orderBy("doc_id", "section_no").collect():
        found.setdefault(r["doc_id"], []).append(r)
    for i, (sections, counts, crossing, total) in want.items():
        own = [r for r in found[i] if r["section"] is not None]
        assert [(r["start"], r["end"]) for r in own] == sections
        assert np.allclose([r["tokens"] for r in own], counts) and [r["crossing_tokens"] for r in own] == crossing
        assert {r["doc_tokens"] for r in found[i]} == {total}


def test_line_sections_cover_the_text(spark):
    got = token_counts.count_tokens(frame(spark, [*ODD, (6, "t\n\nb é\n")])).collect()
    assert sum(r["tokens"] for r in got) == sum({(r["doc_id"], r["doc_tokens"], r["section_no"] == 0): r["doc_tokens"] for r in got if r["section_no"] == 0}.values()) + 1
    six = sorted((r["section_no"], r["section"], r["start"], r["end"]) for r in got if r["doc_id"] == 6)
    assert six == [(0, "title", 0, 2), (1, "body", 2, 3), (2, "body", 3, 7)]
    assert [(r["section"], r["tokens"]) for r in got if r["doc_id"] in (1, 2)] == [(None, 0.0), (None, 0.0)]
    assert token_counts.count_tokens(frame(spark, [])).collect() == []


def test_sections_beyond_the_text_are_cut(spark):
    sections = frame(spark, [(1, "a", -5, 99), (1, "b", 2, 1), (1, None, None, 3), (9, "c", 0, 1)], "doc_id bigint, section string, start int, end int")
    got = token_counts.count_tokens(frame(spark, [(1, "one two"), (2, "three")]), sections).orderBy("doc_id", "section_no").collect()
    assert [(r["doc_id"], r["section"], r["start"], r["end"], r["tokens"]) for r in got] == [(1, "a", 0, 7, 2.0), (1, "b", 2, 2, 0.0), (2, None, 0, 0, 0.0)]


# HTML

PAGE = "page_id bigint, url string, html string"


def text_of(html):
    return html_extract.page_text(html, frozenset())


@pytest.mark.parametrize("html,text", [
    ("<article><h1>A &amp; B</h1><p>one <b>two</b>three<br>four\n five<p>six</article>", "A & B\none twothree four five\nsix"),
    ("<body><header>site</header><nav>m</nav><main><p>x</p><aside>no</aside><form>f</form></main><footer>c</footer>", "x"),
    ("<article><header><h1>T</h1></header><div class='post-comments'><p>hi</p></div><p>b</p><footer>by</footer></article>", "T\nb"),
    ("<p>a<script>if (a < b) '</p>'</script><style>p{}</style><!-- <p>no</p> -->b</p>", "ab"),
    ("<p>cut off &am", "cut off &am"), ("<article><p>one</p><p", "one"), ("<p>a</article", "a"), ("<!-- open <p>x</p>", ""),
    ("x < y & z <3 &lt;i&gt; &#8364;&nbsp;5", "x < y & z <3 <i> € 5"), ("", ""), ("plain", "plain"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\nb\nc\nd"), ("<div hidden>a</div><div style='display: none'>b</div>c", "c"),
    ("<div id=cookieNotice>a</div><p title='<x>'>b</p></div></span>", "b"), ("<svg><p>a</p></svg><p>b", "b"),
    ("<html class='nav-open'><body class='no-sidebar'><div class=menu>m</div><p>all of it</p></body></html>", "all of it"),
    ("<div class='layout has-sidebar'><div class=sidebar>s</div><article><p>text</p><div class=share>on x</div></article></div>", "text"),
    ("<body id=search><div class='nav-wrapper'><main class='with-sidebar'><p>text</p><div class=related>r</div></main></div>", "text"),
    ("<article class='post comments-open'><p>text</p><article class=comment>c</article></article>", "text"),
    ("<div id='search-results-page'><div class=ads>ad</div><p>the whole text</p></div>", "the whole text"),
    ("<div class='ad'><aside><article>no</article></aside>ad</div><p>text</p>", "text"),
])
def test_page_text(html, text):
    assert text_of(html) == text


@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<div class='a'>", "</div>", "<article>", "</article>", "<script>", "</script>", "<!--", "-->", "<", ">", "&", "\"", "'", "x", " ", "<li>", "<td>", "<a href='"]), max_size=25).map("".join))
@settings(max_examples=300, deadline=None)
def test_any_markup_is_read(html):
    html_extract.page_features(html)
    assert text_of(html) == text_of(html)


def test_text_after_deep_nesting_keeps_its_place():
    inner = "<div>" * 300 + "<p>in</p>" + "</div>" * 300
    html = f"<div><article><p>before</p>{inner}<p>after</p></article></div><p>outside</p>"
    assert html_extract.page_text(html, frozenset()) == "before\nin\nafter"
    noise = "<div>" * 300 + "<nav><p>menu</p></nav><div class=sidebar><b>x</b></div><p>text</p>" + "</div>" * 300
    assert html_extract.page_text(f"<article><p>a</p>{noise}<p>b</p></article>", frozenset()) == "a\ntext\nb"


def test_a_million_open_elements_are_read():
    html = "<article>" + "<div>" * 200_000 + "x" + "<i>" * 100_000 + "y"
    assert html_extract.page_text(html, frozenset()) == "xy"


def test_columns_of_any_name_pass_through_extraction(spark):
    rows = [(i, f"https://h.example.com/{i}", f"<article><p>text {i}</p></article>", "k") for i in range(4)]
    pages = frame(spark, rows, "page_id bigint, url string, html string, _low string")
    odd = pages.select("*", *[F.lit("k").alias(c) for c in ("_kept", "_sited", "_KEPT_", "spread", "path", "site", "text")])
    got = html_extract.extract_text(odd).collect()
    assert sorted(r["text"] for r in got) == [f"text {i}" for i in range(4)] and {r["_low"] for r in got} == {"k"}


def styled_by_force(pages, least=html_extract.LEAST_IMPORTANCE, least_pages=html_extract.LEAST_PAGES):
    """Pages whose elements are <div class=X><p>…</p></div>: the branches that say the same on all pages go."""
    seen = {}
    for page in pages:
        for style, text in page:
            seen.setdefault(style, []).append(text)
    low = {s for s, texts in seen.items() if len(texts) >= least_pages and len(set(texts)) == 1}
    return ["\n".join(t for s, t in page if s not in low) for page in pages]


def test_the_tree_decides_where_no_page_has_an_article(spark):
    pages = []
    for i in range(30):
        page = [("top", "Welcome to the site"), ("story", " ".join(f"w{i}x{k}" for k in range(40))), ("end", "All rights and words kept")]
        pages.append(page if i % 3 else [*page, ("extra", f"note {i} of the day")])
    html = ["<body>" + "".join(f'<div class="{s}"><p>{t}</p></div>' for s, t in page) + "</body>" for page in pages]
    rows = [(i, f"https://plain.example.com/{i}", h) for i, h in enumerate(html)]
    got = html_extract.extract_text(frame(spark, rows, "page_id bigint, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == dict(enumerate(styled_by_force(pages)))


def test_deep_nesting_is_read():
    assert text_of("<b>" * 20000 + "x" + "<div>" * 20000 + "y") == "x\ny"


def test_style_tree_removes_what_all_pages_of_a_site_have(spark):
    rows = [(i, f"http://Site.example.org:80/{i}", f"<body><div id=m{i}><i>Home</i><i>News</i></div><div class=t><p>Story {i} tells {i * i}.</p><p>All say this.</p></div><div class=z>Call us</div>") for i in range(12)]
    rows += [(50, "http://other.example.org/a", "<div class=z>Call us</div>"), (51, None, "<div class=z>Call us</div>"), (52, "no address", None)]
    got = {r["page_id"]: r for r in html_extract.extract_text(frame(spark, rows, PAGE)).collect()}
    assert {got[i]["text"] for i in range(12)} == {f"Story {i} tells {i * i}.\nAll say this." for i in range(12)}
    assert [got[i]["text"] for i in (50, 51, 52)] == ["Call us", "Call us", ""]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_the_text_of_a_site_overrules_names(spark):
    page = "<body class=has-menu><div class=nav>Home</div><div class='results search'><div class=t>Call us</div><p>Story {0} tells {1}.</p><div class=share>Tell all {1}</div></div>"
    rows = [(i, f"http://a.example/{i}", page.format(i, "much " * (3 + i))) for i in range(12)]
    # One page of the site has less text in the branch than in another; the site decides.
    rows += [(20, "http://a.example/20", "<body class=has-menu><div class='results search'>few</div><div class=nav>" + "Home " * 9 + "</div>")]
    rows += [(30, "http://b.example/", "<div class='results search'>x</div><p>Main text.</p>"), (31, None, rows[0][2])]
    got = dict(html_extract.extract_text(frame(spark, rows, PAGE)).select("page_id", "text").collect())
    much = lambda i: ("much " * (3 + i)).strip()
    assert [got[i] for i in range(12)] == [f"Story {i} tells {much(i)} ." for i in range(12)]
    assert (got[20], got[30], got[31]) == ("few", "Main text.", f"Call us\nStory 0 tells {much(0)} .")


def test_copies_of_an_article_are_not_a_template(spark):
    rows = [(i, f"http://a.example/{i}", "<article><h1>Same</h1><p>Same text.</p></article>") for i in range(9)]
    assert {r["text"] for r in html_extract.extract_text(frame(spark, rows, PAGE)).collect()} == {"Same\nSame text."}


def test_entropies_of_a_style_tree(spark):
    rows = [("s", f"<div class=a>{'x' if i < 4 else i}</div>") for i in range(8)]
    tree = html_extract.style_trees(frame(spark, rows, "site string, html string")).where("path like '%.a'").first()
    # Five texts: one on four of eight pages, entropy log 4 / log 8, the others on one page each.
    assert tree["pages"] == 8 and tree["presentation"] == 0 and abs(tree["content"] - (1 - (2 / 3) / 5)) < 1e-9


def test_pages_keep_other_columns_and_repeats(spark):
    rows = [(1, "http://a.example/", "<p>x</p>", "t", 7), (1, "http://a.example/", "<p>x</p>", "t", 7), (None, None, None, None, None)]
    got = html_extract.extract_text(frame(spark, rows, PAGE + ", text string, other int"))
    assert got.columns == ["page_id", "url", "html", "other", "text", "n_chars"]
    assert sorted(map(tuple, got.select("text", "other").collect()), key=str) == [("", None), ("x", 7), ("x", 7)]
    assert html_extract.extract_text(frame(spark, [], PAGE)).collect() == []


@needs_data
def test_pages_of_the_tables_give_their_articles(spark):
    import html as entities
    import re

    for row in html_extract.op1_html_extract(spark, SF_DIR).join(table(spark, "pages"), ["page_id", "url"]).collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", row["html"], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"<[^>]*\Z", "", article))
        plain = (" ".join(entities.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", p)).split()) for p in parts)
        assert row["text"] == "\n".join(p for p in plain if p)
