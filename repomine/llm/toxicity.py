"""Toxicity categories by a chain of linear models over the words of a document."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repomine.llm.quality import fold_of
from repomine.llm.text import WORD_CACHE, as_bytes, map_batches, read_table, split_words
from repomine.session import cut_lineage

# Labelled rows the models are fitted on: this many of either kind of the first category, at most. The rows
# with the smallest hash of the id are taken; rows of a kind that was cut weigh more, so that the share of
# the kind stays that of all labelled rows.
SAMPLE_ROWS = 6_000
# Features (words and stems) per category that the models look at: those whose share differs most between
# the kinds.
WORDS = 224
# Lengths of the stems.
STEMS = (4, 5, 6, 7, 8)
# A feature is the share of a document's words that have it, up to this one, scaled to 0 to 1.
FULL_SHARE = 0.02
# A feature that fewer documents of the sample hold is not looked at.
LEAST_DOCUMENTS = 3
INNER_FOLDS = 4
RIDGE = 0.1
THRESHOLD = 0.5
ROUNDS = 10

_WORD = re.compile(r"[^\W_]+")

# Toxic rows without a listed word are split by features of the sample itself, so many per language at most. Such
# a feature is held by this share of these rows at least, and so many times more often than by clean ones.
OWN_TERMS = 64
OWN_SHARE = 0.1
OWN_RATIO = 5.0

# Kinds of toxic words for the second and third category of the query; the labels only say toxic or not. The words
# are English; for rows without any of them see ``own_terms``.
KINDS: dict[str, tuple[str, ...]] = {
    "insult": ("idiot", "moron", "loser", "clown", "scum"),
    "contempt": ("pathetic", "worthless", "disgusting", "stupid", "trash"),
}


def word_features(word: str) -> list[str]:
    """A word, and the stems by which forms of it meet: its first letters, marked with a star."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) >= n)]


def distinct_features(text: bytes) -> set[str]:
    """Words of letters and digits in lower case, and their stems, each once."""
    words = {w for chunk in set(split_words(text)) for w in _WORD.findall(chunk.decode().lower())}
    return {f for w in words for f in word_features(w)}


class _Index(dict):
    """Numbers of the looked-at features that a piece of text between blanks holds; most hold none."""

    def __init__(self, features: Sequence[str]):
        self.numbers = {f: i for i, f in enumerate(features)}

    def __missing__(self, chunk: bytes) -> tuple[int, ...]:
        found = [self.numbers.get(f) for w in _WORD.findall(chunk.decode().lower()) for f in word_features(w)]
        value = self[chunk] = tuple(i for i in found if i is not None)
        return value

    def shares(self, texts: list[bytes]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.numbers)))
        for row, text in enumerate(texts):
            if len(self) > WORD_CACHE:
                self.clear()
            chunks = split_words(text)
            for held in filter(None, map(self.__getitem__, chunks)):
                for feature in held:
                    x[row, feature] += 1.0
            x[row] /= max(len(chunks), 1) * FULL_SHARE
        return np.minimum(x, 1.0)


@dataclass
class Linear:
    weights: np.ndarray
    bias: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE) -> Linear:
    """Logistic regression with a ridge, by Newton steps. One kind only gives its share, smoothed."""
    total = weight.sum()
    share = (float((y * weight).sum()) + 0.5) / (float(total) + 1.0)
    model = Linear(np.zeros(x.shape[1]), float(np.log(share / (1 - share))))
    if not 0 < y.sum() < len(y):
        return model
    with_one = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(with_one.shape[1], ridge)
    penalty[-1] = 1e-6
    beta = np.append(model.weights, model.bias)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(with_one @ beta, -30, 30)))
        slope = with_one.T @ (weight * (p - y)) + penalty * beta
        curve = (with_one * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ with_one + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        beta -= step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return Linear(beta[:-1], float(beta[-1]))


@dataclass
class ToxicityChain:
    """One linear model per category, in order; each sees the probabilities of those before it."""

    categories: list[str]
    words: list[str]
    models: list[Linear]
    # Features that split toxic rows without a listed word, by language and category; see ``own_terms``.
    terms: dict[str, dict[str, set[str]]] = field(default_factory=dict)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        done = np.zeros((len(x), 0))
        for model in self.models:
            done = np.hstack([done, model.probability(np.hstack([x, done]))[:, None]])
        return done


def fit_chain(
    x: np.ndarray, y: np.ndarray, folds: np.ndarray, weight: np.ndarray, categories: Sequence[str], words: Sequence[str],
    looked_at: Mapping[int, np.ndarray] | None = None,
) -> ToxicityChain:
    """Fit the categories (columns of ``y``) in order.

    A later model is trained with the probabilities that earlier ones give to rows they were not fitted on:
    a model sees in training what it will see on new rows, not the answers learned by heart. ``words`` name the
    first columns of ``x``, those the chain looks at. ``looked_at`` gives for a fold the columns that were
    chosen without its rows; they are used where the fold is left out, so that its labels have no part in it.
    """
    done = np.zeros((len(x), 0))
    models = []
    looked_at = looked_at or {}
    final = np.arange(len(words))
    for column in range(y.shape[1]):
        target = y[:, column]
        out_of_fold = np.zeros(len(x))
        for fold in np.unique(folds):
            rest = folds != fold
            inputs = np.hstack([x[:, looked_at.get(int(fold), final)], done])
            part = fit_linear(inputs[rest], target[rest], weight[rest])
            out_of_fold[~rest] = part.probability(inputs[~rest])
        models.append(fit_linear(np.hstack([x[:, final], done]), target, weight))
        done = np.hstack([done, out_of_fold[:, None]])
    return ToxicityChain(list(categories), list(words), models)


def _sample(labels: DataFrame, categories: Sequence[str], rows: int) -> tuple[DataFrame, float, float]:
    """Rows to learn from, with the weights of rows without and with the first category."""
    spread = F.xxhash64("doc_id")
    parts, weights = [], []
    for kind in (0, 1):
        own = labels.where(F.col(categories[0]) == kind)
        count = own.count()
        parts.append(own.orderBy(spread, "doc_id").limit(rows))
        weights.append(count / min(count, rows) if count else 1.0)
    return parts[0].union(parts[1]), weights[0], weights[1]


def split_terms(found: Sequence[tuple[str, int]], kinds: Sequence[str]) -> dict[str, set[str]]:
    """Deal features, each with the number of rows that hold it, to kinds.

    The best come first. Features of which one begins the other are forms of a word and go together; a new
    word goes to the kind whose words were held by the fewest rows so far.
    """
    terms: dict[str, set[str]] = {k: set() for k in kinds}
    held = dict.fromkeys(kinds, 0)
    for feature, rows in found:
        stem = feature.rstrip("*")
        own = next((k for k in kinds for t in terms[k] if stem.startswith(t.rstrip("*")) or t.startswith(stem)), None)
        if own is None:
            own = min(kinds, key=held.__getitem__)
            held[own] += rows
        terms[own].add(feature)
    return terms


def own_terms(rows: DataFrame, toxic: str, listed: Sequence[str], kinds: Sequence[str]) -> dict[str, dict[str, set[str]]]:
    """Features by language and kind for the toxic rows of a sample that no listed word gives a kind.

    ``rows`` have ``text``, ``lang``, the column ``toxic`` and one per kind (``listed``). The features are those
    that tell these rows best from the clean ones of their language.
    """
    none = reduce(Column.__and__, [F.col(m) == 0 for m in listed])
    group = F.when(F.col(toxic) == 0, 0).when(none, 1)
    known = rows.select("text", "lang", group.alias("own")).where("own is not null")
    sizes = known.groupBy("lang").agg(F.sum("own").alias("all_own"), F.sum(1 - F.col("own")).alias("all_clean"))
    # One row per language that has LEAST_DOCUMENTS rows of the sample, which bounds them.
    sizes = F.broadcast(cut_lineage(sizes.where(F.col("all_own") >= LEAST_DOCUMENTS)))
    known = known.join(sizes.select("lang"), "lang", "left_semi")

    def counted(part: DataFrame, wanted: dict[str, set[str]] | None) -> DataFrame:
        def features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                langs = batch["lang"].to_pylist()
                held = [distinct_features(t) for t in as_bytes(batch["text"])]
                if wanted is not None:
                    held = [h & wanted.get(lang, set()) for h, lang in zip(held, langs)]
                yield pa.RecordBatch.from_arrays([batch["lang"], pa.array([sorted(h) for h in held], pa.list_(pa.string()))], names=["lang", "words"])

        found = map_batches(part.select("lang", "text"), features_of, "lang string, words array<string>")
        return found.select("lang", F.explode("words").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("k"))

    # First the rows to split, which are few; of the clean ones only the features that these often hold. A row has
    # a bounded share of them, so they are at most 1 / OWN_SHARE times the features of a mean row.
    least = F.greatest(F.lit(LEAST_DOCUMENTS), OWN_SHARE * F.col("all_own"))
    often = cut_lineage(counted(known.where("own = 1"), None).join(sizes, "lang").where(F.col("k") >= least))
    wanted: dict[str, set[str]] = {}
    for r in often.select("lang", "word").collect():
        wanted.setdefault(r["lang"], set()).add(r["word"])
    clean_rows = counted(known.where("own = 0"), wanted).withColumnRenamed("k", "clean")
    share, clean = F.col("k") / F.col("all_own"), (F.coalesce("clean", F.lit(0)) + 1) / (F.col("all_clean") + 1)
    place = F.row_number().over(Window.partitionBy("lang").orderBy((share - clean).desc(), "word"))
    best = often.join(clean_rows, ["lang", "word"], "left").where(share >= OWN_RATIO * clean).withColumn("place", place)
    found: dict[str, list[tuple[str, int]]] = {}
    for r in best.where(F.col("place") <= OWN_TERMS).select("lang", "word", "k").orderBy("lang", "place").collect():
        found.setdefault(r["lang"], []).append((r["word"], r["k"]))
    return {lang: split_terms(words, kinds) for lang, words in found.items()}


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    categories: Sequence[str],
    kinds: Mapping[str, Sequence[str]] | None = None,
    sample_rows: int = SAMPLE_ROWS,
    words: int = WORDS,
) -> ToxicityChain:
    """Chain for ``categories`` (columns 0/1 of ``labels`` with ``doc_id``) from the texts of ``docs``.

    ``kinds`` adds categories that the labels do not split: a row has one if it has the first category and its
    text holds one of the given words. Rows with the first category and no given word have one if they hold one
    of the features that ``own_terms`` finds for it in their language (column ``lang`` of ``docs``, if there is
    one); those are in ``terms`` of the chain. Only rows outside fold 0 (see ``fold_of``) are learned from, at most
    ``sample_rows`` of either kind of the first category; their texts are broadcast-joined, so the documents
    are not shuffled. Several labels of a document count as the greatest; nulls count as 0, but a row without
    id or first category is left out. Several texts of a document count as the first of them in order. Equal texts
    are in one inner fold, and features are chosen anew for every inner fold that is left out. Without any label
    all probabilities are one half.
    """
    kinds = dict(kinds or {})
    labels = labels.where(F.col("doc_id").isNotNull() & F.col(categories[0]).isNotNull()).groupBy("doc_id").agg(
        *[F.max(F.coalesce(F.col(c), F.lit(0)).cast("int")).alias(c) for c in categories]
    ).where(fold_of(F.col("doc_id")) != 0)
    chosen, negative, positive = _sample(labels, categories, sample_rows)
    names = [*categories, *kinds]
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    text_rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang"))
    # At most 2 x sample_rows ids, each with one text however often it occurs.
    marks = [f"y{i}" for i in range(len(names))]
    given_marks = marks[: len(categories)]
    chosen = chosen.withColumnsRenamed(dict(zip(categories, given_marks)))
    sample = text_rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", *given_marks)
    sample = sample.agg(F.min(F.struct("text", "lang")).alias("row")).select("doc_id", "row.*", *given_marks)
    fold = F.pmod(F.xxhash64("text", F.lit(1)), F.lit(INNER_FOLDS)).cast("int")
    rows = sample.withColumn("fold", fold)
    words_of = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), 0))
    for mark, terms in zip(marks[len(categories):], kinds.values()):
        holds = F.arrays_overlap(words_of, F.array(*[F.lit(t) for t in terms]))
        rows = rows.withColumn(mark, (holds & (F.col(marks[0]) == 1)).cast("int"))
    rows = cut_lineage(rows)  # used several times
    listed = marks[len(categories):]
    terms = own_terms(rows, marks[0], listed, list(kinds)) if kinds else {}

    def mark_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = {m: batch[m].to_pylist() for m in marks}
            for row, (text, lang) in enumerate(zip(as_bytes(batch["text"]), batch["lang"].to_pylist())):
                if lang in terms:
                    held = distinct_features(text)
                    for m, kind in zip(listed, kinds):
                        given[m][row] = int(not held.isdisjoint(terms[lang][kind]))
            yield pa.RecordBatch.from_arrays([batch["text"], batch["fold"], *(pa.array(given[m], pa.int32()) for m in marks)], names=["text", "fold", *marks])

    if terms:
        kept = rows.select("text", "lang", "fold", *marks)
        split = reduce(Column.__and__, [F.col(m) == 0 for m in listed]) & (F.col(marks[0]) == 1)
        found = map_batches(kept.where(split), mark_rows, "text string, fold int, " + ", ".join(f"{m} int" for m in marks))
        rows = cut_lineage(kept.where(~split).drop("lang").unionByName(found))

    def features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [sorted(distinct_features(t)) for t in as_bytes(batch["text"])]
            columns = [pa.array(held, pa.list_(pa.string())), batch["fold"], *(batch[m] for m in marks)]
            yield pa.RecordBatch.from_arrays(columns, names=["words", "fold", *marks])

    # Counts of all rows and of each fold alone: what is left without a fold is their difference.
    inner = range(INNER_FOLDS)
    sums = [F.count("*").alias("n"), *[F.count(F.when(F.col("fold") == f, 1)).alias(f"n_{f}") for f in inner]]
    for m in marks:
        sums += [F.sum(m).alias(m), *[F.sum(F.when(F.col("fold") == f, F.col(m)).otherwise(0)).alias(f"{m}_{f}") for f in inner]]
    totals = rows.agg(*sums).first()
    n = totals["n"] or 0

    def left(name: str, left_out: int | None, of: Callable = F.col):
        return of(name) if left_out is None else of(name) - of(f"{name}_{left_out}")

    chosen_words: dict[int | None, set[str]] = {f: set() for f in (None, *inner)}
    if n:
        kinds_of_row = ", ".join(f"{m} int" for m in marks)
        held = (
            map_batches(rows.select("text", "fold", *marks), features_of, f"words array<string>, fold int, {kinds_of_row}")
            .select(F.explode("words").alias("word"), "fold", *marks)
            .groupBy("word").agg(*sums)
            .where(F.col("n") >= LEAST_DOCUMENTS)
        )
        held = cut_lineage(held)
        picks = []
        for left_out in chosen_words:
            seen, all_rows = left("n", left_out), left("n", left_out, totals.__getitem__)
            for m in marks:
                own, ones = left(m, left_out), left(m, left_out, totals.__getitem__)
                gap = F.abs(own / (ones + 1.0) - (seen - own) / (all_rows - ones + 1.0)) / F.sqrt(seen + F.lit(1.0))
                best = held.where(seen >= LEAST_DOCUMENTS).orderBy(gap.desc(), "word").limit(words)
                picks.append(best.select("word", F.lit(left_out).cast("int").alias("left_out")))
        for r in reduce(DataFrame.union, picks).collect():  # at most `words` rows of each
            chosen_words[r["left_out"]].add(r["word"])
    final = sorted(chosen_words[None])
    vocabulary = final + sorted(set().union(*chosen_words.values()) - set(final))
    place = {w: i for i, w in enumerate(vocabulary)}
    looked_at = {f: np.array(sorted(place[w] for w in chosen_words[f]), int) for f in inner}

    def short_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index(vocabulary)
        for batch in batches:
            x = index.shares(as_bytes(batch["text"]))
            held = [np.flatnonzero(row) for row in x]
            columns = [pa.array(held, pa.list_(pa.int32())), pa.array([row[h] for row, h in zip(x, held)], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*columns, *(batch[c] for c in ("fold", *marks))], names=["at", "share", "fold", *marks])

    # The driver fits on at most 2 x sample_rows short lists of feature numbers.
    marked = ", ".join(f"{m} int" for m in marks)
    short = map_batches(rows.select("text", "fold", *marks), short_rows, f"at array<int>, share array<double>, fold int, {marked}").collect()
    x = np.zeros((len(short), len(vocabulary)))
    for row, r in enumerate(short):
        x[row, r["at"]] = r["share"]
    y = np.array([[r[m] for m in marks] for r in short], float).reshape(-1, len(marks))
    weight = np.where(y[:, 0] > 0, positive, negative)
    order = np.lexsort([*x.T, *y.T, [r["fold"] for r in short]]) if len(short) else []  # whatever order Spark gave
    folds = np.array([r["fold"] for r in short], int)
    chain = fit_chain(x[order], y[order], folds[order], weight[order], names, final, looked_at)
    chain.terms = terms
    return chain


def score_toxicity(docs: DataFrame, chain: ToxicityChain, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``p_<category>`` for every category, and ``<category>`` as 1 from ``threshold`` on.

    Null text counts as empty. Other columns pass through; those with one of the new names are replaced.
    Repeated rows get equal scores. An empty table gives an empty result.
    """
    added = [f"p_{c}" for c in chain.categories] + list(chain.categories)
    docs = docs.drop(*added)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index(chain.words)
        for batch in batches:
            p = chain.probabilities(index.shares(as_bytes(batch["text"])))
            more = [pa.array(p[:, i]) for i in range(p.shape[1])]
            more += [pa.array((p[:, i] >= threshold).astype(np.int32)) for i in range(p.shape[1])]
            yield pa.RecordBatch.from_arrays([batch[c] for c in columns] + more, names=[*columns, *added])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    schema += "".join(f", `{a}` {'double' if a.startswith('p_') else 'int'}" for a in added)
    return map_batches(docs, run, schema)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    chain = fit_toxicity(docs, read_table(spark, sf_dir, "labels"), ["toxic"], KINDS)
    docs = docs.drop("lang")
    held_out = F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return score_toxicity(docs, chain).drop("text").withColumn("held_out", held_out)
