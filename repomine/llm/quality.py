"""Document quality: ridge regression on random Fourier features of document statistics, calibrated."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repomine.llm.stats import NAMES, text_statistics
from repomine.llm.text import as_bytes, map_batches, read_table
from repomine.session import cut_lineage

# Fixed values of the contract: rows of remainder 0 are held out, and a document passes from this score on.
FOLDS = 5
THRESHOLD = 0.3

FEATURES = 128
SEED = 20
RIDGES = (1e-4, 1e-3, 1e-2, 1e-1)
# Statistics beyond so many deviations from the mean count as that far.
CLIP = 4.0
# Sums are of whole numbers, so that they do not depend on the order of the tasks.
_SCALE = 1 << 10
# Uncalibrated scores are counted in bins of this width, between -1 and 2.
_BINS = 1 << 10


def fold_of(doc_id: Column) -> Column:
    """``crc32`` of the id as text, modulo 5. A null id is in no fold."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)).cast("int")


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, stats``: the statistics of every text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [text_statistics(t) for t in as_bytes(batch["text"])]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(stats, pa.list_(pa.float64()))], names=["doc_id", "stats"]
            )

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, stats array<double>")


@dataclass
class Kernel:
    """Random Fourier features of standardised statistics: products of them approximate a Gaussian kernel."""

    mean: np.ndarray
    spread: np.ndarray
    directions: np.ndarray
    phases: np.ndarray

    @staticmethod
    def draw(mean: np.ndarray, spread: np.ndarray, features: int, seed: int) -> Kernel:
        rng = np.random.default_rng(seed)
        width = np.sqrt(len(mean))
        return Kernel(
            mean, spread, rng.normal(size=(len(mean), features)) / width, rng.uniform(0, 2 * np.pi, features)
        )

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.spread, -CLIP, CLIP)
        waves = np.cos(z @ self.directions + self.phases) * np.sqrt(2)
        return np.hstack([waves, np.ones((len(stats), 1))])


@dataclass
class QualityModel:
    kernel: Kernel
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.kernel.features(stats) @ self.weights
        return np.clip(np.interp(raw, self.knots, self.levels), 0.0, 1.0)


def _stack(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _normal_equations(labelled: DataFrame, kernel: Kernel) -> dict[int, np.ndarray]:
    """Sums of products of (features, label) by fold: partial ones per task, added by Spark.

    What comes to the driver is one matrix per fold, whatever the number of rows.
    """
    width = kernel.directions.shape[1] + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            folds = batch["fold"].to_numpy(zero_copy_only=False)
            label = batch["label"].to_numpy(zero_copy_only=False).reshape(-1, 1)
            rows = np.hstack([kernel.features(_stack(batch["stats"], len(NAMES))), label])
            whole = np.rint(rows * _SCALE)
            for fold in np.unique(folds):
                own = whole[folds == fold]
                sums[fold] = sums.get(fold, 0) + np.rint(own.T @ own).astype(np.int64)
        folds = [f for f in sums for _ in range(width)]
        rows = [r for s in sums.values() for r in s]
        columns = [pa.array(folds, pa.int32()), pa.array([*range(width)] * len(sums), pa.int32()), pa.array(rows, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["fold", "i", "row"])

    partial = map_batches(labelled.select("fold", "label", "stats"), run, "fold int, i int, row array<bigint>")
    cells = partial.select("fold", "i", F.posexplode("row").alias("j", "v")).groupBy("fold", "i", "j").agg(F.sum("v").alias("v"))
    found: dict[int, np.ndarray] = {}
    for fold, i, j, v in cells.collect():  # folds x width² cells
        found.setdefault(fold, np.zeros((width, width)))[i, j] = v / _SCALE**2
    return found


def _solve(sums: np.ndarray, ridge: float) -> np.ndarray:
    gram, target = sums[:-1, :-1], sums[:-1, -1]
    penalty = ridge * max(gram[-1, -1], 1.0) * np.eye(len(gram))
    penalty[-1, -1] = 1e-9  # the constant is not shrunk
    return np.linalg.solve(gram + penalty, target)


def _squares(sums: np.ndarray, weights: np.ndarray) -> float:
    tail = np.append(weights, -1.0)
    return float(tail @ sums @ tail)


def isotonic(x: np.ndarray, total: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising means of ``total / weight`` along ``x`` by pooling neighbours: the ends and levels of the blocks."""
    blocks: list[list[float]] = []
    for at, t, w in zip(x.tolist(), total.tolist(), weight.tolist()):
        blocks.append([at, at, t, w])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            low, (_, high, t2, w2) = blocks[-2], blocks.pop()
            low[1], low[2], low[3] = high, low[2] + t2, low[3] + w2
    knots = [k for b in blocks for k in ((b[0], b[1]) if b[0] < b[1] else (b[0],))]
    levels = [v for b in blocks for v in [b[2] / b[3]] * (2 if b[0] < b[1] else 1)]
    return np.array(knots), np.array(levels)


def _calibration(labelled: DataFrame, kernel: Kernel, by_fold: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic levels over scores that each row got from a model fitted without its fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds = batch["fold"].to_numpy(zero_copy_only=False)
            rows = kernel.features(_stack(batch["stats"], len(NAMES)))
            weights = np.stack([by_fold[f] for f in folds.tolist()]) if len(folds) else np.zeros((0, rows.shape[1]))
            raw = np.clip((rows * weights).sum(axis=1), -1.0, 2.0)
            bins = np.rint(raw * _BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch["label"]], names=["bin", "label"])

    bins = (
        map_batches(labelled.select("fold", "label", "stats"), run, "bin int, label double")
        .groupBy("bin").agg(F.sum("label").alias("total"), F.count("*").alias("weight"))
        .orderBy("bin").collect()  # at most 3 x _BINS rows
    )
    x, total, weight = (np.array([r[k] for r in bins], float) for k in ("bin", "total", "weight"))
    return isotonic(x / _BINS, total, weight)


def fit_quality(
    docs: DataFrame, labels: DataFrame, features: int = FEATURES, ridges: tuple[float, ...] = RIDGES, seed: int = SEED
) -> QualityModel:
    """Model of ``labels`` (``doc_id, quality``) from the texts of ``docs`` (``doc_id, text``).

    Only rows outside fold 0 are learned from. Means and spreads are over all documents. Several labels of
    one document count as the greatest, null labels as none. The ridge is the one with the least squared
    error on folds left out; the scores of left-out folds are calibrated. Without labels of both kinds every
    score is the share of label 1, or 1 if there is none at all: nothing is known against a document.
    """
    return fit_statistics(cut_lineage(statistics(docs)), labels, features, ridges, seed)


def fit_statistics(
    stats: DataFrame, labels: DataFrame, features: int = FEATURES, ridges: tuple[float, ...] = RIDGES, seed: int = SEED
) -> QualityModel:
    """:func:`fit_quality` from :func:`statistics` that were written; they are read several times."""
    cells = [F.struct(F.avg(F.col("stats")[i]).alias("m"), F.stddev_pop(F.col("stats")[i]).alias("s")) for i in range(len(NAMES))]
    moments = stats.agg(F.array(*cells).alias("x")).first()["x"]
    mean, spread = (np.array([float(f"{c[k] or 0.0:.9g}") for c in moments]) for k in ("m", "s"))
    kernel = Kernel.draw(mean, np.where(spread > 1e-9, spread, 1.0), features, seed)
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
    # Placed evenly: a label is a few bytes, and the statistics are short too.
    labelled = cut_lineage(
        stats.join(known, "doc_id").withColumn("fold", fold_of(F.col("doc_id"))).where("fold <> 0").select("fold", "label", "stats")
    )
    sums = _normal_equations(labelled, kernel)
    whole = sum(sums.values()) if sums else np.zeros((features + 2, features + 2))
    rows, ones = whole[-2, -2], whole[-2, -1]
    if ones == 0 or ones == rows:
        share = 1.0 if rows == 0 or ones else 0.0
        return QualityModel(kernel, np.zeros(features + 1), np.zeros(1), np.array([share]))

    def without(fold: int, ridge: float) -> np.ndarray:
        return _solve(whole - sums[fold] if len(sums) > 1 else whole, ridge)

    errors = {r: sum(_squares(s, without(f, r)) for f, s in sums.items()) for r in ridges}
    ridge = min(ridges, key=errors.get)
    knots, levels = _calibration(labelled, kernel, {int(f): without(f, ridge) for f in sums})
    return QualityModel(kernel, _solve(whole, ridge), knots, levels)


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Only ``text`` is looked at; null counts as empty. Other columns pass through, but for those named score or
    predicted, which are replaced. Repeated rows get equal scores. An empty table gives an empty result.
    """
    docs = docs.drop("score", "predicted")
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = np.array([text_statistics(t) for t in as_bytes(batch["text"])]).reshape(-1, len(NAMES))
            score = model.score(stats)
            more = [pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch[c] for c in columns] + more, names=[*columns, "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_batches(docs, run, schema + ", score double, predicted int")


def score_statistics(stats: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` as :func:`score_quality` gives them, from the :func:`statistics` of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_stack(batch["stats"], len(NAMES)))
            columns = [batch["doc_id"], pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "predicted"])

    schema = f"doc_id {dict(stats.dtypes)['doc_id']}, score double, predicted int"
    return map_batches(stats.select("doc_id", "stats"), run, schema)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    # Every text is looked at once: the model is fitted on the written statistics, and they are scored.
    stats = cut_lineage(statistics(read_table(spark, sf_dir, "documents").select("doc_id", "text")))
    model = fit_statistics(stats, read_table(spark, sf_dir, "labels"))
    held_out = F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return score_statistics(stats, model).select("doc_id", held_out, "score", "predicted")
