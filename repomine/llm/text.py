"""Words, shingle hashes and Arrow batches shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import os
import time
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows per Arrow batch. Texts may be long, and a batch is held whole by a task.
BATCH_ROWS = 256

# Distinct words a task remembers; the table starts anew beyond it.
WORD_CACHE = 1 << 18

_MULTIPLIERS = (
    (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F),
    (0xD6E8FEB86659FD93, 0xA0761D6478BD642F),
)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep the batches between Spark and Python small; long texts would make the usual ones too large."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow`` with small batches.

    Workers on this machine import the package from where the driver did; on a cluster it is shipped with
    ``--py-files`` or installed, and the extra path does no harm.
    """
    small_batches(df.sparkSession)
    paths = df.sparkSession.sparkContext.environment
    here = str(Path(__file__).resolve().parents[2])
    if here not in paths.get("PYTHONPATH", "").split(os.pathsep):
        paths["PYTHONPATH"] = os.pathsep.join(filter(None, [here, paths.get("PYTHONPATH")]))
    return df.mapInArrow(fn, schema)


def free_names(columns: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, lengthened until no column has them; case does not count."""
    taken, names = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return names


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose result was written.

    They are deleted when the driver's collector finds that nothing refers to them, which a driver with much
    memory would put off until the disks are full. The first round lets go of the plans, the second finds
    the files.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def split_words(text: bytes) -> list[bytes]:
    """Maximal runs of anything but ASCII white space (0x20, 0x09 to 0x0D)."""
    return text.split()


# Hashes of all words of a text at once: a word's bytes, each as a random number, are weighted by powers of
# an odd number, so the sum over a word is a difference of running sums, divided by the power it begins at.
_LETTERS = np.random.default_rng(42).integers(1, 2**64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
# Text hashed at once, and the longest word hashed that way; longer words get an ordinary hash.
_BLOCK_BYTES = 1 << 18
_LONGEST = 255
_powers: dict[str, np.ndarray] = {}


def _power_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < size:
        for name, base in (("up", _BASE), ("down", _UNBASE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of :func:`split_words` begin and end."""
    blank = np.ones(len(text) + 2, bool)
    blank[1:-1] = _BLANK[np.frombuffer(text, np.uint8)]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    return edges[::2], edges[1::2]


def hash_words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of a text, and where the words begin and end. No step per word."""
    starts, ends = word_bounds(text)
    hashes = np.empty(len(starts), np.uint64)
    codes = np.frombuffer(text, np.uint8)
    first = 0
    while first < len(starts):
        # Whole words, as many as fit a block, at least one.
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + _BLOCK_BYTES, "right")))
        at, stop = int(starts[first]), int(ends[last - 1])
        if stop - at <= _BLOCK_BYTES:
            up, down = _power_table(_BLOCK_BYTES)
            sums = np.zeros(stop - at + 1, np.uint64)
            np.cumsum(_LETTERS[codes[at:stop]] * up[: stop - at], out=sums[1:])
            own = starts[first:last] - at
            mixed = (sums[ends[first:last] - at] - sums[own]) * down[own]
            mixed ^= mixed >> np.uint64(32)
            mixed *= np.uint64(0xD6E8FEB86659FD93)
            hashes[first:last] = mixed ^ (mixed >> np.uint64(29))
        first = last
    for i in np.flatnonzero(ends - starts > _LONGEST).tolist():
        hashes[i] = xxhash.xxh64_intdigest(text[starts[i] : ends[i]])
    return hashes, starts, ends


def hash_batch(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """:func:`hash_words` of many texts in one go: the texts with a line end after each, the hashes, begins and
    ends of the words in that, and for each text its first word, with the number of words at the end."""
    joined = b"\n".join([*texts, b""])
    hashes, starts, ends = hash_words(joined)
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return joined, hashes, starts, ends, np.searchsorted(starts, offsets)


def split_words_col(text: Column) -> Column:
    """:func:`split_words` as a column; null has no words."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


class _WordHashes(dict):
    def __missing__(self, word: bytes | str) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = _WordHashes()


def word_hashes(words: list[bytes] | list[str]) -> np.ndarray:
    """A 64-bit hash of every word, that of its UTF-8 bytes."""
    if len(_hashes) > WORD_CACHE:
        _hashes.clear()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def _combine(left: np.ndarray, right: np.ndarray, variant: int) -> np.ndarray:
    a, b = (np.uint64(m) for m in _MULTIPLIERS[variant])
    mixed = left * a + (right ^ (right >> np.uint64(29))) * b
    return mixed ^ (mixed >> np.uint64(32))


def window_hashes(hashes: np.ndarray, size: int, variant: int = 0) -> np.ndarray:
    """A hash of every ``size`` consecutive words, from those of 1, 2, 4 … words. Two variants are independent."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    whole, done, power, step = None, 0, hashes, 1
    while True:
        if size & step:
            part = power[done : done + count]
            whole = part if whole is None else _combine(whole, part, variant)
            done += step
        if 2 * step > size:
            return whole
        power = _combine(power[:-step], power[step:], variant)
        step *= 2


def signed(hashes: np.ndarray) -> np.ndarray:
    """The same bits as Spark's bigint."""
    return hashes.view(np.int64)


def unsigned(values: Iterable[int]) -> np.ndarray:
    return np.asarray(list(values), np.int64).view(np.uint64)
