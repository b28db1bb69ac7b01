"""Documents that hold items of a benchmark: MinHash containment search by item size, checked exactly."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repomine.llm.text import as_bytes, map_batches, read_table, window_hashes, word_hashes

SHINGLE_WORDS = 5
LEAST_CONTAINMENT = 0.8

# Characters of benchmark text that a worker holds at once; a larger benchmark is searched in blocks. The shingles of
# this much text, as tuples of words, take some hundred megabytes.
BLOCK_CHARS = 4 * 1024 * 1024

# Words are letters and digits, in lower case: punctuation and case do not hide a copy.
_WORD = re.compile(r"[^\W_]+")


def text_words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _grams(words: list[str], size: int) -> list[tuple[str, ...]]:
    return list(zip(*(words[i:] for i in range(size))))


def _needed(shingles: int, least: float) -> int:
    """Shingles a match must hold: ``least`` of them, rounded up, in thousandths."""
    return -(-shingles * round(least * 1000) // 1000)


class _Sketches:
    """MinHash sketches of the items with one shingle length, partitioned by size.

    A partition has the items of 2^k to 2^(k+1) - 1 shingles. Their sketch is the smallest shingle hashes, one
    more than the largest of them may lack: a document that holds ``least`` of an item then holds a hash of
    its sketch, so no match is missed.
    """

    def __init__(self, shingle: int, items: list[tuple], least: float):
        self.shingle, self.items = shingle, items
        self.needed = [_needed(len(grams), least) for _, grams in items]
        sketch, owner = [], []
        for at, (_, grams) in enumerate(items):
            largest = (1 << len(grams).bit_length()) - 1
            hashes = np.sort(np.concatenate([window_hashes(word_hashes(list(g)), shingle) for g in grams]))
            smallest = hashes[: largest - _needed(largest, least) + 1]
            sketch.append(smallest)
            owner += [at] * len(smallest)
        flat = np.concatenate(sketch)
        order = np.argsort(flat, kind="stable")
        self.sketch, self.owner = flat[order], np.array(owner)[order]

    def candidates(self, hashes: np.ndarray) -> list[int]:
        """Items whose sketch meets the document."""
        place = np.minimum(np.searchsorted(self.sketch, hashes), len(self.sketch) - 1)
        hit = np.unique(hashes[self.sketch[place] == hashes])
        low, high = np.searchsorted(self.sketch, hit, "left"), np.searchsorted(self.sketch, hit, "right")
        return sorted({int(o) for i, j in zip(low, high) for o in self.owner[i:j]})


def sketch_items(items: list[tuple], shingle: int, least: float) -> list[_Sketches]:
    """Sketches of ``(item_id, text)``. An item of fewer words than a shingle is one shingle."""
    groups: dict[int, list[tuple]] = {}
    for item_id, text in items:
        words = text_words(text)
        if words:
            size = min(shingle, len(words))
            groups.setdefault(size, []).append((item_id, sorted(set(_grams(words, size)))))
    return [_Sketches(size, members, least) for size, members in sorted(groups.items())]


# What this worker process has sketched last: the name of the block and its sketches.
_held: dict[str, list[_Sketches]] = {}


def _sketches_of(name: str, block: Broadcast, shingle: int, least: float) -> list[_Sketches]:
    """Sketches of a block, made once per worker process and not in every task; one block is held at a time."""
    if name not in _held:
        _held.clear()
        _held[name] = sketch_items(block.value, shingle, least)
    return _held[name]


def _search_block(docs: DataFrame, items: list[tuple], shingle: int, least: float) -> DataFrame:
    block = docs.sparkSession.sparkContext.broadcast(items)  # bounded by BLOCK_CHARS
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches = _sketches_of(name, block, shingle, least)
        for batch in batches:
            found: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), as_bytes(batch["text"])):
                words = text_words(text.decode())
                base = word_hashes(words)
                hashes = {c.shingle: window_hashes(base, c.shingle) for c in sketches}
                held: dict[int, set] = {}
                for group in sketches:
                    for at in group.candidates(hashes[group.shingle]):
                        own = held.get(group.shingle)
                        if own is None:
                            own = held[group.shingle] = set(_grams(words, group.shingle))
                        item_id, grams = group.items[at]
                        matched = sum(g in own for g in grams)
                        if matched >= group.needed[at]:
                            found.append((doc_id, item_id, matched, len(grams), matched / len(grams)))
            kinds = [doc_type, item_type, pa.int64(), pa.int64(), pa.float64()]
            columns = list(zip(*found)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    names = ["doc_id", "item_id", "matched", "shingles", "containment"]
    doc_type = item_type = pa.int64()
    return map_batches(docs, run, "doc_id bigint, item_id bigint, matched bigint, shingles bigint, containment double")


def benchmark_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    shingle: int = SHINGLE_WORDS,
    least: float = LEAST_CONTAINMENT,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``doc_id, item_id, matched, shingles, containment``: documents that hold at least the share ``least``
    of the different shingles of a benchmark item, however long the document.

    Items are grouped by size; each class has sketches of the smallest hashes, long enough that a match
    cannot be missed. Documents are read once per block of the benchmark, whose size is measured, and are
    not shuffled. Every candidate is checked on the words themselves.

    Words are runs of letters and digits in lower case. An item of fewer than ``shingle`` words is one
    shingle of all its words; one without words matches nothing. A null text counts as empty. Equal items
    match each on their own; repeated documents come out as often as they came in; items without id are not
    searched, documents without id are and keep their null. Other columns are not read. Empty tables give an
    empty result.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("bigint"), "text")
    chars = items.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    place = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    found = None
    for block in range(blocks):
        own = [tuple(r) for r in items.where(place == block).collect()]
        part = _search_block(docs, own, shingle, least)
        found = part if found is None else found.union(part)
    return found


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    return benchmark_matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM benchmark WHERE item_id IS NOT NULL
), item_sizes AS (
  SELECT item_id, ws, least(5, len(ws)) AS size FROM item_words WHERE len(ws) > 0
), item_grams AS (
  SELECT DISTINCT item_id, size, array_to_string(list_slice(ws, pos, pos + size - 1), ' ') AS gram
  FROM (SELECT item_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS pos FROM item_sizes)
), totals AS (
  SELECT item_id, count(*) AS shingles FROM item_grams GROUP BY item_id
), sizes AS (
  SELECT DISTINCT size FROM item_sizes
), doc_grams AS (
  SELECT DISTINCT doc_id, size, array_to_string(list_slice(ws, pos, pos + size - 1), ' ') AS gram
  FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS pos FROM doc_words, sizes WHERE len(ws) >= size)
), met AS (
  SELECT doc_id, item_id, count(*) AS matched FROM doc_grams JOIN item_grams USING (size, gram) GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, matched, shingles, matched / shingles AS containment
FROM met JOIN totals USING (item_id) WHERE matched * 1000 >= shingles * 800
"""
