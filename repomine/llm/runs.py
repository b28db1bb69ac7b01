"""Periodic runs of words: maximal repetitions, found on a harmonic grid with longest common extensions."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repomine.llm.text import as_bytes, map_batches, read_table

# Fixed value of the contract: the least length of a run, in words.
LEAST_WORDS = 12

# Suffixes begin at these places modulo the period; every residue is a difference of two of them.
PERIOD = 21
COVER = (0, 1, 4, 14, 16)

# Words of several texts that are looked at together, and pairs of places compared at once.
BLOCK_WORDS = 1 << 16
PAIRS = 1 << 18


def _meeting_shifts(period: int, cover: tuple[int, ...]) -> np.ndarray:
    """``[a, b]``: the least shift that takes places of residues a and b into the cover together."""
    inside = np.zeros(period, bool)
    inside[list(cover)] = True
    place = np.arange(period)
    shifts = np.full((period, period), -1)
    for shift in reversed(range(period)):
        both = inside[(place + shift) % period][:, None] & inside[(place + shift) % period][None, :]
        shifts[both] = shift
    if (shifts < 0).any():
        raise ValueError("the cover must have every difference modulo the period")
    return shifts


class CommonExtensions:
    """How many words from two places on are the same, for any pairs of places of one sequence.

    Only the suffixes at cover places are sorted: by their first ``period`` words, then by doubling, since a
    cover place and the one ``period`` further are both in the sample. A pair is compared word by word for the
    few words until both places are in the cover; from there the answer is the least common prefix between
    the two in sorted order, read from a sparse table.

    The last word must occur nowhere else, so that every comparison ends within the sequence.
    """

    def __init__(self, words: np.ndarray, period: int = PERIOD, cover: tuple[int, ...] = COVER):
        self.period, self.size = period, len(cover)
        self.shifts = _meeting_shifts(period, cover)
        blocks = -(-len(words) // period)
        self.words = np.full(period * (blocks + 2), -1, np.int64)
        self.words[: len(words)] = words
        self.rank_in_cover = np.full(period, -1)
        self.rank_in_cover[sorted(cover)] = np.arange(len(cover))
        places = (np.arange(blocks)[:, None] * period + np.array(sorted(cover))[None, :]).ravel()
        places = places[places < len(words)]
        names = [self._first_names(places)]
        step = len(cover)
        # Names of period * 2^k words; `step` sample places further lie as many words.
        while names[-1].max(initial=0) + 1 < len(places):
            later = np.full(len(places), -1, np.int64)
            later[:-step] = names[-1][step:]
            names.append(np.unique(names[-1] * (len(places) + 1) + later + 1, return_inverse=True)[1])
            step *= 2
        order = np.argsort(names[-1], kind="stable")
        self.rank = np.empty(len(places), np.int64)
        self.rank[order] = np.arange(len(places))
        self.table = self._sparse_table(self._neighbours(places, names, order))

    def _first_names(self, places: np.ndarray) -> np.ndarray:
        """Numbers of the first ``period`` words, in their order."""
        bits = int(self.words.max(initial=0) + 2).bit_length()
        fits = max(1, 62 // bits)
        keys = []
        for first in range(0, self.period, fits):
            key = np.zeros(len(places), np.int64)
            for word in range(first, min(first + fits, self.period)):
                key = (key << bits) | (self.words[places + word] + 1)
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(places), bool)
        for key in keys:
            own = key[order]
            new[1:] |= own[1:] != own[:-1]
        names = np.empty(len(places), np.int64)
        names[order] = np.cumsum(new)
        return names

    def _neighbours(self, places: np.ndarray, names: list[np.ndarray], order: np.ndarray) -> np.ndarray:
        """Common words of suffixes next to each other in sorted order: by names from the longest on, then words."""
        one, two = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(one), np.int64)
        for k in reversed(range(len(names) - 1)):
            same = np.flatnonzero(names[k][one] == names[k][two])
            common[same] += self.period << k
            one[same] += self.size << k
            two[same] += self.size << k
        return common + self._words_in_common(places[one], places[two], np.full(len(one), self.period))

    def _words_in_common(self, one: np.ndarray, two: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from two places on, up to ``most`` each."""
        common = np.zeros(len(one), np.int64)
        going = np.flatnonzero(most > 0)
        while len(going):
            at = common[going]
            going = going[self.words[one[going] + at] == self.words[two[going] + at]]
            common[going] += 1
            going = going[common[going] < most[going]]
        return common

    @staticmethod
    def _sparse_table(values: np.ndarray) -> list[np.ndarray]:
        table, width = [values], 1
        while 2 * width <= len(values):
            table.append(np.minimum(table[-1][:-width], table[-1][width:]))
            width *= 2
        return table

    def _least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least value of ``low`` … ``high - 1``: two overlapping powers of two."""
        level = np.frexp(high - low)[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level).tolist():
            own = np.flatnonzero(level == k)
            out[own] = np.minimum(self.table[k][low[own]], self.table[k][high[own] - (1 << k)])
        return out

    def __call__(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Common words from ``one`` and ``two`` on, which are different places pair by pair."""
        shift = self.shifts[one % self.period, two % self.period]
        common = self._words_in_common(one, two, shift)
        far = np.flatnonzero(common == shift)
        if len(far):
            ranks = []
            for places in (one, two):
                block, residue = np.divmod(places[far] + shift[far], self.period)
                ranks.append(self.rank[block * self.size + self.rank_in_cover[residue]])
            common[far] += self._least(np.minimum(*ranks), np.maximum(*ranks))
        return common


def _grid_pairs(words: np.ndarray, text: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``places, periods``: equal words of one text at neighbouring multiples of a period, up to ``longest``.

    A run of at least two periods holds two neighbouring multiples of its period, and they are such a pair.
    Short periods are looked at one by one along the grid; of the long ones, which have few multiples, the
    first multiples of all periods at once, then the second, and so on.
    """
    n = len(words)
    near = min(longest, int(n**0.5))
    for q in range(1, near + 1):
        grid, owner = words[::q], text[::q]
        hits = np.flatnonzero((grid[1:] == grid[:-1]) & (owner[1:] == owner[:-1]))
        yield hits * q, np.full(len(hits), q)
    multiple = 0
    while (multiple + 1) * (near + 1) < n and near < longest:
        last = min(longest, (n - 1) // (multiple + 1))
        q = np.arange(near + 1, last + 1)
        one, two = q * multiple, q * (multiple + 1)
        hits = np.flatnonzero((words[one] == words[two]) & (text[one] == text[two]))
        yield one[hits], q[hits]
        multiple += 1


def _gathered(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held, size = [], 0
    for pair in pairs:
        held.append(pair)
        size += len(pair[0])
        if size >= PAIRS:
            yield tuple(map(np.concatenate, zip(*held)))
            held, size = [], 0
    if size:
        yield tuple(map(np.concatenate, zip(*held)))


@dataclass
class Runs:
    """Runs of several texts: which text, first word and end (excluded) within it, and period."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    period: np.ndarray


def find_runs(texts: list[np.ndarray], least: int = LEAST_WORDS) -> Runs:
    """The runs of texts given as numbers of words (0 or more), by text, start and period.

    The texts are one sequence with a word of its own after each, so no comparison leaves a text. From both
    places of a grid pair the common words are counted forwards, and backwards on the reversed sequence. If
    they make a period together, they are a run; its first grid pair counts, and of several periods of the
    same words the smallest.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    last = lengths + 1
    firsts = np.cumsum(last) - last
    longest = int(lengths.max(initial=0)) // 2
    empty = np.empty(0, np.int64)
    if 2 * longest < least and int(lengths.max(initial=0)) < least:
        return Runs(empty, empty, empty, empty)
    size = 1 + max(int(t.max(initial=0)) for t in texts)
    words = np.concatenate([np.append(t, size + i) for i, t in enumerate(texts)])
    owner = np.repeat(np.arange(len(texts)), last)
    forwards = CommonExtensions(words)
    # Reversed, the end marks stand before the texts; one more at the end closes the first of them.
    backwards = CommonExtensions(np.append(words[::-1], size + len(texts)))
    found = []
    for place, q in _gathered(_grid_pairs(words, owner, longest)):
        after = forwards(place, place + q)
        enough = after >= np.maximum(1, least + 1 - 2 * q)
        place, q, after = place[enough], q[enough], after[enough]
        # The words before: reversed, word i - 1 stands at n - i.
        before = backwards(len(words) - place, len(words) - place - q)
        run = (before < q) & (before + after >= np.maximum(q, least - q))
        place, q, before, after = (x[run] for x in (place, q, before, after))
        found.append(np.stack([place - before, place + q + after, q]))
    start, end, q = np.concatenate(found, axis=1) if found else (empty, empty, empty)
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, q = start[new], end[new], q[new]
    text = owner[start]
    order = np.lexsort((q, start))
    return Runs(text[order], (start - firsts[text])[order], (end - firsts[text])[order], q[order])


def _word_numbers(text: bytes, known: dict[bytes, int]) -> np.ndarray:
    parts = text.split()
    for word in set(parts).difference(known):
        known[word] = len(known)
    return np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))


def planted_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which word stands at each place, for the documents that the contract makes periodic; None for the others."""
    if doc_id is None or not n:
        return None
    g, chosen = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if chosen:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def periodic_runs(docs: DataFrame, least: int = LEAST_WORDS, planted: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_words, runs, collapsed``.

    ``runs`` are structs ``start, length, period`` by start, then period: stretches of words with a smallest
    period, of at least ``least`` words and two periods, that no neighbouring word extends. ``collapsed`` are
    the words of the text, a blank between, without those that a run repeats: the words of a run after its
    first period. ``planted`` first makes periodic the documents that the contract of the query names.

    Every document is dealt with in its partition; nothing is shuffled. A task looks at texts of
    ``BLOCK_WORDS`` together, or at one longer text, and holds some hundred bytes for each of their words. A null or empty text
    has no words and no runs. Rows without id (never planted) and repeated rows are documents each. Other
    columns are not read. An empty table gives an empty result.
    """
    runs_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def block(ids: list, numbers: list[np.ndarray], known: dict[bytes, int]) -> pa.RecordBatch:
        spelled = list(known)
        found = find_runs(numbers, least)
        bounds = np.searchsorted(found.text, np.arange(len(ids) + 1))
        rows, collapsed = [], []
        for i, words in enumerate(numbers):
            own = slice(bounds[i], bounds[i + 1])
            start, end, q = found.start[own], found.end[own], found.period[own]
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, start + q, 1)
            np.add.at(change, end, -1)
            kept = words[np.cumsum(change)[:-1] == 0]
            collapsed.append(b" ".join([spelled[w] for w in kept.tolist()]))
            rows.append([{"start": s, "length": e - s, "period": p} for s, e, p in zip(start.tolist(), end.tolist(), q.tolist())])
        columns = [
            pa.array(ids, pa.int64()), pa.array([len(w) for w in numbers], pa.int64()), pa.array(rows, runs_type),
            pa.array(collapsed, pa.binary()).cast(pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, known, held = [], [], {}, 0
            for doc_id, text in zip(batch["doc_id"].to_pylist(), as_bytes(batch["text"])):
                words = _word_numbers(text, known)
                order = planted_order(doc_id, len(words)) if planted else None
                ids.append(doc_id)
                numbers.append(words if order is None else words[order])
                held += len(words)
                if held >= BLOCK_WORDS:
                    yield block(ids, numbers, known)
                    ids, numbers, known, held = [], [], {}, 0
            yield block(ids, numbers, known)

    schema = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return map_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), run, schema)


def op12_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(read_table(spark, sf_dir, "documents"), planted=True)
    # Greatest length, then smallest start, then period: the least of the negated length and the others.
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    length = -F.col("best.less")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"),
        F.col("best.period").alias("period"), F.floor(1000 * length / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
