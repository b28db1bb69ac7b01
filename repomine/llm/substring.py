"""Removal of long word sequences that stand in an earlier document, found through difference-cover anchors."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repomine.llm.text import as_bytes, drop_shuffles, free_names, hash_batch, map_batches, read_table, signed, split_words_col, window_hashes
from repomine.session import cut_lineage

# Fixed value of the contract.
WINDOW_WORDS = 50
# Anchors stand at these places modulo the period; every residue is a difference of two of them.
PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)

# Columns that `remove_repeats` adds; columns of the input with these names are replaced.
ADDED = "n_words bigint, n_removed bigint, removed array<struct<start: bigint, end: bigint>>"


def anchor_places(
    hashes: np.ndarray, firsts: np.ndarray, window: int, period: int, cover: tuple[int, ...]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of many documents, whose words follow each other from ``firsts`` on: the number of the document,
    the place of the anchor among all words, and the hash of the words from there on.

    An anchor is ``window - period + 1`` words long and stands at a cover place modulo the period, counted
    from the document's first word. Where two documents share ``window`` words, some place within the first
    ``period`` of them is in the cover in both, whatever their distance. Documents shorter than a window have
    no anchors.
    """
    size = window - period + 1
    grams = window_hashes(hashes, size)
    lengths = np.diff(firsts)
    doc = np.repeat(np.arange(len(lengths)), lengths)[: len(grams)]
    within = np.arange(len(grams)) - firsts[doc]
    in_cover = np.zeros(period, bool)
    in_cover[list(cover)] = True
    places = np.flatnonzero(in_cover[within % period] & (within + size <= lengths[doc]) & (lengths[doc] >= window))
    return doc[places], places, grams[places]


def _whole_hash(hashes: np.ndarray) -> tuple[int, int]:
    """128-bit key of all words."""
    return struct.unpack("<qq", xxhash.xxh3_128_digest(hashes.tobytes()))


def _copies(hashes: np.ndarray, firsts: np.ndarray, keys: pa.Array) -> np.ndarray:
    """Which of the texts have all the words of an earlier document, by its key among those of the ``doc_id``."""
    found = np.zeros(len(keys), bool)
    for row, own in enumerate(keys.to_pylist()):
        if own:
            found[row] = _whole_hash(hashes[firsts[row] : firsts[row + 1]])[0] in own
    return found


def _anchors(docs: DataFrame, window: int, period: int, cover: tuple[int, ...]) -> DataFrame:
    """``key, check, doc_id``: one row per document and different anchor, and one for the whole document.

    Anchors only find candidates and have no check. The whole document has one, which makes its key 128 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc_id"].to_numpy(zero_copy_only=False)
            _, hashes, _, _, firsts = hash_batch(as_bytes(batch["text"]))
            doc, _, grams = anchor_places(hashes, firsts, window, period, cover)
            order = np.lexsort((grams, doc))
            doc, grams = doc[order], grams[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
            long = np.flatnonzero(np.diff(firsts) >= window)
            whole = np.array([_whole_hash(hashes[firsts[d] : firsts[d + 1]]) for d in long], np.int64).reshape(-1, 2)
            keys = np.concatenate([signed(grams[new]), whole[:, 0]])
            checks = np.concatenate([np.zeros(int(new.sum()), np.int64), whole[:, 1]])
            yield _rows(keys, checks, ids[np.concatenate([doc[new], long])])

    # A document without id is never the earlier one and is left as it is.
    return map_batches(docs.where("doc_id is not null").select("doc_id", "text"), run, _KEYED)


_KEYED = "key bigint, check bigint, doc_id bigint"


def _rows(keys: np.ndarray, checks: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (keys, checks, ids)], names=["key", "check", "doc_id"])


def _join_shared(keyed: DataFrame) -> DataFrame:
    """``keyed`` rows whose key more than one document holds, with ``low``, the least of these.

    The least and the greatest document of a key are combined before the shuffle, so a key that a third of
    all documents hold is a row per task. The shared keys are written before they are joined back: the first
    shuffle is dropped then, and the join is a plain one that adaptive execution splits at a hot key.
    """
    ends = keyed.groupBy("key", "check").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    shared = cut_lineage(ends.where("low < high").drop("high"))
    drop_shuffles(keyed.sparkSession)
    return keyed.join(shared, ["key", "check"])


def _met_anchors(docs: DataFrame, window: int, period: int, cover: tuple[int, ...]) -> DataFrame:
    """``doc_id, anchors, copies`` of documents that share an anchor with another one: the shared anchors, and
    the keys of whole texts that an earlier document has too.

    """
    met = _join_shared(_anchors(docs, window, period, cover))
    return met.groupBy("doc_id").agg(
        F.collect_list(F.when(F.col("check") == 0, F.col("key"))).alias("anchors"),
        F.collect_set(F.when((F.col("check") != 0) & (F.col("low") < F.col("doc_id")), F.col("key"))).alias("copies"),
    )


def _of_doc(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes told apart by the document, to look up those of many documents at once."""
    return hashes ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _window_keys(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    return window_hashes(hashes, window, 0), window_hashes(hashes, window, 1)


def _candidate_windows(
    docs: DataFrame, met: DataFrame, window: int, period: int, cover: tuple[int, ...]
) -> DataFrame:
    """``key, check, doc_id``: the 128-bit keys of the windows that hold a shared anchor.

    Texts with all the words of an earlier one are left out: the earlier one has all their windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc_id"].to_numpy(zero_copy_only=False)
            _, hashes, _, _, firsts = hash_batch(as_bytes(batch["text"]))
            doc, places, grams = anchor_places(hashes, firsts, window, period, cover)
            lists = batch["anchors"]
            counts = lists.value_lengths().to_numpy(zero_copy_only=False)
            shared = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            met = np.isin(_of_doc(grams, doc), _of_doc(shared, np.repeat(np.arange(len(ids)), counts)))
            met &= ~_copies(hashes, firsts, batch["copies"])[doc]
            doc, places = doc[met], places[met]
            # The windows that hold the anchor begin up to period - 1 words before it, within the document.
            change = np.zeros(len(hashes) + 1, np.int64)
            np.add.at(change, np.maximum(places - period + 1, firsts[doc]), 1)
            np.add.at(change, np.minimum(places, firsts[doc + 1] - window) + 1, -1)
            begins = np.flatnonzero(np.cumsum(change)[:-1] > 0)
            keys, checks = _window_keys(hashes, window)
            owner = np.searchsorted(firsts, begins, "right") - 1
            yield _rows(signed(keys[begins]), signed(checks[begins]), ids[owner])

    near = docs.select("doc_id", "text").join(met, "doc_id")
    return map_batches(near, run, _KEYED)


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _cut(text: bytes, starts: np.ndarray, ends: np.ndarray, removed: list[tuple[int, int]]) -> bytes:
    """The text without some ranges of words; what stands between kept neighbours stays, a cut leaves one line end."""
    kept, at = [], 0
    for first, last in [*removed, (len(starts), len(starts))]:
        if at < first:
            kept.append(text[starts[at] : ends[first - 1]])
        at = last
    return b"\n".join(kept)


def remove_repeats(
    docs: DataFrame, window: int = WINDOW_WORDS, period: int = PERIOD, cover: tuple[int, ...] = COVER
) -> DataFrame:
    """``docs`` with every word removed that lies in a window of ``window`` consecutive words whose sequence
    also starts in a document with a smaller ``doc_id``. Windows are judged on the input.

    ``text`` is the text without those words (unchanged, and never null, if none is removed); ``n_words``,
    ``n_removed`` and ``removed`` (word ranges, end excluded) are added and replace columns of these names.
    A null text has no words. Several rows with one ``doc_id``, equal or not, are one document and remove nothing
    from each other. Rows without ``doc_id`` are kept as they are. Other columns pass through. An empty table gives an
    empty result.
    """
    if period > window or {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError("the cover must have every difference modulo the period, and the period fit the window")
    added = [x.split()[0] for x in ("n_words", "n_removed", "removed")]
    docs = docs.drop(*added).withColumn("text", F.coalesce("text", F.lit("")))
    keys_name, checks_name, copies_name = free_names(docs.columns, "_keys", "_checks", "_copies")
    # Each step is written and its shuffles dropped before the next one fills the disks.
    met = cut_lineage(_met_anchors(docs, window, period, cover))
    drop_shuffles(docs.sparkSession)
    windows = _candidate_windows(docs, met, window, period, cover)
    found = _join_shared(windows).where("low < doc_id")
    repeated = found.groupBy("doc_id").agg(F.collect_list("key").alias(keys_name), F.collect_list("check").alias(checks_name))
    repeated = cut_lineage(repeated)
    drop_shuffles(docs.sparkSession)
    copies = met.where("size(copies) > 0").select("doc_id", F.col("copies").alias(copies_name))
    marked = docs.join(repeated, "doc_id", "left").join(copies, "doc_id", "left")
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, checks = batch[keys_name], batch[checks_name]
            texts, n_words, n_removed, removed = [], [], [], []
            raw = as_bytes(batch["text"])
            joined, hashes, starts, ends, firsts = hash_batch(raw)
            copy = _copies(hashes, firsts, batch[copies_name])
            for row, text in enumerate(raw):
                own = slice(firsts[row], firsts[row + 1])
                size = own.stop - own.start
                gone = np.zeros(size, bool)
                if copy[row]:
                    gone[:] = True
                elif keys[row].is_valid:
                    pairs = np.unique(np.stack([x[row].values.to_numpy(zero_copy_only=False) for x in (keys, checks)]), axis=1)
                    own_keys, own_checks = map(signed, _window_keys(hashes[own], window))
                    place = np.minimum(np.searchsorted(pairs[0], own_keys), pairs.shape[1] - 1)
                    begins = np.flatnonzero((pairs[0][place] == own_keys) & (pairs[1][place] == own_checks))
                    change = np.zeros(size + 1, np.int64)
                    change[begins] += 1
                    change[begins + window] -= 1
                    gone = np.cumsum(change)[:-1] > 0
                spans = _spans(gone)
                texts.append(_cut(joined, starts[own], ends[own], spans) if spans else text)
                n_words.append(int(size))
                n_removed.append(int(gone.sum()))
                removed.append([{"start": a, "end": b} for a, b in spans])
            kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            own_columns = [
                pa.array(texts, pa.binary()).cast(pa.string()) if name == "text" else batch[name] for name in columns
            ]
            more = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, kinds)]
            yield pa.RecordBatch.from_arrays(own_columns + more, names=[*columns, *added])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", " + ADDED
    return map_batches(marked, run, schema)


def op10_substring(spark, sf_dir: str) -> DataFrame:
    cut = remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.array_join(split_words_col(F.col("text")), " ")
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), windows AS (
  SELECT doc_id, pos, array_to_string(list_slice(ws, pos, pos + 49), chr(1)) AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS pos FROM words WHERE len(ws) >= 50)
), earliest AS (
  SELECT win, min(doc_id) AS low FROM windows GROUP BY win
), hits AS (
  SELECT doc_id, pos FROM windows JOIN earliest USING (win) WHERE low < doc_id
), placed AS (
  SELECT doc_id, w, pos FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM words WHERE len(ws) > 0)
), flagged AS (
  SELECT p.doc_id, p.pos, p.w, max(h.pos) OVER (PARTITION BY p.doc_id ORDER BY p.pos) AS last_hit
  FROM placed p LEFT JOIN hits h ON h.doc_id = p.doc_id AND h.pos = p.pos
), judged AS (
  SELECT doc_id, pos, w, coalesce(last_hit + 50 > pos, false) AS gone FROM flagged
), sums AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
         string_agg(w, ' ' ORDER BY pos) FILTER (NOT gone) AS kept
  FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN sums s ON s.doc_id = d.doc_id
"""
