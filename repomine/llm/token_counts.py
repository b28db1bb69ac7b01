"""Token counts of the sections of a document, from one encoding of the whole text."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repomine.llm.text import as_bytes, map_batches, read_table

# How a token that lies in several sections is counted: for the section of its first character, for the one
# that holds most of it (the earlier on a tie), or for each by its share of the token's bytes.
RULES = ("first", "most", "share")

# (names, starts, ends) of the sections in a text, in code points; rising and without overlap.
Sections = tuple[list[str], list[int], list[int]]


def default_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    """The tokenizer of a rank file, and the number of bytes of every token."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    sizes[list(ranks.values())] = [len(t) for t in ranks]
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def line_sections(text: str) -> Sections:
    """``title`` is the first line, then every line is a section of ``body``. A line has its line end."""
    starts, at = [0], text.find("\n")
    while at >= 0:
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    if len(starts) > 1 and starts[-1] == len(text):
        starts.pop()
    if not text:
        return [], [], []
    return ["title"] + ["body"] * (len(starts) - 1), starts, [*starts[1:], len(text)]


def token_spans(text: bytes, path: str, pattern: str) -> np.ndarray:
    """Byte offsets at which the tokens end."""
    encoding, sizes = _encoding(path, pattern)
    return np.cumsum(sizes[np.asarray(encoding.encode_ordinary(text.decode()), np.int64)])


def _byte_offsets(raw: bytes, places: np.ndarray) -> np.ndarray:
    """Bytes before each code point."""
    if len(raw) and raw.isascii():
        return places
    starts = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return np.append(starts, len(raw))[places]


def attribute(ends: np.ndarray, begins: np.ndarray, stops: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of the tokens that meet it also meet something else.

    ``ends`` are the ends of the tokens, ``begins`` and ``stops`` the bounds of the sections, all in bytes.
    A merge of the two sorted lists by binary search; no pair is looked at that does not overlap.
    """
    firsts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    count = np.zeros(len(begins))
    # The tokens that overlap section s are low[s] … high[s] - 1.
    low = np.searchsorted(ends, begins, "right")
    high = np.searchsorted(firsts, stops, "left")
    high = np.where(stops > begins, np.maximum(low, high), low)
    crossing = np.zeros(len(begins), np.int64)
    touching = np.repeat(np.arange(len(begins)), high - low)
    token = np.arange(len(touching)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[touching]
    shared = np.minimum(ends[token], stops[touching]) - np.maximum(firsts[token], begins[touching])
    size = ends[token] - firsts[token]
    np.add.at(crossing, touching, shared < size)
    if rule == "share":
        np.add.at(count, touching, shared / size)
    elif rule == "first":
        np.add.at(count, touching, firsts[token] >= begins[touching])
    else:
        best = np.zeros(len(ends), np.int64)
        np.maximum.at(best, token, shared)
        winner = np.full(len(ends), len(begins))
        full = shared == best[token]
        np.minimum.at(winner, token[full], touching[full])
        np.add.at(count, touching, winner[token] == touching)
    return count, crossing


def count_tokens(
    docs: DataFrame,
    sections: Callable[[str], Sections] | DataFrame = line_sections,
    rule: str = "first",
    path: str | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """One row per section: ``doc_id, section_no, section, start, end, tokens, crossing_tokens, doc_tokens``.

    Each text is encoded once; the tokens' byte offsets are joined with the sections' bounds. ``sections`` is
    a function of the text, or a table ``doc_id, section, start, end`` in code points (end excluded), joined
    by ``doc_id``. A token that crosses a bound is counted by ``rule``, see ``RULES``; ``crossing_tokens``
    says how many of the tokens that meet a section do so. Text outside of all sections is the rest of
    ``doc_tokens``. With ``first`` and ``most`` the counts are whole numbers.

    A null or empty text has no tokens; it has one section without name (number 0), so that no document is
    lost; so has a document without sections. Bounds beyond the text are cut, rows with a null bound are
    dropped, empty sections count 0. Sections of a table are ordered by start and end. Repeated rows are
    counted each. Other columns are not read. An empty table gives an empty result.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule}")
    given = isinstance(sections, DataFrame)
    ranks, own_pattern = (path, pattern) if path and pattern else default_ranks()
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    if given:
        # The sections of one document make one list; a document is one row anyway.
        lists = (
            sections.where("doc_id is not null and start is not null and `end` is not null")
            .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
            .agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("bigint").alias("s"), F.col("end").cast("bigint").alias("e"), F.col("section").cast("string").alias("n")))).alias("sections"))
        )
        docs = docs.join(lists, "doc_id", "left")

    section_of = None if given else sections

    def of(text: str, listed: list[dict] | None) -> Sections:
        if section_of:
            return section_of(text)
        cut = [(x["n"], *(min(max(x[k], 0), len(text)) for k in "se")) for x in listed or []]
        return [c[0] for c in cut], [c[1] for c in cut], [max(c[1], c[2]) for c in cut]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in NAMES]
            listed = batch["sections"].to_pylist() if given else [None] * batch.num_rows
            for doc_id, raw, own in zip(batch["doc_id"].to_pylist(), as_bytes(batch["text"]), listed):
                ends = token_spans(raw, ranks, own_pattern)
                names, starts, stops = of(raw.decode(), own)
                if not names:
                    names, starts, stops = [None], [0], [0]
                bounds = _byte_offsets(raw, np.array(starts + stops, np.int64))
                count, crossing = attribute(ends, bounds[: len(names)], bounds[len(names) :], rule)
                n = len(names)
                rows = ([doc_id] * n, range(n), names, starts, stops, count.tolist(), crossing.tolist(), [len(ends)] * n)
                for column, values in zip(out, rows):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, KINDS)], names=NAMES)

    NAMES = ["doc_id", "section_no", "section", "start", "end", "tokens", "crossing_tokens", "doc_tokens"]
    KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
    types = {"section": "string", "tokens": "double"}
    return map_batches(docs, run, ", ".join(f"`{n}` {types.get(n, 'bigint')}" for n in NAMES))


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"))
