"""Alignment of two tokenizers: which tokens overlap, and how well the corpus agrees on the pairs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repomine.llm.packing import _byte_letters
from repomine.llm.text import as_bytes, drop_shuffles, map_batches, read_table
from repomine.session import cut_lineage

# Pairs with their counts that are broadcast: the most frequent ones, so many at most.
BROADCAST_PAIRS = 1 << 20
# Bytes of text aligned at once.
BLOCK_BYTES = 1 << 20

MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def default_tokenizers() -> tuple[str, str, str]:
    """Vocabulary file of A, the pattern that cuts text for it, model file of B."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")


class Aligner:
    """Both tokenizers, and the bytes of their tokens.

    A's vocabulary gives its merges the next ids in turn, so ids are ranks, and the byte-pair library that
    works on ranks finds the same tokens as the file's own one. Special tokens are left out of the ranks and
    so are plain text.
    """

    def __init__(self, path_a: str, pattern_a: str, path_b: str):
        import sentencepiece
        import tiktoken

        with open(path_a, encoding="utf-8") as file:
            described = json.load(file)
        special = {t["id"] for t in described["added_tokens"]}
        byte_of = {letter: byte for byte, letter in _byte_letters().items()}
        ranks = {bytes(map(byte_of.__getitem__, token)): i for token, i in described["model"]["vocab"].items() if i not in special}
        self.a = tiktoken.Encoding("ranks", pat_str=pattern_a, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.bytes_b = [self._piece_bytes(i) for i in range(self.b.vocab_size())]
        self.sizes_a, self.sizes_b = (np.array(list(map(len, t)), np.int64) for t in (self.bytes_a, self.bytes_b))
        # How a token is written in the list of groups, before another of its group and as the last one.
        # All are filled up with zero bytes to one width, a power of two.
        spelled = [b"%d%c" % (i, c) for i in range(len(self.bytes_a)) for c in b",|"]
        spelled += [b"%d%c" % (i, c) for i in range(len(self.bytes_b)) for c in b",;"]
        self.spelled = np.array(spelled, f"S{1 << (max(map(len, spelled)) - 1).bit_length()}")

    def _piece_bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def tokens(self, text: bytes) -> tuple[list[int], list[int]]:
        """Ids of both; none if the text is empty or the bytes of either's tokens are not a space and the text."""
        if not text:
            return [], []
        string, whole = text.decode(), b" " + text
        a, b = self.a.encode_ordinary(" " + string), self.b.encode(string)
        if b"".join(map(self.bytes_a.__getitem__, a)) != whole or b"".join(map(self.bytes_b.__getitem__, b)) != whole:
            return [], []
        return a, b

    def align(self, texts: list[bytes]) -> dict[str, np.ndarray | list]:
        """The measures of several texts, and the linked pairs of each with the number of their occurrences.

        The tokens of all texts cover one sequence of bytes twice. Its pieces between neighbouring ends of
        either side are the links, one each, and the ends both sides have close the groups. The ends are marked
        in an array of those bytes, and tokens, links and groups are counted along the marks.
        """
        lists = [self.tokens(t) for t in texts]
        n_a, n_b = (np.array([len(x[side]) for x in lists], np.int64) for side in (0, 1))
        a, b = (
            np.fromiter(chain.from_iterable(x[side] for x in lists), np.int64, n.sum()) for side, n in enumerate((n_a, n_b))
        )
        # What ends at a byte: 1 a token of A, 2 one of B, 3 both. No set is sorted or searched.
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        marks = np.zeros(ends_a[-1] + 1 if len(a) else 1, np.uint8)
        marks[ends_a] = 1
        marks[ends_b] += 2
        cuts = np.flatnonzero(marks)
        marks = marks[cuts]
        # Tokens and groups that end up to each cut.
        until_a, until_b = np.cumsum(marks & 1, dtype=np.int64), np.cumsum(marks >> 1, dtype=np.int64)
        closing = np.flatnonzero(marks == 3)

        # Where the texts stop among the cuts; texts without tokens are empty stretches.
        stops_a, stops_b = np.cumsum(n_a), np.cumsum(n_b)
        link_stops = np.searchsorted(cuts, np.concatenate(([0], ends_a))[stops_a], "right")
        n_links = np.diff(link_stops, prepend=0)
        n_groups = np.diff(np.searchsorted(closing, link_stops), prepend=0)

        # Text, token of A and token of B of each link in one number, so that equal ones are sorted together.
        bits_a, bits_b = (len(t).bit_length() for t in (self.bytes_a, self.bytes_b))
        keys = np.repeat(np.arange(len(texts)) << (bits_a + bits_b), n_links)
        keys |= (a[until_a - (marks & 1)] << bits_b) | b[until_b - (marks >> 1)]
        keys.sort()
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        places = np.flatnonzero(new)
        times = np.diff(np.append(places, len(keys)))
        pair_stops = np.searchsorted(places, link_stops)
        keys = keys[places] & ((1 << (bits_a + bits_b)) - 1)
        pairs = ((keys >> bits_b) << 32) | (keys & ((1 << bits_b) - 1))

        # A token stands after those of its side and the tokens of the other side in the groups before.
        closed_a, closed_b = until_a[closing], until_b[closing]
        in_a, in_b = np.diff(closed_a, prepend=0), np.diff(closed_b, prepend=0)
        code_a, code_b = 2 * a, 2 * b + 2 * len(self.bytes_a)
        code_a[closed_a - 1] += 1
        code_b[closed_b - 1] += 1
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.repeat(closed_b - in_b, in_a)] = code_a
        codes[np.arange(len(b)) + np.repeat(closed_a, in_b)] = code_b
        digests = []
        for part in np.split(codes, (stops_a + stops_b)[:-1]):
            written = self.spelled[part].tobytes().translate(None, b"\0")
            digests.append(hashlib.sha256(written[:-1]).hexdigest() if written else "")
        return {
            "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links,
            "groups_sha256": digests, "pairs": pairs, "times": times, "pair_stops": pair_stops,
        }


@lru_cache(maxsize=2)
def aligner(path_a: str, pattern_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, pattern_a, path_b)


def _aligned(texts: DataFrame, files: tuple[str, str, str]) -> DataFrame:
    """``text_key, n_docs``, the measures of one text, and ``pairs`` of ``pair`` (both ids) and ``times``."""

    def block(columns: dict[str, list], texts: list[bytes]) -> pa.RecordBatch:
        found = aligner(*files).align(texts)
        pairs = pa.StructArray.from_arrays([pa.array(found["pairs"], pa.int64()), pa.array(found["times"], pa.int64())], ["pair", "times"])
        offsets = pa.array(np.concatenate(([0], found["pair_stops"])), pa.int32())
        numbers = [pa.array(found[n], pa.int64()) for n in NAMES[2:6]]
        arrays = [pa.array(columns["text_key"], pa.binary()), pa.array(columns["n_docs"], pa.int64()), *numbers,
                  pa.array(found["groups_sha256"], pa.string()), pa.ListArray.from_arrays(offsets, pairs)]
        return pa.RecordBatch.from_arrays(arrays, names=NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = as_bytes(batch["text"])
            first, size = 0, 0
            for i, text in enumerate(raw):
                size += len(text)
                if size >= BLOCK_BYTES or i == len(raw) - 1:
                    part = batch.slice(first, i + 1 - first)
                    yield block({n: part[n].to_pylist() for n in NAMES[:2]}, raw[first : i + 1])
                    first, size = i + 1, 0

    NAMES = ["text_key", "n_docs", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"]
    types = {"text_key": "binary", "groups_sha256": "string", "pairs": "array<struct<pair: bigint, times: bigint>>"}
    return map_batches(texts, run, ", ".join(f"{n} {types.get(n, 'bigint')}" for n in NAMES))


def _pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, count, best``: in how many documents it is linked, and whether that is the most of its A token."""
    counts = cut_lineage(aligned.select("n_docs", F.inline("pairs")).groupBy("pair").agg(F.sum("n_docs").alias("count")))
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("count").alias("most"))
    counts = counts.withColumn("a", F.shiftright("pair", 32)).join(most, "a")
    return counts.select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _frequent_from(counts: DataFrame, limit: int) -> int:
    """The least power of two so that at most ``limit`` pairs have that count or more; 0 if all pairs are so few."""
    classes = counts.groupBy(F.length(F.bin("count")).alias("bits")).agg(F.count("*").alias("n")).collect()  # 63 at most
    total, least = 0, 0
    for bits, n in sorted(map(tuple, classes), reverse=True):
        if total + n > limit:
            return least or 1 << bits
        total, least = total + n, 1 << (bits - 1)
    return 0


def _text_sums(aligned: DataFrame, counts: DataFrame, limit: int) -> DataFrame:
    """``text_key, count_sum, n_best``. Frequent pairs are looked up in a broadcast of at most ``limit`` rows.

    The others are joined by a shuffle; what is left there has small counts, so no key of it is hot.
    """
    links = aligned.select("text_key", F.inline("pairs"))
    least = _frequent_from(counts, limit)
    frequent = F.broadcast(counts.where(F.col("count") >= least))
    met = links.join(frequent, "pair")
    if least:
        others = counts.where(F.col("count") < least)
        met = met.unionByName(links.join(frequent.select("pair"), "pair", "left_anti").join(others, "pair"))
    return met.groupBy("text_key").agg(
        F.sum(F.col("times") * F.col("count")).alias("count_sum"),
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
    )


def align_tokenizers(
    docs: DataFrame, files: tuple[str, str, str] | None = None, broadcast_pairs: int = BROADCAST_PAIRS
) -> tuple[DataFrame, DataFrame]:
    """Two tables. One row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256``. And the pairs of the corpus: ``a, b, count, best``.

    Tokenizer A reads a space and the text, B the text, before which it sets a space itself. Both token lists
    cover the same bytes; tokens that overlap are linked, and places where tokens of both end close a group.
    The count of a pair of ids is the number of documents that hold it linked; ``best`` pairs have the
    highest count of their A id, ties included. ``n_best`` are the links whose pair is best, ``count_sum`` is
    the sum of the counts over the links, ``groups_sha256`` the digest of the groups written out.

    Documents are grouped by their whole text, copies combined before the shuffle. Every distinct text is
    tokenized once, its pairs weigh as often as it occurs, and its measures are joined to the ids by a
    256-bit digest of the text.

    A null or empty text, and one whose tokens do not spell a space and the text, has no tokens: zeros and an
    empty ``groups_sha256``. Rows without id and repeated rows are documents each. Other columns are not
    read. Empty tables give empty results.
    """
    files = files or default_tokenizers()
    spark = docs.sparkSession
    key = F.unhex(F.sha2("text", 256)).alias("text_key")
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    texts = docs.where("text != ''").groupBy("text").agg(F.count("*").alias("n_docs"))
    aligned = cut_lineage(_aligned(texts.select(key, "n_docs", "text"), files))
    drop_shuffles(spark)
    counts = cut_lineage(_pair_counts(aligned))
    # Both sides of the join by digest are plain tables, so that adaptive execution can split a text with many copies.
    sums = cut_lineage(_text_sums(aligned, counts, broadcast_pairs))
    measured = cut_lineage(aligned.drop("pairs", "n_docs").join(sums, "text_key", "left"))
    drop_shuffles(spark)
    found = docs.where("text != ''").select("doc_id", key).join(measured, "text_key", "left")
    columns = [F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in MEASURES]
    with_text = found.select("doc_id", *columns, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
    without = docs.where("text is null or text = ''").select(
        "doc_id", *[F.lit(0).cast("bigint").alias(n) for n in MEASURES], F.lit("").alias("groups_sha256"))
    pair = [F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")]
    return with_text.unionByName(without), counts.select(*pair, "count", "best")


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    return align_tokenizers(read_table(spark, sf_dir, "documents"))[0]
