"""Packing of documents into training sequences of several lengths."""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repomine.llm.text import as_bytes, map_batches, read_table, split_words

# Fixed values of the contract.
CONTEXT = 2048
END_ID = 1

# Context sizes a document is routed to; the last is the longest sequence. All are powers of two.
TIERS = (256, 512, 1024, 2048)
# Tokens a tier collects before it is packed, in sequences of the longest tier.
POOL_SEQUENCES = 16
# A step group holds this many tokens.
GROUP_TOKENS = 16 * CONTEXT

# What a worker remembers from task to task: bytes of the pieces between blanks, and words in lower case, so
# many of each at most. Beyond them it starts anew.
CACHED_BYTES, CACHED_WORDS = 1 << 23, 1 << 17

# A word that no normalizer changes but for its case, and marks after it.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:]*)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies name bytes: printable ones stand for themselves."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Token ids of texts, by the vocabulary file of a tokenizer that drops white space.

    No token spans white space, so a text's ids are those of its pieces between blanks. Pieces return often
    and are looked up; a new one goes to the tokenizer, or, if it is one plain word, to the tokenizer's model
    in lower case. The string of a special token in a text is that token, as the tokenizer has it by itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.words: dict[str, list[int]] = {}
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.known_bytes = 0
        self.starts = np.zeros(1 << 12, np.int64)
        self.lengths = np.zeros(1 << 12, np.int64)
        self.flat = np.zeros(1 << 14, np.uint32)
        self.used = 0

    def _word(self, word: str) -> list[int]:
        ids = self.words.get(word)
        if ids is None:
            # Letters of ASCII stand for themselves.
            mapped = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
            ids = self.words[word] = [t.id for t in self.model.tokenize(mapped)]
        return ids

    def _chunk(self, chunk: bytes) -> list[int]:
        text = chunk.decode()
        plain = _PLAIN.fullmatch(text)
        if plain:
            marks = plain[2]
            return self._word(plain[1].lower()) + (self._word(marks) if marks else [])
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, chunks: set[bytes]) -> None:
        fresh = [self._chunk(c) for c in chunks]
        size, at = len(self.known), self.used
        total = at + sum(map(len, fresh))
        if size + len(fresh) > len(self.starts):
            grow = 2 * (size + len(fresh))
            self.starts, self.lengths = np.resize(self.starts, grow), np.resize(self.lengths, grow)
        if total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * total)
        lengths = np.fromiter(map(len, fresh), np.int64, len(fresh))
        self.lengths[size : size + len(fresh)] = lengths
        self.starts[size : size + len(fresh)] = at + np.cumsum(lengths) - lengths
        self.flat[at:total] = np.fromiter((i for ids in fresh for i in ids), np.uint32, total - at)
        self.used = total
        self.known.update(zip(chunks, range(size, size + len(fresh))))
        self.known_bytes += sum(map(len, chunks))

    def encode(self, text: bytes) -> np.ndarray:
        chunks = split_words(text)
        if not chunks:
            return np.empty(0, np.uint32)
        if self.known_bytes > CACHED_BYTES:
            self.forget()
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        new = set(chunks).difference(self.known)
        if new:
            self._learn(new)
        index = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        lengths = self.lengths[index]
        ends = np.cumsum(lengths)
        places = np.repeat(self.starts[index] - (ends - lengths), lengths) + np.arange(ends[-1])
        return self.flat[places]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@dataclass
class Piece:
    """A run of one document's ids. ``row`` is what the output repeats of the document."""

    row: tuple
    start: int
    ids: np.ndarray

    def cut(self, size: int) -> tuple[Piece, Piece]:
        return Piece(self.row, self.start, self.ids[:size]), Piece(self.row, self.start + size, self.ids[size:])


@dataclass
class Sequence:
    size: int
    pieces: list[Piece] = field(default_factory=list)
    used: int = 0

    def add(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.used += len(piece.ids)


class _Pool:
    """Pieces of one tier by length."""

    def __init__(self) -> None:
        self.by_length: list[tuple[int, int]] = []
        self.pieces: dict[int, Piece] = {}
        self.tokens = 0
        self.count = 0

    def add(self, piece: Piece) -> None:
        bisect.insort(self.by_length, (len(piece.ids), self.count))
        self.pieces[self.count] = piece
        self.tokens += len(piece.ids)
        self.count += 1

    def take(self, most: int) -> Piece | None:
        """The longest piece of at most ``most`` ids."""
        at = bisect.bisect_right(self.by_length, (most, self.count))
        return self._pop(at - 1) if at else None

    def shortest(self) -> Piece | None:
        return self._pop(0) if self.by_length else None

    def _pop(self, at: int) -> Piece:
        length, key = self.by_length.pop(at)
        self.tokens -= length
        return self.pieces.pop(key)


class Packer:
    """Packs the documents of one task. What it holds is bounded by the pools, not by the input."""

    def __init__(self, tiers: tuple[int, ...], pool_sequences: int):
        self.tiers = sorted(tiers)
        self.longest = self.tiers[-1]
        self.pools = {t: _Pool() for t in self.tiers}
        self.limit = pool_sequences * self.longest

    def add(self, row: tuple, ids: np.ndarray) -> Iterator[Sequence]:
        """Full runs of a long document are sequences; the rest goes to the smallest tier that holds it."""
        whole = Piece(row, 0, ids)
        while len(whole.ids) >= self.longest:
            full, whole = whole.cut(self.longest)
            yield self._full(self.longest, [full])
        if len(whole.ids):
            tier = next(t for t in self.tiers if t >= len(whole.ids))
            self.pools[tier].add(whole)
            if self.pools[tier].tokens >= self.limit:
                yield from self._pack(tier)

    @staticmethod
    def _full(size: int, pieces: list[Piece]) -> Sequence:
        sequence = Sequence(size)
        for piece in pieces:
            sequence.add(piece)
        return sequence

    def _shorter(self, tier: int) -> list[int]:
        return [t for t in reversed(self.tiers) if t <= tier]

    def _fill(self, sequence: Sequence, tier: int) -> None:
        """Close the gap: the longest pieces that fit, from the own tier and then shorter ones, then a cut."""
        while gap := sequence.size - sequence.used:
            fitting = (self.pools[t].take(gap) for t in self._shorter(tier))
            piece = next((p for p in fitting if p), None)
            if piece is None:
                # All that is left is longer than the gap. The shortest is cut; its rest is routed anew.
                longer = (self.pools[t].shortest() for t in self.tiers)
                piece = next((p for p in longer if p), None)
                if piece is None:
                    return
                piece, rest = piece.cut(gap)
                self.pools[next(t for t in self.tiers if t >= len(rest.ids))].add(rest)
            sequence.add(piece)

    def _pack(self, tier: int) -> Iterator[Sequence]:
        pool = self.pools[tier]
        while pool.tokens >= max(self.limit // 2, tier):
            sequence = Sequence(tier)
            sequence.add(pool.take(tier))
            self._fill(sequence, tier)
            yield sequence

    def finish(self) -> Iterator[Sequence]:
        """What is left, the long tiers first; the last ids go to ever shorter powers of two, so none is padded."""
        left = sum(p.tokens for p in self.pools.values())
        size = self.longest
        while left:
            while size > left:
                size //= 2
            sequence = Sequence(size)
            self._fill(sequence, self.longest)
            left -= size
            yield sequence


class _Groups:
    """Step groups of equal tokens: of a buffer of sequences the longest goes to the group with the fewest."""

    def __init__(self, first: int, tokens: int, groups: int = 4):
        self.next, self.tokens, self.groups = first, tokens, groups
        self.waiting: list[Sequence] = []
        self.held = 0

    def add(self, sequence: Sequence) -> Iterator[tuple[int, Sequence]]:
        self.waiting.append(sequence)
        self.held += sequence.size
        if self.held >= self.tokens * self.groups:
            yield from self.finish()

    def finish(self) -> Iterator[tuple[int, Sequence]]:
        count = max(1, round(self.held / self.tokens))
        loads = [0] * count
        for sequence in sorted(self.waiting, key=lambda s: -s.size):
            at = loads.index(min(loads))
            loads[at] += sequence.size
            yield self.next + at, sequence
        self.next += count if self.waiting else 0
        self.waiting, self.held = [], 0


def pack_documents(
    docs: DataFrame,
    tokenizer: str | None = None,
    tiers: tuple[int, ...] = TIERS,
    end_id: int = END_ID,
    pool_sequences: int = POOL_SEQUENCES,
    group_tokens: int = GROUP_TOKENS,
    checksums: bool = False,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, token_ids, doc_tokens, sequence_id, offset, sequence_length,
    step_group``.

    A document is its ids and ``end_id``. Runs of the longest context are sequences of their own; the rest is
    routed to the smallest tier that holds it. Each tier is packed by the longest piece that fits; gaps are
    filled from shorter tiers and closed by a cut, so every sequence is exactly full. The last ids of a task
    go to sequences of shorter powers of two. ``sequence_length`` is the context (padded length) of a
    sequence, ``step_group`` a set of sequences of about ``group_tokens`` tokens. ``token_ids`` are
    little-endian unsigned 32-bit; with ``checksums`` the column is ``ids_crc32``, their unsigned CRC-32.

    Every task packs the documents of its partition, holding a few pools, and numbers sequences and groups
    from its partition number on, so a repeated task gives the same rows and nothing is shuffled.

    A null text counts as empty: its document is ``end_id`` alone. Repeated rows and rows without id are
    packed like any other. Other columns are not read. An empty table gives an empty result.
    """
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        first = TaskContext.get().partitionId() << 33
        packer, groups, number = Packer(tiers, pool_sequences), _Groups(first, group_tokens), first
        out: list[tuple] = []

        def rows(grouped: Iterator[tuple[int, Sequence]]) -> None:
            nonlocal number
            for group, sequence in grouped:
                offset = 0
                for p in sequence.pieces:
                    n = len(p.ids)
                    ids = zlib.crc32(p.ids.astype("<u4")) if checksums else p.ids.astype("<u4").tobytes()
                    out.append((p.row[0], p.start, n, ids, p.row[1], number, offset, sequence.size, group))
                    offset += n
                number += 1

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 9
            out.clear()
            kinds = [pa.int64()] * 3 + [pa.int64() if checksums else pa.binary()] + [pa.int64()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=NAMES)

        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            for doc_id, text in zip(ids, as_bytes(batch["text"])):
                tokens = np.append(encode(text), np.uint32(end_id))
                for sequence in packer.add((doc_id, len(tokens)), tokens):
                    rows(groups.add(sequence))
            yield batch_of()
        for sequence in packer.finish():
            rows(groups.add(sequence))
        rows(groups.finish())
        yield batch_of()

    NAMES = ["doc_id", "start", "length", "ids_crc32" if checksums else "token_ids", "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group"]
    schema = ", ".join(f"{n} {'binary' if n == 'token_ids' else 'bigint'}" for n in NAMES)
    return map_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), run, schema)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), checksums=True)
