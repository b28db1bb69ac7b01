"""Near duplicates by SimHash: covering masks find every pair within the radius."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repomine.llm.components import connected_components
from repomine.llm.text import as_bytes, map_batches, read_table, split_words
from repomine.session import cut_lineage

# Fixed values of the contract.
SHINGLE_WORDS = 3
MAX_BITS = 3
HASH_SEED = 42
BITS = 64

# Buckets up to this many different fingerprints are compared pair by pair inside a task; larger ones
# are linked through flipped bits, see `_links_by_flips`.
COMPARED_AT_ONCE = 2048

# Shingles whose bits are counted at once.
_BLOCK = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a text: a bit is 1 if set in over half the shingle hashes; no words give 0."""
    words = split_words(text.lower())  # on bytes, only A to Z change
    if not words:
        return 0
    size = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[i:j], HASH_SEED) for i, j in zip(first, last)), np.uint64, len(first))
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), _BLOCK):
        block = hashes[i : i + _BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``fp`` (bigint, the 64 bits), one row per row of ``docs``; null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t, shingle) for t in as_bytes(batch["text"])), np.uint64, batch.num_rows)
            columns = [batch[name] for name in keep] + [pa.array(values.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "fp"])

    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{name}` {types[name]}" for name in keep), "fp bigint"])
    return map_batches(docs.select(*keep, "text"), run, schema)


def covering_masks(radius: int = MAX_BITS, bits: int = BITS) -> list[int]:
    """2^(radius+1) - 1 masks such that any two words within the radius agree under at least one.

    Bit i has the vector i mod (2^(radius+1) - 1) + 1; mask v keeps the bits whose vector has an odd product
    with v. ``radius`` vectors of ``radius + 1`` dimensions leave a v that is orthogonal to them all, so mask
    v keeps none of the differing bits.
    """
    count = 2 ** (radius + 1) - 1
    return [
        sum(1 << i for i in range(bits) if ((i % count + 1) & v).bit_count() % 2 == 1) for v in range(1, count + 1)
    ]


def _as_long(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _spanning_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is within the radius in one bucket: a forest, not all pairs."""
    left, right = [], []
    waiting = np.ones(len(fps), bool)
    for start in range(len(fps)):
        if not waiting[start]:
            continue
        waiting[start] = False
        front = [start]
        while front:
            at = front.pop()
            rest = np.flatnonzero(waiting)
            near = rest[np.bitwise_count(fps[rest] ^ fps[at]) <= radius]
            waiting[near] = False
            left += [at] * len(near)
            right += near.tolist()
            front += near.tolist()
    return fps[left], fps[right]


def _links_in_buckets(buckets: DataFrame, radius: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["fps"]
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            found = [_spanning_links(fps, radius) for fps in np.split(flat, ends[:-1]) if len(fps) > 1]
            a = np.concatenate([x for x, _ in found] or [np.empty(0, np.uint64)])
            b = np.concatenate([y for _, y in found] or [np.empty(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return map_batches(buckets.select("fps"), run, "a bigint, b bigint")


def _links_by_flips(members: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """Links within buckets of any size, without pairs: two members meet at a word between them.

    Of a member, ``near`` are the words up to radius // 2 flips away and ``far`` those up to
    radius - radius // 2. Two members within the radius share a word that is near to one and far to the
    other. All who reach a word that is near to some member are tied to that one, each within the radius.
    Only bits outside the mask differ in a bucket, so only they are flipped.
    """
    spark = members.sparkSession
    near, far = radius // 2, radius - radius // 2
    rows = []
    for table, mask in enumerate(masks):
        free = [i for i in range(BITS) if not mask >> i & 1]
        for flips in range(far + 1):
            for chosen in itertools.combinations(free, flips):
                rows.append((table, _as_long(sum(1 << i for i in chosen)), flips <= near))
    flips = F.broadcast(spark.createDataFrame(rows, "table int, flip bigint, near boolean"))  # a few thousand rows
    reached = members.join(flips, "table").select(
        "table", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"), "near"
    )
    hubs = cut_lineage(
        reached.groupBy("table", "word")
        .agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("hub"), F.min("fp").alias("low"), F.max("fp").alias("high"))
        .where("hub is not null and low <> high")
    )
    return (
        reached.join(hubs.select("table", "word", "hub"), ["table", "word"])
        .select(F.col("fp").alias("a"), F.col("hub").alias("b"))
        .where("a <> b")
        .distinct()
    )


def near_links(distinct: DataFrame, radius: int = MAX_BITS, compared_at_once: int = COMPARED_AT_ONCE) -> DataFrame:
    """Links ``a, b`` of the different fingerprints ``fp`` such that their components are those of all pairs
    within ``radius`` bits."""
    masks = covering_masks(radius)
    keys = F.array(*[
        F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(F.lit(_as_long(m))).alias("key")) for t, m in enumerate(masks)
    ])
    rows = distinct.select("fp", F.inline(keys))
    # Sizes and hubs are written before they are joined back: an aggregate right above the join leaves Spark no
    # exchange to split where a bucket or word is hot.
    sizes = cut_lineage(rows.groupBy("table", "key").agg(F.count("*").alias("members")).where("members > 1"))
    shared = cut_lineage(rows.join(sizes, ["table", "key"]))
    small = (
        shared.where(F.col("members") <= compared_at_once)
        .groupBy("table", "key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    )
    links = _links_in_buckets(small, radius)
    large = shared.where(F.col("members") > compared_at_once)
    return links.union(_links_by_flips(large, masks, radius))


def near_duplicates(
    docs: DataFrame,
    shingle: int = SHINGLE_WORDS,
    radius: int = MAX_BITS,
    compared_at_once: int = COMPARED_AT_ONCE,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` and the columns ``keep`` for every row of ``docs`` (``doc_id, text``).

    Fingerprints link at ``radius`` or fewer differing bits; ``component_id`` is the smallest ``doc_id`` that
    can be reached. Equal fingerprints are one node, so copies make no links. Other columns of ``docs`` are
    not read. A null text counts as empty, an empty one has fingerprint zero; repeated rows come out as
    often as they came in; a row without id has the component of its fingerprint, null if nobody in it has
    an id. An empty table gives an empty result.
    """
    marked = cut_lineage(fingerprints(docs, shingle, ("doc_id", *keep)))
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    nodes = cut_lineage(nodes)
    roots = connected_components(near_links(nodes.select("fp"), radius, compared_at_once))
    grouped = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # A component may hold a third of all fingerprints: its smallest id is a partial minimum, then joined.
    # It is written, so that the join has an exchange of its own that adaptive execution can split.
    least = cut_lineage(grouped.groupBy("root").agg(F.min("first_id").alias("component_id")))
    component = cut_lineage(grouped.join(least, "root").select("fp", "component_id"))
    return marked.join(component, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *keep
    )


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
