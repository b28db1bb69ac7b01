"""From raw documents to packed sequences: five stages, each of which works on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repomine.llm.decontaminate import benchmark_matches
from repomine.llm.packing import pack_documents
from repomine.llm.quality import fit_quality, score_quality
from repomine.llm.simhash import near_duplicates
from repomine.llm.substring import remove_repeats
from repomine.llm.text import read_table
from repomine.session import cut_lineage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = fit_quality(docs, read_table(spark, sf_dir, "labels"))
    return score_quality(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id, whose id names the group.

    Of a group's rows with that id the one with the least text digest stays, once, and of rows that differ
    in other columns the least. A different text under an id that another group has too is in a group of its
    own, and stays. Rows without id stay: nothing tells which group they lead.
    """
    keyed = docs.select(*COLUMNS, F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_key"))
    groups = near_duplicates(keyed, keep=("text_key",)).where("doc_id is not null")
    first = groups.groupBy("component_id").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    # Written, as the join and the look for repeats read it.
    leaders = cut_lineage(first.select("first.*"))
    kept = keyed.join(leaders, ["doc_id", "text_key"], "left_semi")
    if _repeats(kept):
        whole = F.min(F.struct(*COLUMNS)).alias("row")
        kept = kept.groupBy("doc_id", "text_key").agg(whole).select("row.*")
    return kept.select(*COLUMNS).union(docs.where("doc_id is null").select(*COLUMNS))


def _repeats(kept: DataFrame) -> bool:
    """Whether a leading row occurs twice. Texts are then shuffled once more to leave one of each."""
    counts = kept.groupBy("doc_id", "text_key").agg(F.count("*").alias("n"))
    return not counts.where("n > 1").isEmpty()


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that an earlier document has go; a document of which nothing is left goes too."""
    cut = remove_repeats(docs.select(*COLUMNS))
    left = cut.where("n_removed = 0 or n_removed < n_words")
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", changed).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go, by their text: rows without id, or that share one, too."""
    text_no = F.xxhash64(F.coalesce("text", F.lit("")))
    named = docs.select(text_no.alias("doc_id"), "text")
    held = benchmark_matches(named, read_table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("text_no")).distinct()
    return docs.withColumn("text_no", text_no).join(held, "text_no", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences, with the checksum of their ids."""
    return pack_documents(docs, checksums=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", drop_low_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]

# The stages train a model, hash with XXH64 and run a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage keeps is written as Parquet to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
