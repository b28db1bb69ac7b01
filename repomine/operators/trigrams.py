"""Search of repositories by domain terms through an inverted table of character trigrams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repomine.operators.joins import small_side_join
from repomine.operators.repos import DOMAIN_COLUMNS, match_domains
from repomine.session import cut_lineage

GRAM = 3
# Repositories of which one task makes the trigrams: a row has tens of them, so a small file makes a large table.
ROWS_A_TASK = 20_000


def term_grams(term: str) -> list[str]:
    """The different trigrams of a lower-cased term; none if it is shorter."""
    low = term.lower()
    return sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})


def trigram_index(repos: DataFrame, columns: Sequence[str] = DOMAIN_COLUMNS, key: str = "repo_id") -> DataFrame:
    """``gram`` and the key of every repository that holds it in one of the columns, each pair once.

    The lower-cased columns of a row are cut in one pass, parted by NUL. Rows without a key are left out. Of a
    repository that is listed several times, the trigrams of all its rows are kept. The rows are counted and
    dealt out first, so that no task holds the pairs of a whole split.
    """
    kinds = dict(repos.dtypes)
    fields = [F.array_join(c, "\0") if kinds[c].startswith("array") else F.col(c) for c in columns]
    low = F.lower(F.concat_ws("\0", *fields))
    grams = F.array_distinct(F.regexp_extract_all(F.col("_low"), F.lit(f"(?s)(?=(.{{{GRAM}}}))"), 1))
    rows = repos.where(F.col(key).isNotNull()).select(low.alias("_low"), key)
    tasks = max(repos.sparkSession.sparkContext.defaultParallelism, rows.count() // ROWS_A_TASK + 1)
    held = rows.repartition(tasks).select(F.explode(grams).alias("gram"), key)
    return held.dropDuplicates(["gram", key])


def write_index(index: DataFrame, path: str, key: str = "repo_id") -> None:
    """Write the index in ranges of trigram and key, so that a search reads only the ranges of its trigrams.

    Ranges go by the key too: a trigram that nearly all repositories hold lies in several files.
    """
    index.repartitionByRange("gram", key).sortWithinPartitions("gram", key).write.parquet(path)


def indexed_repos(index: DataFrame, terms: Sequence[str], key: str = "repo_id") -> DataFrame:
    """Keys of the repositories that hold all trigrams of any of the terms, each key once.

    Every repository with a term is among them; others may be, whose trigrams are there but not in a row. The
    terms must have trigrams. They are the only side that is broadcast, and they are part of the query.
    """
    spark = index.sparkSession
    wanted = [(number, gram) for number, term in enumerate(terms) for gram in term_grams(term)]
    sizes = [(number, len(term_grams(term))) for number, term in enumerate(terms)]
    rows = F.broadcast(spark.createDataFrame(wanted, "term int, gram string"))
    needed = F.broadcast(spark.createDataFrame(sizes, "term int, needed long"))
    # The list of trigrams reaches the scan, which skips the ranges without them.
    postings = index.where(F.col("gram").isin(sorted({gram for _, gram in wanted})))
    held = postings.join(rows, "gram").groupBy("term", key).agg(F.count("*").alias("held"))
    return held.join(needed, "term").where("held = needed").select(key).distinct()


def match_domains_indexed(
    repos: DataFrame, index: DataFrame, domains: Sequence[str], columns: Sequence[str] = DOMAIN_COLUMNS, key: str = "repo_id"
) -> DataFrame:
    """The rows of :func:`match_domains`, looked up in the trigram index of ``repos``.

    What the index finds is compared with the terms themselves. A term of one or two characters has no
    trigram; a search with one goes through all rows, as does one that a blank term lets pass. Rows without a
    key are not in the index and are always compared.
    """
    terms = sorted({term.lower() for term in domains})
    if not terms or any(len(term) < GRAM for term in terms):
        return match_domains(repos, domains, columns)
    found = cut_lineage(indexed_repos(index, terms, key)).withColumn("_indexed", F.lit(True))
    spread = F.col("repo_ord") if "repo_ord" in repos.columns else F.xxhash64(*columns)
    marked = small_side_join(repos, found, [key], spread, "left")
    kept = marked.where(F.col("_indexed") | F.col(key).isNull()).select(*repos.columns)
    return match_domains(kept, domains, columns)
