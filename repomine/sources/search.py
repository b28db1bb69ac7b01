"""Landed answers of a repository search service."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repomine.functions.responses import commit_count, has_next, int_or_default, json_text, succeeded
from repomine.functions.urls import repo_key
from repomine.operators.joins import salted_join
from repomine.operators.ordering import number_rows
from repomine.schemas import REPOS, SEARCH_PAGE


def _flatten(pages: DataFrame, keep: list[str]) -> DataFrame:
    items = pages.select(*keep, F.posexplode("items").alias("item_no", "item"))
    return items.select(
        repo_key(F.col("item.clone_url")).alias("repo_id"),
        "item.full_name",
        "item.clone_url",
        "item.description",
        "item.topics",
        int_or_default(F.col("item.stargazers_count")).alias("stars"),
        *keep,
        "item_no",
    )


def scan_search_pages(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Repositories out of response files, one page per file; a file holds at most one page of items.

    With ``lines`` a page is a line, and files of many lines are split over tasks.
    """
    return _flatten(spark.read.schema(SEARCH_PAGE).json(path, multiLine=not lines), [])


def scan_search_files(spark: SparkSession, path: str) -> DataFrame:
    """``search_id, page, status, link, body, file`` of landed pages, each a file of its own.

    The files lie in folders ``search_id=…/page=…`` and are read whole, many small ones by one task. A file
    that is not one whole JSON text (cut off, blank, anything else) has no status, so :func:`pages_until_end`
    takes it as a failed request that ends its search; :func:`broken_files` lists them. Spark passes over files
    of no bytes: give ``pages_until_end`` the first page number, so that the gap ends the search. The link is
    that of a page with a next one: a search goes on to its last file.
    """
    read = spark.read.schema("value string, search_id string, page int").text(path, wholetext=True)
    parsed = F.from_json("value", "items array<string>, broken string", {"columnNameOfCorruptRecord": "broken"})
    whole = F.rlike("value", F.lit(r"\S")) & parsed["broken"].isNull()
    return read.select(
        "search_id", "page", F.when(whole, 200).alias("status"), F.lit('rel="next"').alias("link"),
        F.col("value").alias("body"), F.col("_metadata.file_path").alias("file"),
    )


def broken_files(responses: DataFrame) -> DataFrame:
    """``search_id, page, file`` of the files that :func:`scan_search_files` could not read."""
    return responses.where(F.col("status").isNull()).select("search_id", "page", "file")


def search_pages(responses: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Repositories out of a table with one response ``body`` per row."""
    parsed = responses.withColumn("items", F.from_json("body", SEARCH_PAGE)["items"])
    return _flatten(parsed, keep or [])


def pages_until_end(responses: DataFrame, first: int | None = None) -> DataFrame:
    """Pages a search uses: up to the first that failed or is empty, or has no next page (that one included).

    Columns ``search_id, page, status, link, body``, one row per request. A page may have been asked for
    several times: it failed only if no attempt succeeded, and one successful attempt of it is kept. The
    pages of a search rise in the order they were asked. Where they are numbered without gaps, give the
    ``first`` number: a page that is not there then ends its search like one that failed.
    """
    # Looking for a first item costs less than reading the page, which is done for the pages kept only.
    usable = F.coalesce(succeeded(F.col("status")), F.lit(False)) & json_text(F.col("body"), "items[0]").isNotNull()
    attempts = responses.withColumn("_usable", usable)
    tries = attempts.select("search_id", "page", "_usable", (F.col("_usable") & has_next(F.col("link"))).alias("_more"))
    if first is not None:
        # Every page stands for the one after it, too, and a search for its first: failed, unless it is there.
        missing = F.explode(F.array(F.col("page") + 1, F.lit(first))).alias("page")
        tries = tries.unionAll(tries.select("search_id", missing, F.lit(False), F.lit(False)))
    pages = tries.groupBy("search_id", "page").agg(F.bool_or("_usable").alias("usable"), F.bool_or("_more").alias("more"))
    last = F.when(~F.col("usable"), F.col("page") - 1).when(~F.col("more"), F.col("page"))
    ends = pages.groupBy("search_id").agg(F.min(last).alias("_last"))
    # One search may have most of the pages, and bodies are long.
    joined = salted_join(attempts.where("_usable").drop("_usable"), ends, ["search_id"], F.col("page"))
    kept = joined.where(F.col("_last").isNull() | (F.col("page") <= F.col("_last"))).drop("_last")
    # Of several successful attempts the one with a next page, whatever their order in the table.
    best = F.max(F.struct(has_next(F.col("link")).alias("_more"), "status", "link", "body")).alias("_best")
    return kept.groupBy("search_id", "page").agg(best).select(
        "search_id", "page", "_best.status", "_best.link", "_best.body"
    )


def commit_count_from_responses(responses: DataFrame) -> DataFrame:
    """``full_name, commit_count``: one row per repository, 0 if no request succeeded or none can be read.

    A successful attempt counts before a failed one, and the greatest count of several. The full name,
    ``owner/name``, is the ``repo_id`` of the other tables.
    """
    good = F.coalesce(succeeded(F.col("status")), F.lit(False))
    count = F.when(good, commit_count(F.col("link"), F.col("body")))
    counts = responses.select("full_name", count.alias("count")).groupBy("full_name").agg(F.max("count").alias("count"))
    return counts.select("full_name", F.coalesce("count", F.lit(0)).cast("bigint").alias("commit_count"))


def repos_from_responses(responses: DataFrame, search_id: str | None = None) -> DataFrame:
    """Repositories of landed searches (or of one of them) in the order search, page, place on the page.

    Pages after the end of a search are left out. The positions are numbered in ranges, so neither the
    number of items on a page nor that of the searches is bounded.
    """
    if search_id is not None:
        responses = responses.where(F.col("search_id") == search_id)
    found = search_pages(pages_until_end(responses), ["search_id", "page"])
    numbered = number_rows(found, [F.col("search_id"), F.col("page"), F.col("item_no")], name="repo_ord")
    return numbered.select(*REPOS.names)
