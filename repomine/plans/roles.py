"""The driver's tables in the roles of the canonical ones. Every row of a table is used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The pages table has no address on the usual host, so its queries name this one.
PAGES_HOST_PATTERN = r"[a-z.-]+\.example\.(com|org)"


# Named here, so that reading a table does not start with a job that looks for its columns.
SCHEMAS = {
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "pages": "page_id bigint, url string, html string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as repositories; a negative balance leaves the description out."""
    return table(spark, sf_dir, "customer").selectExpr(
        "concat('org/r', c_custkey) AS repo_id",
        "c_name AS full_name",
        "concat('https://github.com/org/r', c_custkey, '.git') AS clone_url",
        "CASE WHEN c_acctbal >= 0 THEN concat('nation ', c_nationkey) END AS description",
        "array(c_mktsegment) AS topics",
        "CAST(floor(c_acctbal) AS INT) AS stars",
        "c_custkey AS repo_ord",
    )


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits of their customer; a pending order is a root."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('org/r', o_custkey) AS repo_id",
        "CAST(o_orderkey AS STRING) AS hash",
        "CASE WHEN o_orderstatus = 'P' THEN CAST(array() AS ARRAY<STRING>)"
        " ELSE array(CAST(o_orderkey - 1 AS STRING)) END AS parents",
        "o_orderstatus AS author",
        "CAST(o_orderdate AS TIMESTAMP) AS authored_at",
        "CAST(o_orderdate AS TIMESTAMP) AS committed_at",
        "o_orderpriority AS message",
    )


def file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as changed files; an order may name a part twice, so paths repeat."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "CAST(l_orderkey AS STRING) AS hash", "CAST(l_partkey AS STRING) AS path"
    )


def linear_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as one repository with one line of history; a pending order is a merge."""
    return table(spark, sf_dir, "orders").selectExpr(
        "'orders' AS repo_id",
        "CAST(o_orderkey AS STRING) AS hash",
        "CASE WHEN o_orderkey = 0 THEN CAST(array() AS ARRAY<STRING>)"
        " WHEN o_orderstatus = 'P' THEN array(CAST(o_orderkey - 1 AS STRING), CAST(o_orderkey - 2 AS STRING))"
        " ELSE array(CAST(o_orderkey - 1 AS STRING)) END AS parents",
        "o_orderstatus AS author",
        "CAST(o_orderdate AS TIMESTAMP) AS authored_at",
        "CAST(o_orderdate AS TIMESTAMP) AS committed_at",
        "o_orderpriority AS message",
    )


def tree_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as the tree of their order: the line number is the path, unique after grouping."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg({"l_returnflag": "max", "l_tax": "max"})
        .selectExpr(
            "'orders' AS repo_id",
            "CAST(l_orderkey AS STRING) AS hash",
            "concat('file', l_linenumber) AS path",
            "`max(l_returnflag)` AS mode",
            "CAST(CAST(round(`max(l_tax)` * 100) AS INT) AS STRING) AS blob_id",
        )
    )


# Repositories the orders are dealt to as commits of branches.
BRANCHED_REPOS = 25


def branched_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits of 25 repositories. One in eleven leaves out the commit before, a pending order is a merge."""
    return table(spark, sf_dir, "orders").selectExpr(
        f"CAST(o_orderkey % {BRANCHED_REPOS} AS STRING) AS repo_id",
        "CAST(o_orderkey AS STRING) AS hash",
        f"transform(filter(array(o_orderkey - {BRANCHED_REPOS} * IF(o_orderkey % 11 = 5, 2, 1),"
        f" IF(o_orderstatus = 'P', o_orderkey - {3 * BRANCHED_REPOS}, -1)), p -> p >= 0), p -> CAST(p AS STRING)) AS parents",
        "timestamp_seconds(o_orderkey) AS committed_at",
    )


# Commits of the repository of parts, and of how many directories one changes from a commit to the next.
SNAPSHOTS = 20
CHANGE_EVERY = 100
# Parts of which one task makes the entries.
PARTS_A_TASK = 50_000


def snapshot_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line of commits; commit 0 has no parent."""
    return spark.range(SNAPSHOTS).selectExpr(
        "'parts' AS repo_id", "CAST(id AS STRING) AS hash",
        "CASE WHEN id = 0 THEN CAST(array() AS ARRAY<STRING>) ELSE array(CAST(id - 1 AS STRING)) END AS parents",
    )


def snapshot_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as the files of a repository, ten to a directory, once for every commit.

    Of a hundred directories one has other contents than in the commit before, and two move away or back.
    """
    parts = table(spark, sf_dir, "part")
    # A small file makes many entries: dealt out first, or the tasks of its few splits would make them all.
    parts = parts.repartitionByRange(max(spark.sparkContext.defaultParallelism, parts.count() // PARTS_A_TASK + 1), "p_partkey")
    files = parts.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(SNAPSHOTS - 1))).alias("k")
    )
    return files.selectExpr(
        "'parts' AS repo_id", "CAST(k AS STRING) AS hash",
        f"concat(CASE WHEN (p_partkey DIV 10 + k) % {CHANGE_EVERY} = 7 THEN 'old/' ELSE '' END,"
        " p_partkey DIV 1000, '/', p_partkey DIV 10, '/', p_partkey) AS path",
        "CASE WHEN p_size > 25 THEN '100755' ELSE '100644' END AS mode",
        f"CAST((p_partkey DIV 10 + k) DIV {CHANGE_EVERY} AS STRING) AS blob_id",
    )


def text_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as commits with long messages, one a minute."""
    return table(spark, sf_dir, "documents").selectExpr(
        "source AS repo_id", "CAST(doc_id AS STRING) AS hash", "lang AS author",
        "timestamp_seconds(1704067200 + 60 * doc_id) AS authored_at", "text AS message",
    )


def landed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as changed files of their supplier's repository."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('org/s', l_suppkey) AS repo_id", "CAST(l_orderkey AS STRING) AS hash",
        "concat(l_partkey, '/', l_linenumber) AS path", "l_returnflag AS change_type",
    )


def talk_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as commits; the turn before is the parent."""
    return table(spark, sf_dir, "conversations").selectExpr(
        "CAST(conv_id AS STRING) AS repo_id",
        "CAST(turn AS STRING) AS hash",
        "CASE WHEN turn = 0 THEN CAST(array() AS ARRAY<STRING>) ELSE array(CAST(turn - 1 AS STRING)) END AS parents",
        "role AS author",
        "text AS message",
    )


def event_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as commits of their user."""
    return table(spark, sf_dir, "events").selectExpr(
        "CAST(user_id AS STRING) AS repo_id",
        "CAST(event_id AS STRING) AS hash",
        "event_type AS author",
        "CAST(ts AS TIMESTAMP) AS authored_at",
        "CAST(ts AS TIMESTAMP) AS committed_at",
        "event_type AS message",
    )


def list_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a repository list, one per customer, in all the forms such a line takes."""
    return table(spark, sf_dir, "customer").selectExpr(
        "CASE c_mktsegment"
        " WHEN 'BUILDING' THEN concat('  github.com/org/r', c_custkey, ' ')"
        " WHEN 'MACHINERY' THEN concat('# https://github.com/org/r', c_custkey)"
        " WHEN 'HOUSEHOLD' THEN concat('https://gitlab.com/org/r', c_custkey)"
        " WHEN 'FURNITURE' THEN concat('http://github.com/org/r', c_custkey, '.git')"
        " ELSE concat('https://github.com/org/r', c_custkey, '/') END AS value",
        "c_custkey AS repo_ord",
    )


def search_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as landed search pages, one search per nation.

    A page holds the customer and a second, incomplete repository. A negative balance is a failed request,
    a balance above 9000 a page without a next one. Pages of one segment were asked for twice, and the first
    attempt failed.
    """
    attempts = table(spark, sf_dir, "customer").selectExpr(
        "*", "CASE WHEN c_acctbal < 0 THEN 500 ELSE 200 END AS done",
        "c_mktsegment = 'BUILDING' AS retried",
    ).selectExpr("*", "explode(CASE WHEN retried THEN array(502, done) ELSE array(done) END) AS status")
    return attempts.selectExpr(
        "CAST(c_nationkey AS STRING) AS search_id",
        "CAST(c_custkey AS INT) AS page",
        "status",
        "CASE WHEN c_acctbal <= 9000 THEN concat('<https://x/s?page=', c_custkey + 1, '>; rel=\"next\"') END AS link",
        f"CASE WHEN status <> 502 THEN {_PAGE_BODY} END AS body",
    )


_PAGE_BODY = (
    "to_json(struct(array("
    "  struct(concat('https://github.com/org/r', c_custkey, '.git') AS clone_url, c_name AS full_name,"
    "    concat('nation ', c_nationkey) AS description, array(c_mktsegment, 'topic') AS topics,"
    "    CAST(floor(c_acctbal) AS STRING) AS stargazers_count),"
    "  struct(CAST(NULL AS STRING) AS clone_url, c_mktsegment AS full_name, CAST(NULL AS STRING) AS description,"
    "    CAST(NULL AS ARRAY<STRING>) AS topics, 'many' AS stargazers_count)"
    ") AS items))"
)


# Items of a search page, as the service gives them.
PAGE_ITEMS = 100


def page_bodies(spark: SparkSession, sf_dir: str, keys: int = PAGE_ITEMS) -> DataFrame:
    """``nation, page, value``: search pages as text, with the items of up to ``keys`` customer keys of a nation each.

    With 100, page 0 has the keys 0 to 99, page 1 those up to 199; a key has two items. A row grows with the customers
    of one key only, not with the table.
    """
    items = table(spark, sf_dir, "customer").selectExpr(
        "c_nationkey AS nation", f"CAST(floor(c_custkey / {keys}) AS BIGINT) AS page", f"{_PAGE_BODY} AS body"
    )
    inner = F.array_join(F.collect_list(F.expr("substring(body, 11, length(body) - 12)")), ",")
    return items.groupBy("nation", "page").agg(F.concat(F.lit('{"items":['), inner, F.lit("]}")).alias("value"))


# Customer keys of a page that is a file: about 100 of them are of one nation.
FILE_KEYS = 2_500


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``search_id, page, value``: such pages, one search per nation; five of the searches have a page that is cut off."""
    cut = F.expr("nation % 5 = 2 AND page = nation DIV 5 % 3")
    return page_bodies(spark, sf_dir, FILE_KEYS).select(
        F.col("nation").cast("string").alias("search_id"), F.col("page").cast("int").alias("page"),
        F.when(cut, F.expr("substring(value, 1, length(value) - 5)")).otherwise(F.col("value")).alias("value"),
    )


def count_responses(spark: SparkSession, sf_dir: str, name: str = "c_name") -> DataFrame:
    """Customers as landed commit-count responses: with a last-page link, with a body only, or failed.

    Those of one segment failed at first and were asked for again; the failed attempt has a link too.
    """
    attempts = table(spark, sf_dir, "customer").selectExpr(
        "*", "explode(CASE c_mktsegment WHEN 'MACHINERY' THEN array(404) WHEN 'AUTOMOBILE' THEN array(502, 200)"
        " ELSE array(200) END) AS status",
    )
    return attempts.selectExpr(
        f"{name} AS full_name",
        "status",
        "CASE WHEN c_mktsegment <> 'BUILDING' THEN concat('<https://x/c?per_page=1&page=2>; rel=\"next\", "
        "<https://x/c?per_page=1&page=', c_custkey, '>; rel=\"last\"') END AS link",
        "'[{}]' AS body",
    )
