"""Queries over the driver's tables, one or more per operator, and the same in plain SQL.

Each query reads its tables whole. The SQL is written on its own, against the raw tables, so that it also
checks the roles.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repomine.functions import responses, text, urls
from repomine.functions.dates import java_date_text, stamp_text
from repomine.operators import diffs, health, history, keywords, ordering, reachability, renames, report, trigrams
from repomine.operators import repos as repo_ops
from repomine.operators.joins import fits_broadcast
from repomine.plans import mining, roles, upkeep
from repomine.session import configure, cut_lineage, scratch_path
from repomine.sources import tables
from repomine.sources.lists import scan_repo_list as read_repo_list
from repomine.sources.ordered import read_in_order, write_in_order
from repomine.sources.reports import read_report, write_report
from repomine.sources.search import (
    commit_count_from_responses, pages_until_end, repos_from_responses, search_pages,
)
from repomine.sources.search import scan_search_files as read_search_files
from repomine.sources.search import scan_search_pages as read_search_pages
from repomine.streaming.refresh import landed_stream, large_commits, matching_stream, mined_stream, run_to_end

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, key: str = "") -> Callable[[Query], Query]:
    """Register a query under its function's name (or ``key``), with its SQL."""

    def register(build: Query) -> Query:
        name = key or build.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(configure(spark), sf_dir.rstrip("/"))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


FLAGSHIP = mining.MiningQuery(
    domains=["build", "auto"], keywords=["urgent", "high"],
    commit_filter="greater", commit_threshold=8, min_stars=1000, max_modified_files=4,
)
PRIORITIES = ["urgent", "high"]
WORDS = ["ring", "mit license", "ção", "é la"]

# SQL pieces shared by the statements below.
_DATE = "strftime({}, '%a %b %d %H:%M:%S UTC %Y')"
_ORDER_DATE = _DATE.format("o_orderdate")
_CUT = "CASE WHEN length({0}) > 2000 THEN left({0}, 1997) || '...' ELSE {0} END"
_ANY_PRIORITY = "(lower(o_orderpriority) LIKE '%urgent%' OR lower(o_orderpriority) LIKE '%high%')"
_ANY_WORD = "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in WORDS) + ")"
_FILES = "files AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_orderkey)"
_DOMAIN = """(lower(c_mktsegment) LIKE '%build%' OR lower(c_mktsegment) LIKE '%auto%'
    OR lower(c_name) LIKE '%build%' OR lower(c_name) LIKE '%auto%')"""
_CHOSEN = f"""chosen AS (
    SELECT c_custkey FROM customer JOIN orders ON o_custkey = c_custkey
    WHERE {_DOMAIN} AND floor(c_acctbal) >= 1000
    GROUP BY c_custkey HAVING count(*) > 8)"""
_COMMIT_URL = "'https://github.com/org/r' || o_custkey || '/commit/' || o_orderkey"
_REPORT_COLUMNS = f"""{_COMMIT_URL} AS commit_url, CAST(o_orderkey AS VARCHAR) AS commit_hash,
    o_orderstatus AS author, {_ORDER_DATE} AS date, o_orderpriority AS message"""
_MINED = f"""FROM orders JOIN chosen ON o_custkey = c_custkey LEFT JOIN files ON l_orderkey = o_orderkey
    WHERE {_ANY_PRIORITY} AND (o_orderstatus = 'P' OR coalesce(n, 0) <= 4)"""
_PAGE_ITEMS = """SELECT 'org/r' || c_custkey AS repo_id, c_name AS full_name,
    'https://github.com/org/r' || c_custkey || '.git' AS clone_url, 'nation ' || c_nationkey AS description,
    c_mktsegment || '|topic' AS topics, CAST(floor(c_acctbal) AS INTEGER) AS stars FROM customer
    UNION ALL SELECT '', c_mktsegment, '', '', '', 0 FROM customer"""
_ENDS = """ends AS (SELECT c_nationkey AS nation, min(CASE WHEN c_acctbal < 0 THEN c_custkey - 1
        WHEN c_acctbal > 9000 THEN c_custkey END) AS last FROM customer GROUP BY c_nationkey)"""
_LISTED = "listed AS (SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('MACHINERY', 'HOUSEHOLD'))"
_TREES = """trees AS (
    SELECT l_orderkey AS h, 'file' || l_linenumber AS path, max(l_returnflag) AS mode,
           CAST(round(max(l_tax) * 100) AS INTEGER) AS blob
    FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
_TREE_DIFF = f"""{_TREES},
    new AS (SELECT h, path, mode, blob FROM trees WHERE h > 0),
    old AS (SELECT o_orderkey AS h, path, mode, blob FROM trees JOIN orders ON h = o_orderkey - 1),
    diff AS (
        SELECT coalesce(new.h, old.h) AS h, coalesce(new.path, old.path) AS path,
               CASE WHEN old.h IS NULL THEN 'ADD' WHEN new.h IS NULL THEN 'DELETE' ELSE 'MODIFY' END AS change_type
        FROM new FULL JOIN old ON new.h = old.h AND new.path = old.path
        WHERE old.h IS NULL OR new.h IS NULL OR new.mode <> old.mode OR new.blob <> old.blob)"""


def _mining_tables(spark: SparkSession, sf_dir: str) -> mining.MiningTables:
    return mining.MiningTables(
        commits=roles.commits(spark, sf_dir), repos=roles.repos(spark, sf_dir),
        file_changes=roles.file_changes(spark, sf_dir), unique_paths=False,
    )


def _listed_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo_ops.repos_from_lines(roles.list_lines(spark, sf_dir))


def _commits_with_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = diffs.files_changed(roles.file_changes(spark, sf_dir), unique=False)
    return diffs.with_files_changed(history.parent_columns(roles.commits(spark, sf_dir)), counts)


# ---- whole queries


@query(f"WITH {_FILES}, {_CHOSEN} SELECT {_REPORT_COLUMNS} {_MINED}")
def mine_search(spark, sf_dir):
    return mining.mine(FLAGSHIP, _mining_tables(spark, sf_dir))


@query(f"WITH {_FILES}, {_CHOSEN} SELECT {_REPORT_COLUMNS} {_MINED}")
def mine_search_staged(spark, sf_dir):
    return mining.mine(FLAGSHIP, _mining_tables(spark, sf_dir), staged=True)


@query(f"WITH {_FILES}, {_CHOSEN} SELECT {_REPORT_COLUMNS} {_MINED}")
def mine_search_sieved(spark, sf_dir):
    """The search as it runs where neither the repositories nor the hits fit a broadcast."""
    kept = mining.mined_commits(FLAGSHIP, _mining_tables(spark, sf_dir), staged=True, small=False, prune=False)
    return report.to_report(kept)


@query(
    f"""WITH {_FILES}, {_ENDS}, chosen AS (
        SELECT c_custkey FROM customer JOIN ends ON c_nationkey = nation
        WHERE (last IS NULL OR c_custkey <= last) AND floor(c_acctbal) >= 1000
        AND CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 ELSE c_custkey END > 8)
    SELECT {_REPORT_COLUMNS} {_MINED}"""
)
def mine_search_landed(spark, sf_dir):
    """The search form over landed answers: of the searches, and of the requests for commit counts."""
    counts = commit_count_from_responses(roles.count_responses(spark, sf_dir, "concat('org/r', c_custkey)"))
    found = mining.MiningTables(
        commits=roles.commits(spark, sf_dir), repos=repos_from_responses(roles.search_responses(spark, sf_dir)),
        file_changes=roles.file_changes(spark, sf_dir), unique_paths=False, answered=True,
        commit_counts=counts.withColumnRenamed("full_name", "repo_id"),
    )
    return mining.mine(FLAGSHIP, found)


@query(
    f"""WITH {_FILES}, {_LISTED} SELECT
    CASE WHEN c_mktsegment = 'FURNITURE' THEN 'http' ELSE 'https' END
        || '://github.com/org/r' || o_custkey || '/commit/' || o_orderkey AS commit_url,
    CAST(o_orderkey AS VARCHAR) AS commit_hash, o_orderstatus AS author, {_ORDER_DATE} AS date,
    o_orderpriority AS message
    FROM orders JOIN listed ON o_custkey = listed.c_custkey JOIN customer USING (c_custkey)
    LEFT JOIN files ON l_orderkey = o_orderkey
    WHERE lower(o_orderpriority) LIKE '%low%' AND (o_orderstatus = 'P' OR coalesce(n, 0) <= 3)"""
)
def mine_list(spark, sf_dir):
    return mining.mine_from_list(_listed_repos(spark, sf_dir), ["LOW"], 3, _mining_tables(spark, sf_dir))


@query(
    f"""WITH {_TREE_DIFF}, sizes AS (SELECT h, count(*) AS n FROM diff GROUP BY h)
    SELECT 'https://github.com/org/orders/commit/' || o_orderkey AS commit_url,
        CAST(o_orderkey AS VARCHAR) AS commit_hash, o_orderstatus AS author, {_ORDER_DATE} AS date,
        o_orderpriority AS message
    FROM orders LEFT JOIN sizes ON h = o_orderkey
    WHERE {_ANY_PRIORITY} AND (o_orderkey = 0 OR coalesce(n, 0) <= 4)"""
)
def mine_trees(spark, sf_dir):
    """The list form with the files compared here, over one repository that holds every commit."""
    commits = roles.linear_commits(spark, sf_dir)
    repos = commits.groupBy("repo_id").agg(
        F.lit("https://github.com/org/orders.git").alias("clone_url"), F.lit(0).cast("bigint").alias("repo_ord")
    )
    found = mining.MiningTables(commits=commits, tree_entries=roles.tree_entries(spark, sf_dir))
    return mining.mine_from_list(repos, PRIORITIES, 4, found)


# ---- sources and sinks


@query(
    """SELECT rtrim(url, '/') || CASE WHEN ends_with(rtrim(url, '/'), '.git') THEN '' ELSE '.git' END AS clone_url
    FROM pages WHERE regexp_full_match(url, '(https?://)?[a-z.-]+\\.example\\.(com|org)/.+/.+(\\.git)?')"""
)
def repo_list(spark, sf_dir):
    lines = roles.table(spark, sf_dir, "pages").withColumnRenamed("url", "value")
    return repo_ops.repos_from_lines(lines, host_pattern=roles.PAGES_HOST_PATTERN).select("clone_url")


@query(
    f"""{_PAGE_ITEMS}""",
    key="search_pages",
)
def flattened_pages(spark, sf_dir):
    return _plain_repos(search_pages(roles.search_responses(spark, sf_dir)))


def _plain_repos(repos: DataFrame) -> DataFrame:
    text_columns = [F.coalesce(c, F.lit("")).alias(c) for c in ("repo_id", "full_name", "clone_url", "description")]
    topics = F.array_join(F.coalesce("topics", F.array().cast("array<string>")), "|").alias("topics")
    return repos.select(*text_columns, topics, "stars")


@query(_PAGE_ITEMS)
def scan_search_pages(spark, sf_dir):
    """Pages written as one line each and read back."""
    path = scratch_path(spark, "pages")
    roles.page_bodies(spark, sf_dir).select("value").write.text(path)
    return _plain_repos(read_search_pages(spark, path, lines=True))


@query(
    f"""WITH cut AS (SELECT DISTINCT c_nationkey AS nation, c_custkey // {roles.FILE_KEYS} AS page FROM customer
        WHERE c_nationkey % 5 = 2 AND c_custkey // {roles.FILE_KEYS} = c_nationkey // 5 % 3),
    customer AS (SELECT c.* FROM customer c LEFT JOIN cut ON c_nationkey = nation
        WHERE page IS NULL OR c_custkey // {roles.FILE_KEYS} < page)
    {_PAGE_ITEMS}"""
)
def scan_search_files(spark, sf_dir):
    """Pages written as a file each, some of them cut off, and read back up to the end of each search."""
    path = scratch_path(spark, "files")
    roles.page_files(spark, sf_dir).write.partitionBy("search_id", "page").text(path)
    return _plain_repos(search_pages(pages_until_end(read_search_files(spark, path))))


@query(
    """SELECT CASE WHEN c_mktsegment = 'FURNITURE' THEN 'http' ELSE 'https' END
        || '://github.com/org/r' || c_custkey || '.git' AS clone_url, 'org/r' || c_custkey AS repo_id
    FROM customer WHERE c_mktsegment NOT IN ('MACHINERY', 'HOUSEHOLD')"""
)
def scan_repo_list(spark, sf_dir):
    """A list written as text and read back."""
    path = scratch_path(spark, "list")
    roles.list_lines(spark, sf_dir).select("value").write.text(path)
    return read_repo_list(spark, path).select("clone_url", "repo_id")


def _landed(spark, df, scan):
    path = scratch_path(spark, "landed")
    tables.land(df, path)
    return scan(spark, path)


@query(
    f"""SELECT 'org/r' || o_custkey AS repo_id, CAST(o_orderkey AS VARCHAR) AS hash,
    CASE WHEN o_orderstatus = 'P' THEN '' ELSE CAST(o_orderkey - 1 AS VARCHAR) END AS parents,
    o_orderstatus AS author, {_ORDER_DATE} AS authored_at, {_ORDER_DATE} AS committed_at,
    o_orderpriority AS message FROM orders"""
)
def scan_commits(spark, sf_dir):
    rows = _landed(spark, roles.commits(spark, sf_dir), tables.scan_commits)
    times = [java_date_text(F.col(c)).alias(c) for c in ("authored_at", "committed_at")]
    return rows.select("repo_id", "hash", F.array_join("parents", "|").alias("parents"), "author", *times, "message")


@query(f"WITH {_TREES} SELECT 'orders' AS repo_id, CAST(h AS VARCHAR) AS hash, path, mode, CAST(blob AS VARCHAR) AS blob_id FROM trees")
def scan_tree_entries(spark, sf_dir):
    rows = _landed(spark, roles.tree_entries(spark, sf_dir), tables.scan_tree_entries)
    return rows.select("repo_id", "hash", "path", "mode", "blob_id")


@query(
    """SELECT 'org/s' || l_suppkey AS repo_id, CAST(l_orderkey AS VARCHAR) AS hash,
    l_partkey || '/' || l_linenumber AS path, l_returnflag AS change_type FROM lineitem"""
)
def scan_file_changes(spark, sf_dir):
    rows = _landed(spark, roles.landed_changes(spark, sf_dir), tables.scan_file_changes)
    return rows.select("repo_id", "hash", "path", "change_type")


@query(
    f"""WITH {_ENDS}
    SELECT c_name AS full_name FROM customer JOIN ends ON c_nationkey = nation
    WHERE last IS NULL OR c_custkey <= last"""
)
def search_end(spark, sf_dir):
    """Complete repositories on the pages that the searches use."""
    pages = pages_until_end(roles.search_responses(spark, sf_dir))
    return repo_ops.complete_repos(search_pages(pages)).select("full_name")


@query(
    """SELECT c_name AS full_name, CAST(CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1
    ELSE c_custkey END AS BIGINT) AS commit_count FROM customer"""
)
def link_commit_count(spark, sf_dir):
    return commit_count_from_responses(roles.count_responses(spark, sf_dir))


@query(
    f"""SELECT 'https://github.com/' || source || '/commit/' || doc_id AS commit_url,
    CAST(doc_id AS VARCHAR) AS commit_hash, lang AS author,
    {_DATE.format("TIMESTAMP '2024-01-01' + to_minutes(doc_id)")} AS date, {_CUT.format('text')} AS message
    FROM documents"""
)
def report_rows(spark, sf_dir):
    """Rows of a report written as CSV and read back, with line ends and quotes in the messages."""
    url = F.concat(F.lit("https://github.com/"), "repo_id", F.lit(".git"))
    commits = roles.text_commits(spark, sf_dir).withColumn("clone_url", url)
    path = write_report(report.to_report(commits), scratch_path(spark, "reports"))
    return read_report(spark, path)


@query(
    f"""WITH {_FILES}, {_CHOSEN} SELECT {_REPORT_COLUMNS},
    'https://github.com/org/r' || o_custkey || '.git' AS repository, CAST(coalesce(n, 0) AS VARCHAR) AS files_changed {_MINED}"""
)
def report_rows_files(spark, sf_dir):
    """The report with repository and changed files, as a run writes it."""
    return read_report(spark, _run(spark, sf_dir)[0])


# The flagship for all repositories of no less than 0 stars.
EVERYONE = dataclasses.replace(FLAGSHIP, domains=[""], commit_filter="", commit_threshold=0, min_stars=0)


@query(
    f"""WITH {_FILES}, chosen AS (SELECT c_custkey FROM customer WHERE floor(c_acctbal) >= 0)
    SELECT row_number() OVER (ORDER BY o_custkey, o_orderdate DESC, CAST(o_orderkey AS VARCHAR)) AS row_number,
    {_COMMIT_URL} AS commit_url, CAST(o_orderkey AS VARCHAR) AS commit_hash {_MINED}"""
)
def report_order(spark, sf_dir):
    """A report written in its order, and the places of its rows restored from the files."""
    path = scratch_path(spark, "ordered")
    kept = mining.mined_commits(EVERYONE, _mining_tables(spark, sf_dir))
    write_in_order(report.to_report(kept, keep=["repo_ord", "committed_at", "hash"]), report.REPORT_ORDER, path)
    return read_in_order(spark, path).select("row_number", "commit_url", "commit_hash")


def _run(spark, sf_dir) -> tuple[str, str]:
    """One run of the search form: the folder of its report, and that of the table of searches."""
    base, past = scratch_path(spark, "reports"), scratch_path(spark, "history")
    done = mining.run_search(FLAGSHIP, _mining_tables(spark, sf_dir), base, with_files=True, history=past)
    return done.split("generated report: ")[-1].split(" with ")[0], past


@query(
    f"""WITH {_FILES}, {_CHOSEN}, found AS (SELECT o_orderkey {_MINED}),
    n AS (SELECT (SELECT count(*) FROM chosen) AS r, (SELECT count(*) FROM found) AS c)
    SELECT r AS repos_scanned, c AS commits_matched,
    CASE WHEN r = 0 THEN 'No repositories found.' WHEN c = 0 THEN 'No relevant commits found.'
    ELSE 'Successfully generated report with ' || c || ' commits from ' || r || ' repositories' END AS status
    FROM n"""
)
def run_summary(spark, sf_dir):
    found = _mining_tables(spark, sf_dir)
    # Chosen once: the number of them and the search both start from what was written.
    chosen = cut_lineage(mining.choose_repos(FLAGSHIP, found))
    small = fits_broadcast(chosen)
    kept = mining.filter_commits(
        chosen, FLAGSHIP.keywords, FLAGSHIP.max_modified_files, found, small, chosen if small else None
    )
    return report.run_summary(chosen, kept)


# ---- filters


@query(
    """SELECT trim(line) AS value FROM (SELECT CASE c_mktsegment
        WHEN 'BUILDING' THEN '  github.com/org/r' || c_custkey || ' '
        WHEN 'MACHINERY' THEN '# https://github.com/org/r' || c_custkey
        WHEN 'HOUSEHOLD' THEN 'https://gitlab.com/org/r' || c_custkey
        WHEN 'FURNITURE' THEN 'http://github.com/org/r' || c_custkey || '.git'
        ELSE 'https://github.com/org/r' || c_custkey || '/' END AS line FROM customer)
    WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')"""
)
def drop_comments(spark, sf_dir):
    return repo_ops.drop_comments(roles.list_lines(spark, sf_dir)).select("value")


@query(
    """SELECT page_id, regexp_full_match(url, '(https?://)?[a-z.-]+\\.example\\.(com|org)/.+/.+(\\.git)?') AS is_repo
    FROM pages"""
)
def repo_url_filter(spark, sf_dir):
    pages = roles.table(spark, sf_dir, "pages")
    return pages.select("page_id", urls.is_repo_url(F.col("url"), roles.PAGES_HOST_PATTERN).alias("is_repo"))


_DOMAIN_TERMS = ["Build", "00077", "nation 1"]
_DOMAIN_HITS = """SELECT 'org/r' || c_custkey AS repo_id FROM customer
    WHERE lower(c_mktsegment) LIKE '%build%' OR lower(c_name) LIKE '%00077%'
    OR (c_acctbal >= 0 AND ('nation ' || c_nationkey) LIKE '%nation 1%')"""


@query(_DOMAIN_HITS)
def repo_domain_filter(spark, sf_dir):
    return repo_ops.match_domains(roles.repos(spark, sf_dir), _DOMAIN_TERMS).select("repo_id")


@query(_DOMAIN_HITS)
def repo_domain_index(spark, sf_dir):
    """The same through the trigrams, written in order and read back."""
    repos, path = roles.repos(spark, sf_dir), scratch_path(spark, "trigrams")
    trigrams.write_index(trigrams.trigram_index(repos), path)
    return trigrams.match_domains_indexed(repos, spark.read.parquet(path), _DOMAIN_TERMS).select("repo_id")


@query("SELECT 'org/r' || c_custkey AS repo_id FROM customer WHERE floor(c_acctbal) >= 1000")
def repo_min_stars(spark, sf_dir):
    return repo_ops.min_stars(roles.repos(spark, sf_dir), 1000).select("repo_id")


@query("SELECT 'org/r' || c_custkey AS repo_id FROM customer WHERE c_acctbal >= 0")
def repo_complete(spark, sf_dir):
    """The clone URL goes missing where the description does."""
    url = F.when(F.col("description").isNotNull(), F.col("clone_url"))
    return repo_ops.complete_repos(roles.repos(spark, sf_dir).withColumn("clone_url", url)).select("repo_id")


_COUNTED = """SELECT 'org/r' || c_custkey AS repo_id, count(o_orderkey) AS commit_count
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"""


def _counted(spark, sf_dir):
    counts = history.commit_counts(roles.commits(spark, sf_dir))
    return repo_ops.with_commit_count(roles.repos(spark, sf_dir), counts).select("repo_id", "commit_count")


@query(_COUNTED + " HAVING count(o_orderkey) > 10")
def commit_count_greater(spark, sf_dir):
    return repo_ops.commit_count_filter(_counted(spark, sf_dir), "GREATER", 10)


@query(_COUNTED + " HAVING count(o_orderkey) < 10")
def commit_count_less(spark, sf_dir):
    return repo_ops.commit_count_filter(_counted(spark, sf_dir), "less", 10)


@query(_COUNTED)
def commit_count_off(spark, sf_dir):
    return repo_ops.commit_count_filter(_counted(spark, sf_dir), "", 10)


@query(f"SELECT doc_id FROM documents WHERE {_ANY_WORD}")
def keyword_any(spark, sf_dir):
    commits = roles.text_commits(spark, sf_dir)
    hits = commits.where(text.contains_any(F.col("message"), WORDS))
    return hits.select(F.col("hash").cast("bigint").alias("doc_id"))


@query("SELECT doc_id, false AS hit FROM documents")
def keyword_empty_list(spark, sf_dir):
    """Only commas in the field: no term, no commit."""
    hit = text.contains_any(F.col("message"), text.split_terms(",,"))
    return roles.text_commits(spark, sf_dir).select(F.col("hash").cast("bigint").alias("doc_id"), hit.alias("hit"))


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL")
def keyword_blank(spark, sf_dir):
    """An empty field: one empty term, every commit."""
    commits = roles.text_commits(spark, sf_dir)
    hits = commits.where(text.contains_any(F.col("message"), text.split_terms("")))
    return hits.select(F.col("hash").cast("bigint").alias("doc_id"))


@query(
    f"""WITH {_FILES} SELECT o_orderkey FROM orders LEFT JOIN files ON l_orderkey = o_orderkey
    WHERE o_orderstatus = 'P' OR coalesce(n, 0) <= 4"""
)
def max_files_changed(spark, sf_dir):
    kept = diffs.max_files(_commits_with_files(spark, sf_dir), 4)
    return kept.select(F.col("hash").cast("bigint").alias("o_orderkey"))


@query(
    f"""WITH {_FILES} SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey
    LEFT JOIN files ON l_orderkey = o_orderkey
    WHERE {_ANY_PRIORITY} AND (o_orderstatus = 'P' OR coalesce(n, 0) <= 4)"""
)
def commit_filter(spark, sf_dir):
    found = _mining_tables(spark, sf_dir)
    kept = mining.filter_commits(found.repos, PRIORITIES, 4, found)
    return kept.select(F.col("hash").cast("bigint").alias("o_orderkey"))


@query(
    f"""WITH {_FILES} SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey
    LEFT JOIN files ON l_orderkey = o_orderkey
    WHERE {_ANY_PRIORITY} AND (o_orderstatus = 'P' OR coalesce(n, 0) <= 4)
    AND (o_custkey % 3 = 0 OR (o_custkey % 3 = 1 AND o_orderkey % 5 <> 0))"""
)
def commit_filter_unreadable(spark, sf_dir):
    """Landed changes with a mark for commits that could not be compared; null marks nothing."""
    found = _mining_tables(spark, sf_dir)
    number, commit = F.substring("repo_id", 6, 20).cast("bigint"), F.col("hash").cast("bigint")
    mark = F.when(number % 3 == 1, commit % 5 != 0).when(number % 3 == 2, F.lit(False))
    marked = dataclasses.replace(found, commits=found.commits.withColumn("diff_ok", mark))
    kept = mining.filter_commits(found.repos, PRIORITIES, 4, marked)
    return kept.select(F.col("hash").cast("bigint").alias("o_orderkey"))


@query(
    f"""WITH {_TREE_DIFF}, sizes AS (SELECT h, count(*) AS n FROM diff GROUP BY h)
    SELECT o_orderkey FROM orders LEFT JOIN sizes ON h = o_orderkey
    WHERE {_ANY_PRIORITY} AND (o_orderkey = 0 OR (o_orderkey % 7 <> 0 AND coalesce(n, 0) <= 4))"""
)
def mine_trees_unreadable(spark, sf_dir):
    """Trees compared here; some commits name a parent that is not in the table and are dropped."""
    commits = roles.linear_commits(spark, sf_dir)
    lost = (F.col("hash").cast("bigint") % 7 == 0) & (F.col("hash") != "0")
    commits = commits.withColumn("parents", F.when(lost, F.array(F.lit("gone"))).otherwise(F.col("parents")))
    repos = commits.groupBy("repo_id").agg(
        F.lit("https://github.com/org/orders.git").alias("clone_url"), F.lit(0).cast("bigint").alias("repo_ord")
    )
    found = mining.MiningTables(commits=commits, tree_entries=roles.tree_entries(spark, sf_dir))
    kept = mining.filter_commits(repos, PRIORITIES, 4, found)
    return kept.select(F.col("hash").cast("bigint").alias("o_orderkey"))


# ---- projections


@query(
    """SELECT c_custkey AS repo_ord, CASE c_mktsegment
        WHEN 'HOUSEHOLD' THEN 'https://gitlab.com/org/r' || c_custkey || '.git'
        WHEN 'FURNITURE' THEN 'http://github.com/org/r' || c_custkey || '.git'
        ELSE 'https://github.com/org/r' || c_custkey || '.git' END AS clone_url,
    CASE c_mktsegment
        WHEN 'BUILDING' THEN 'https://github.com/github.com/org/r' || c_custkey || '.git'
        WHEN 'HOUSEHOLD' THEN 'https://gitlab.com/org/r' || c_custkey || '.git'
        WHEN 'FURNITURE' THEN 'http://github.com/org/r' || c_custkey || '.git'
        ELSE 'https://github.com/org/r' || c_custkey || '/.git' END AS legacy_url
    FROM customer WHERE c_mktsegment <> 'MACHINERY'"""
)
def normalize_url(spark, sf_dir):
    lines = repo_ops.drop_comments(roles.list_lines(spark, sf_dir))
    return lines.select(
        "repo_ord",
        urls.normalize_repo_url(F.col("value")).alias("clone_url"),
        urls.normalize_repo_url(F.col("value"), legacy=True).alias("legacy_url"),
    )


@query(
    """SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '[^a-zA-Z0-9._-]', '_', 'g') AS name
    FROM pages"""
)
def repo_name(spark, sf_dir):
    pages = roles.table(spark, sf_dir, "pages")
    return pages.select("page_id", urls.repo_name(F.concat("url", F.lit(".git"))).alias("name"))


@query(
    """SELECT page_id, url || '/commit/' || page_id AS commit_url,
    replace(url, '.git', '') || '/commit/' || page_id AS legacy_url FROM pages"""
)
def commit_url(spark, sf_dir):
    pages = roles.table(spark, sf_dir, "pages")
    clone, commit = F.concat("url", F.lit(".git")), F.col("page_id").cast("string")
    return pages.select(
        "page_id",
        urls.commit_url(clone, commit).alias("commit_url"),
        urls.commit_url(clone, commit, legacy=True).alias("legacy_url"),
    )


@query(f"SELECT {_REPORT_COLUMNS} FROM orders JOIN customer ON c_custkey = o_custkey")
def commit_report(spark, sf_dir):
    commits = history.commits_of(
        roles.repos(spark, sf_dir).select(*mining.REPO_COLUMNS), roles.commits(spark, sf_dir)
    )
    return report.to_report(commits)


@query(f"SELECT doc_id, {_CUT.format('text')} AS message FROM documents")
def message_truncate(spark, sf_dir):
    documents = roles.table(spark, sf_dir, "documents")
    return documents.select("doc_id", text.truncate_text(F.col("text")).alias("message"))


@query(
    f"""SELECT event_id, {_DATE.format('ts')} AS date, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events"""
)
def author_date_text(spark, sf_dir):
    events = roles.table(spark, sf_dir, "events")
    time = F.col("ts").cast("timestamp")
    return events.select("event_id", java_date_text(time).alias("date"), stamp_text(time).alias("stamp"))


# ---- joins


@query(
    """SELECT CAST(c.conv_id AS VARCHAR) AS repo_id, CAST(c.turn AS VARCHAR) AS hash,
    CASE WHEN c.turn = 0 THEN '' ELSE CAST(c.turn - 1 AS VARCHAR) END AS parent, c.turn = 0 AS is_root,
    (c.turn = 0 OR p.turn IS NOT NULL) AS diff_ok
    FROM (SELECT conv_id, turn FROM conversations) c
    LEFT JOIN (SELECT DISTINCT conv_id, turn FROM conversations) p
    ON p.conv_id = c.conv_id AND p.turn = c.turn - 1"""
)
def first_parent(spark, sf_dir):
    commits = history.first_parent(roles.talk_commits(spark, sf_dir))
    return commits.select("repo_id", "hash", F.coalesce("parent", F.lit("")).alias("parent"), "is_root", "diff_ok")


@query(f"WITH {_TREE_DIFF} SELECT CAST(h AS VARCHAR) AS hash, path, change_type FROM diff")
def tree_diff(spark, sf_dir):
    changed = diffs.tree_diff(roles.linear_commits(spark, sf_dir), roles.tree_entries(spark, sf_dir))
    return changed.select("hash", "path", "change_type")


@query(f"WITH {_TREE_DIFF} SELECT CAST(h AS VARCHAR) AS hash, path, change_type FROM diff")
def tree_diff_joined(spark, sf_dir):
    changed = diffs.tree_diff_joined(roles.linear_commits(spark, sf_dir), roles.tree_entries(spark, sf_dir))
    return changed.select("hash", "path", "change_type")


@query(f"WITH {_TREE_DIFF} SELECT CAST(h AS VARCHAR) AS hash, path, change_type FROM diff")
def tree_diff_digests(spark, sf_dir):
    """Trees without directories, nearly all different: nothing to pass over."""
    changed = diffs.tree_diff_by_directory(roles.linear_commits(spark, sf_dir), roles.tree_entries(spark, sf_dir))
    return changed.select("hash", "path", "change_type")


_SNAPSHOT_DIFF = f"""WITH trees AS (
    SELECT k, CASE WHEN (p_partkey // 10 + k) % {roles.CHANGE_EVERY} = 7 THEN 'old/' ELSE '' END
           || (p_partkey // 1000) || '/' || (p_partkey // 10) || '/' || p_partkey AS path,
           (p_partkey // 10 + k) // {roles.CHANGE_EVERY} AS blob
    FROM part, range({roles.SNAPSHOTS}) r(k)),
    new AS (SELECT * FROM trees WHERE k > 0), old AS (SELECT k + 1 AS k, path, blob FROM trees WHERE k < {roles.SNAPSHOTS - 1})
    SELECT CAST(coalesce(new.k, old.k) AS VARCHAR) AS hash, coalesce(new.path, old.path) AS path,
           CASE WHEN old.k IS NULL THEN 'ADD' WHEN new.k IS NULL THEN 'DELETE' ELSE 'MODIFY' END AS change_type
    FROM new FULL JOIN old ON new.k = old.k AND new.path = old.path
    WHERE old.k IS NULL OR new.k IS NULL OR new.blob <> old.blob"""


@query(_SNAPSHOT_DIFF)
def tree_diff_snapshots(spark, sf_dir):
    """Large trees of which little changes, their equal directories passed over."""
    changed = diffs.tree_diff_by_directory(roles.snapshot_commits(spark, sf_dir), roles.snapshot_trees(spark, sf_dir))
    return changed.select("hash", "path", "change_type")


@query(
    f"""WITH {_LISTED} SELECT 'org/r' || o_custkey AS repo_id, CAST(o_orderkey AS VARCHAR) AS hash
    FROM orders JOIN (SELECT * FROM listed UNION ALL SELECT * FROM listed) ON c_custkey = o_custkey"""
)
def repo_commits(spark, sf_dir):
    """A list given twice: every commit twice."""
    listed = _listed_repos(spark, sf_dir)
    twice = repo_ops.append_pages(listed, listed)
    return history.commits_of(twice, roles.commits(spark, sf_dir)).select("repo_id", "hash")


@query(
    """SELECT doc_id FROM documents WHERE EXISTS
    (SELECT 1 FROM benchmark WHERE contains(lower(documents.text), lower(benchmark.text)))"""
)
def keyword_semi_join(spark, sf_dir):
    terms = roles.table(spark, sf_dir, "benchmark").select(F.col("text").alias("keyword"))
    hits = keywords.match_keyword_table(roles.text_commits(spark, sf_dir), terms)
    return hits.select(F.col("hash").cast("bigint").alias("doc_id"))


@query(
    """SELECT doc_id FROM documents WHERE EXISTS
    (SELECT 1 FROM benchmark WHERE contains(lower(documents.text), lower(benchmark.text)))"""
)
def keyword_semi_join_shuffled(spark, sf_dir):
    """The form for lists of any length."""
    terms = roles.table(spark, sf_dir, "benchmark").select(F.col("text").alias("keyword"))
    hits = keywords.match_keyword_table(roles.text_commits(spark, sf_dir), terms, max_terms=-1)
    return hits.select(F.col("hash").cast("bigint").alias("doc_id"))


@query(_COUNTED)
def repo_with_commit_count(spark, sf_dir):
    return _counted(spark, sf_dir)


# ---- aggregations


@query("SELECT 'org/r' || o_custkey AS repo_id, count(*) AS commit_count FROM orders GROUP BY o_custkey")
def commit_count(spark, sf_dir):
    return history.commit_counts(roles.commits(spark, sf_dir))


@query(
    f"""WITH {_FILES} SELECT CAST(o_orderkey AS VARCHAR) AS hash, coalesce(n, 0) AS files_changed
    FROM orders LEFT JOIN files ON l_orderkey = o_orderkey"""
)
def files_changed(spark, sf_dir):
    return _commits_with_files(spark, sf_dir).select("hash", "files_changed")


@query(
    f"""WITH {_TREE_DIFF} SELECT CAST(o_orderkey AS VARCHAR) AS hash, count(path) AS files_changed
    FROM orders LEFT JOIN diff ON h = o_orderkey GROUP BY o_orderkey"""
)
def tree_diff_count(spark, sf_dir):
    commits = roles.linear_commits(spark, sf_dir)
    counts = diffs.files_changed(diffs.tree_diff(commits, roles.tree_entries(spark, sf_dir)))
    return diffs.with_files_changed(commits, counts).select("hash", "files_changed")


@query(
    f"""WITH {_FILES} SELECT 'org/r' || c_custkey AS repo_id, count(o_orderkey) AS scanned,
    count(CASE WHEN {_ANY_PRIORITY} AND (o_orderstatus = 'P' OR coalesce(n, 0) <= 4) THEN 1 END) AS matched
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN files ON l_orderkey = o_orderkey
    GROUP BY c_custkey"""
)
def match_tally(spark, sf_dir):
    kept = text.contains_any(F.col("message"), PRIORITIES) & (F.col("is_root") | (F.col("files_changed") <= 4))
    tally = history.match_tally(roles.repos(spark, sf_dir), _commits_with_files(spark, sf_dir), kept)
    return tally.select("repo_id", "scanned", "matched")


# ---- order, pages, set operations


@query(
    """SELECT 'org/r' || o_custkey AS repo_id, CAST(o_orderkey AS VARCHAR) AS hash,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR)) AS log_position
    FROM orders"""
)
def log_order(spark, sf_dir):
    return ordering.log_position(roles.commits(spark, sf_dir))


@query(
    """SELECT c_custkey AS repo_ord, CAST(floor(c_acctbal) AS INTEGER) AS stars FROM customer
    ORDER BY floor(c_acctbal) DESC, c_custkey LIMIT 100 OFFSET 100"""
)
def result_page(spark, sf_dir):
    order = [F.desc("stars"), F.asc("repo_ord")]
    return ordering.result_page(roles.repos(spark, sf_dir).select("repo_ord", "stars"), 2, order)


@query(
    """SELECT c_custkey AS repo_ord, CAST((row_number() OVER
    (ORDER BY floor(c_acctbal) DESC, c_custkey) - 1) // 100 + 1 AS INTEGER) AS page FROM customer"""
)
def all_pages(spark, sf_dir):
    order = [F.desc("stars"), F.asc("repo_ord")]
    repos = roles.repos(spark, sf_dir).select("repo_ord", "stars")
    return ordering.all_pages(repos, order).select("repo_ord", "page")


@query(
    """SELECT repo_ord, count(*) AS times FROM (
        SELECT c_custkey AS repo_ord FROM customer WHERE c_acctbal >= 0
        UNION ALL SELECT c_custkey FROM customer WHERE floor(c_acctbal) >= 1000) GROUP BY repo_ord"""
)
def union_all_pages(spark, sf_dir):
    repos = roles.repos(spark, sf_dir)
    pages = repo_ops.append_pages(repo_ops.min_stars(repos, 0), repo_ops.min_stars(repos, 1000))
    return pages.groupBy("repo_ord").agg(F.count("*").alias("times"))


# ---- scalar functions


@query(
    """SELECT doc_id, replace(replace(replace(url_encode(text), '%20', '+'), '%2A', '*'), '~', '%7E') AS encoded
    FROM documents"""
)
def url_encode(spark, sf_dir):
    documents = roles.table(spark, sf_dir, "documents")
    return documents.select("doc_id", F.url_encode("text").alias("encoded"))


@query("SELECT p_partkey, replace(p_name, ' ', ' OR ') AS domain_query FROM part")
def join_terms(spark, sf_dir):
    part = roles.table(spark, sf_dir, "part")
    return part.select("p_partkey", text.join_terms(F.split("p_name", " ")).alias("domain_query"))


@query(
    """SELECT doc_id, CASE WHEN text = '' THEN 1 WHEN regexp_replace(text, ',+$', '') = '' THEN 0
    ELSE len(string_split(regexp_replace(text, ',+$', ''), ',')) END AS terms,
    CASE WHEN regexp_replace(text, ',+$', '') = '' THEN ''
    ELSE array_to_string(string_split(regexp_replace(text, ',+$', ''), ','), '|') END AS joined
    FROM documents"""
)
def split_terms(spark, sf_dir):
    documents = roles.table(spark, sf_dir, "documents")
    terms = text.split_terms_col(F.col("text"))
    return documents.select("doc_id", F.size(terms).alias("terms"), F.array_join(terms, "|").alias("joined"))


@query(
    """SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS k,
    coalesce(TRY_CAST(json_extract_string(props, '$.none') AS INTEGER), 0) AS none FROM events"""
)
def json_field_default(spark, sf_dir):
    events = roles.table(spark, sf_dir, "events")
    return events.select(
        "event_id",
        responses.json_int(F.col("props"), "k").alias("k"),
        responses.json_int(F.col("props"), "none").alias("none"),
    )


# ---- refreshes


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'")
def incremental_new_commits(spark, sf_dir):
    """The table holds the commits before 1997; a refresh delivers the whole history twice."""
    commits = roles.commits(spark, sf_dir)
    held = commits.where("committed_at < TIMESTAMP '1997-01-01'")
    found = history.new_commits(held, commits.unionAll(commits))
    return found.select(F.col("hash").cast("bigint").alias("o_orderkey"))


@query(f"WITH {_FILES}, {_CHOSEN} SELECT {_REPORT_COLUMNS} {_MINED}")
def incremental_mine(spark, sf_dir):
    """Hits of the commits before 1997 are kept; a refresh delivers the whole history. The rows of mine_search."""
    tables = _mining_tables(spark, sf_dir)
    held = tables.commits.where("committed_at < TIMESTAMP '1997-01-01'")
    kept = cut_lineage(upkeep.search_hits(held, FLAGSHIP, tables))
    hits = cut_lineage(upkeep.refresh_hits(kept, held, tables.commits, FLAGSHIP, tables))
    return upkeep.mine_kept(FLAGSHIP, tables, hits)


_BRANCHED = f"""WITH RECURSIVE placed AS (
    SELECT o_orderkey AS k, o_orderkey - {roles.BRANCHED_REPOS} * CASE WHEN o_orderkey % 11 = 5 THEN 2 ELSE 1 END AS p
    FROM orders
    UNION ALL SELECT o_orderkey, o_orderkey - {3 * roles.BRANCHED_REPOS} FROM orders WHERE o_orderstatus = 'P'),
    edges AS (SELECT k, p FROM placed WHERE p >= 0),
    reached AS (
        SELECT max(o_orderkey) AS k FROM orders GROUP BY o_orderkey % {roles.BRANCHED_REPOS}
        UNION SELECT p FROM reached JOIN edges USING (k))"""


@query(f"{_BRANCHED} SELECT CAST(k % {roles.BRANCHED_REPOS} AS VARCHAR) AS repo_id, CAST(k AS VARCHAR) AS hash FROM reached")
def reachable_commits(spark, sf_dir):
    """The history of the newest commit of every repository."""
    return reachability.reachable_commits(roles.branched_commits(spark, sf_dir)).select("repo_id", "hash")


def _snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits, trees = roles.snapshot_commits(spark, sf_dir), roles.snapshot_trees(spark, sf_dir)
    return cut_lineage(diffs.tree_diff_by_directory(commits, trees, blobs=True))


# The file name is the key of the part, so a deleted and an added file of one name are the same part.
_RENAMED = f"""WITH files AS (
    SELECT p_partkey, k, (p_partkey // 1000) || '/' || (p_partkey // 10) AS home, (p_partkey // 10 + k) % {roles.CHANGE_EVERY} = 7 AS away,
           (p_partkey // 10 + k) // {roles.CHANGE_EVERY} AS blob
    FROM part, range({roles.SNAPSHOTS}) r(k)),
    changes AS (
        SELECT n.k, n.p_partkey, n.home, o.away <> n.away AS moved, o.away, o.blob <> n.blob AS edited
        FROM files n JOIN files o ON o.p_partkey = n.p_partkey AND o.k = n.k - 1
        WHERE o.away <> n.away OR o.blob <> n.blob),
    renames AS (
        SELECT k, CASE WHEN away THEN 'old/' ELSE '' END || home || '/' || p_partkey AS old_path,
               CASE WHEN away THEN '' ELSE 'old/' END || home || '/' || p_partkey AS new_path, edited, home, away
        FROM changes WHERE moved)"""


@query(f"{_RENAMED} SELECT CAST(k AS VARCHAR) AS hash, old_path, new_path, edited FROM renames")
def renamed_paths(spark, sf_dir):
    found = renames.renamed_paths(_snapshot_changes(spark, sf_dir))
    return found.select("hash", "old_path", "new_path", "edited")


@query(
    f"""{_RENAMED}, pairs AS (SELECT k, home, away, count(*) AS n FROM renames GROUP BY ALL),
    summed AS (SELECT k, sum(n)::BIGINT AS moved, max(n) AS together FROM pairs GROUP BY k),
    others AS (SELECT k, count(*) FILTER (NOT moved) AS other FROM changes GROUP BY k)
    SELECT CAST(k AS VARCHAR) AS hash, moved, other,
           CASE WHEN together >= 2 THEN 'move_directory|' ELSE '' END || 'move_file'
           || CASE WHEN other = 0 THEN '|pure_move' ELSE '' END AS tags
    FROM summed JOIN others USING (k)"""
)
def refactoring_moves(spark, sf_dir):
    found = renames.refactoring_moves(_snapshot_changes(spark, sf_dir))
    return found.select("hash", "moved", "other", F.array_join("tags", "|").alias("tags"))


@query(
    f"""SELECT 'org/r' || o_custkey AS repo_id, CAST(o_orderkey AS VARCHAR) AS hash, o_orderpriority AS message
    FROM orders WHERE {_ANY_PRIORITY}"""
)
def stream_matching_commits(spark, sf_dir):
    """The orders file as a landing folder, streamed to its end; equal to the batch query."""
    schema = roles.table(spark, sf_dir, "orders").schema
    landed = landed_stream(spark, f"{sf_dir}/orders.parquet*", schema).selectExpr(
        "concat('org/r', o_custkey) AS repo_id", "CAST(o_orderkey AS STRING) AS hash", "o_orderpriority AS message"
    )
    out = scratch_path(spark, "stream")
    hits = matching_stream(landed, PRIORITIES)
    run_to_end(hits, f"{out}/rows", f"{out}/checkpoint")
    return spark.read.schema(hits.schema).parquet(f"{out}/rows")


@query(
    f"""WITH {_FILES} SELECT 'org/r' || o_custkey AS repo_id, CAST(o_orderkey AS VARCHAR) AS hash,
    o_orderpriority AS message, coalesce(n, 0) AS files_changed
    FROM orders LEFT JOIN files ON l_orderkey = o_orderkey
    WHERE {_ANY_PRIORITY} AND (o_orderstatus = 'P' OR coalesce(n, 0) <= 4)"""
)
def stream_mined_commits(spark, sf_dir):
    """Orders and their lines as two streams, joined within an hour. Then heartbeats close the last day."""
    out = scratch_path(spark, "stream")
    ends = {"orders": f"{out}/end_of_commits", "lineitem": f"{out}/end_of_changes"}
    tables_of = {name: roles.table(spark, sf_dir, name).schema for name in ends}
    for name, path in ends.items():
        spark.createDataFrame([], tables_of[name]).write.parquet(path)

    def stream(name: str, *columns: str) -> DataFrame:
        rows = landed_stream(spark, f"{sf_dir}/{name}.parquet*", tables_of[name])
        return rows.unionAll(landed_stream(spark, ends[name], tables_of[name])).selectExpr(*columns)

    commits = stream(
        "orders", "concat('org/r', o_custkey) AS repo_id", "CAST(o_orderkey AS STRING) AS hash",
        "CASE WHEN o_orderstatus = 'P' THEN CAST(array() AS ARRAY<STRING>) ELSE array('') END AS parents",
        "o_orderpriority AS message", "timestamp_seconds(coalesce(o_orderkey, o_custkey)) AS ingested_at",
    )
    changes = stream(
        "lineitem", "CAST(l_orderkey AS STRING) AS hash", "CAST(l_partkey AS STRING) AS path",
        "timestamp_seconds(coalesce(l_orderkey + l_linenumber, l_partkey)) AS ingested_at",
    )
    large = large_commits(roles.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("hash")))
    large = cut_lineage(large.withColumn("hash", F.col("hash").cast("string")))
    mined = mined_stream(
        commits, changes, PRIORITIES, FLAGSHIP.max_modified_files, large=None if large.isEmpty() else large
    )
    run_to_end(mined, f"{out}/rows", f"{out}/checkpoint")
    late = 1 << 40  # seconds, far behind every order
    heartbeat = {"orders": {"o_custkey": late}, "lineitem": {"l_partkey": late}}
    for name, path in ends.items():
        row = [F.lit(heartbeat[name].get(f.name)).cast(f.dataType).alias(f.name) for f in tables_of[name]]
        spark.range(1).select(*row).write.mode("append").parquet(path)
    run_to_end(mined, f"{out}/rows", f"{out}/checkpoint")
    return spark.read.schema(mined.schema).parquet(f"{out}/rows").select("repo_id", "hash", "message", "files_changed")


# ---- promised by the tool's description


@query(
    f"""WITH {_FILES}, {_CHOSEN} SELECT {_REPORT_COLUMNS},
    'https://github.com/org/r' || o_custkey || '.git' AS repository, coalesce(n, 0) AS files_changed {_MINED}"""
)
def report_files_changed(spark, sf_dir):
    kept = mining.mined_commits(FLAGSHIP, _mining_tables(spark, sf_dir), with_count=True)
    return report.to_report(kept, files=True)


@query(
    """SELECT CAST(user_id AS VARCHAR) AS repo_id, strftime(date_trunc('week', ts), '%Y-%m-%d') AS period,
    count(*) AS commits FROM events GROUP BY 1, 2"""
)
def commit_frequency(spark, sf_dir):
    weeks = health.commit_frequency(roles.event_commits(spark, sf_dir))
    return weeks.withColumn("period", F.date_format("period", "yyyy-MM-dd"))


@query(
    """WITH times AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events),
    steps AS (SELECT user_id, sec, sec - lag(sec) OVER (PARTITION BY user_id ORDER BY sec) AS pause FROM times)
    SELECT CAST(user_id AS VARCHAR) AS repo_id, count(*) AS commits,
    min(sec) AS first_sec, max(sec) AS last_sec, count(DISTINCT sec // 86400) AS active_days,
    CAST(coalesce(CASE WHEN count(DISTINCT sec) > 1 THEN max(pause) END, -1) AS BIGINT) AS longest_gap_seconds
    FROM steps GROUP BY user_id"""
)
def repo_health(spark, sf_dir):
    found = health.repo_health(roles.event_commits(spark, sf_dir))
    return found.select(
        "repo_id", "commits",
        F.unix_seconds("first_at").alias("first_sec"), F.unix_seconds("last_at").alias("last_sec"),
        "active_days", "longest_gap_seconds",
    )


# Kinds that occur in the documents of the driver, which have no refactoring vocabulary.
TAG_TERMS = {"license": ["mit license", "copyright"], "naming": ["renam", "rethe"], "moving": ["thing", "ación"]}


@query(
    """SELECT doc_id, array_to_string(list_filter([
        CASE WHEN contains(lower(text), 'mit license') OR contains(lower(text), 'copyright') THEN 'license' END,
        CASE WHEN contains(lower(text), 'thing') OR contains(lower(text), 'ación') THEN 'moving' END,
        CASE WHEN contains(lower(text), 'renam') OR contains(lower(text), 'rethe') THEN 'naming' END],
        lambda x: x IS NOT NULL), '|') AS tags FROM documents"""
)
def refactoring_tags(spark, sf_dir):
    documents = roles.table(spark, sf_dir, "documents")
    tags = text.refactoring_tags(F.col("text"), TAG_TERMS)
    return documents.select("doc_id", F.array_join(tags, "|").alias("tags"))


def _tags_sql(terms: Mapping[str, Sequence[str]], column: str) -> str:
    kinds = [
        f"CASE WHEN {' OR '.join(f"contains(lower({column}), '{t}')" for t in terms[kind])} THEN '{kind}' END"
        for kind in sorted(terms)
    ]
    return f"array_to_string(list_filter([{', '.join(kinds)}], lambda x: x IS NOT NULL), '|')"


@query(f"SELECT doc_id, {_tags_sql(text.REFACTORING_TERMS, 'text')} AS tags FROM documents")
def refactoring_tags_default(spark, sf_dir):
    documents = roles.table(spark, sf_dir, "documents")
    return documents.select("doc_id", F.array_join(text.refactoring_tags(F.col("text")), "|").alias("tags"))


@query(
    f"""WITH {_FILES}, {_CHOSEN}, found AS (SELECT o_orderkey {_MINED}),
    n AS (SELECT (SELECT count(*) FROM chosen) AS r, (SELECT count(*) FROM found) AS c)
    SELECT 'build,auto' AS domains, 'urgent,high' AS keywords, 'greater' AS commit_filter, 8 AS commit_threshold,
    1000 AS min_stars, 4 AS max_modified_files, r AS repos_scanned, c AS commits_matched,
    CASE WHEN r = 0 THEN 'No repositories found.' WHEN c = 0 THEN 'No relevant commits found.'
    ELSE 'Successfully generated report with ' || c || ' commits from ' || r || ' repositories' END AS status
    FROM n"""
)
def search_history(spark, sf_dir):
    return spark.read.parquet(_run(spark, sf_dir)[1])
