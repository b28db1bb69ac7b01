"""The commit query: choose repositories, keep matching commits of limited size, report them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repomine.functions.text import contains_any, split_terms, truncate_text
from repomine.operators.diffs import (
    files_changed, max_files, tree_diff, tree_diff_by_directory, with_files_changed, within_file_limit,
)
from repomine.operators.history import commit_counts, commits_of, first_parent, parent_columns
from repomine.operators.joins import fits_broadcast, keep_repos
from repomine.operators.repos import (
    commit_count_filter, complete_repos, count_filter_active, match_domains, min_stars, with_commit_count,
)
from repomine.operators.report import NO_COMMITS, NO_REPOSITORIES, in_report_order, run_totals, to_report
from repomine.operators.sieve import key_sieve, sift
from repomine.schemas import commit_key
from repomine.session import cut_lineage
from repomine.sources.reports import append_history, write_report

# Fixed value: the file limit a search starts with.
DEFAULT_MAX_FILES = 10

REPO_COLUMNS = ["repo_id", "clone_url", "repo_ord"]


@dataclass(frozen=True)
class MiningQuery:
    """Parameters of a search. ``commit_filter`` is '', 'greater' or 'less'."""

    domains: Sequence[str] = ()
    keywords: Sequence[str] = ()
    commit_filter: str | None = ""
    commit_threshold: int = 0
    min_stars: int = 0
    max_modified_files: int = DEFAULT_MAX_FILES

    @classmethod
    def from_form(cls, domains: str, keywords: str, **other: object) -> MiningQuery:
        """From the two comma-separated fields as they are typed, blanks included."""
        return cls(domains=split_terms(domains), keywords=split_terms(keywords), **other)


@dataclass(frozen=True)
class MiningTables:
    """Inputs. Changed files come from ``file_changes`` if given, else from ``tree_entries``.

    ``unique_paths=False`` is for landed changes that may repeat a path of a commit. ``commit_counts`` saves
    the counting where counts have landed. ``answered`` says that the repositories are a service's answer
    to the domain terms: it found them by means of its own, so they are not compared with the terms again.
    ``tree_digests`` are the directory digests kept beside the trees; equal directories are then passed over.
    """

    commits: DataFrame
    repos: DataFrame | None = None
    file_changes: DataFrame | None = None
    tree_entries: DataFrame | None = None
    commit_counts: DataFrame | None = None
    unique_paths: bool = True
    answered: bool = False
    tree_digests: DataFrame | None = None


def candidate_repos(query: MiningQuery, tables: MiningTables) -> DataFrame:
    """Repositories that pass everything but the commit count."""
    kept = min_stars(complete_repos(tables.repos), query.min_stars)
    return (kept if tables.answered else match_domains(kept, query.domains)).select(*REPO_COLUMNS)


def choose_repos(query: MiningQuery, tables: MiningTables, small: bool | None = None) -> DataFrame:
    """Repositories of the search form. Commits are only counted if the count is asked for.

    ``small`` says that the candidates were measured to fit a broadcast (``None`` measures them here). Then
    only their commits are counted, and the counts, one per candidate, fit too.
    """
    chosen = candidate_repos(query, tables)
    if not count_filter_active(query.commit_filter, query.commit_threshold):
        return chosen
    if small is None:
        small = fits_broadcast(chosen)
    counts = tables.commit_counts
    source = tables.commits if counts is None else counts
    if small:
        source = keep_repos(source, chosen)
    counts = commit_counts(source) if counts is None else source
    counted = with_commit_count(chosen, counts, broadcast=small)
    return commit_count_filter(counted, query.commit_filter, query.commit_threshold).select(*REPO_COLUMNS)


def keyword_commits(
    repos: DataFrame, keywords: Sequence[str], tables: MiningTables, broadcast: bool | None = None
) -> DataFrame:
    """Commits of the repositories with any keyword.

    The predicate sees the whole message, in the scan. Only then is the message cut as the report cuts it,
    so that no shuffle carries more of it.
    """
    hits = tables.commits.where(contains_any(F.col("message"), keywords))
    hits = parent_columns(hits.withColumn("message", truncate_text(F.col("message"))))
    return commits_of(repos.select(*REPO_COLUMNS), hits, broadcast)


def change_counts(
    hits: DataFrame, tables: MiningTables, repos: DataFrame | None = None, prune: bool = False, sieved: bool = False
) -> DataFrame:
    """Changed files per commit: of all landed changes, or from the trees of ``hits`` and their parents.

    Unique changes are counted without a join before it: the counts are combined ahead of the shuffle, while
    a join with the hits would shuffle every change. Changes that may repeat a path are first cut down to the
    hits, by their commit; that shuffle also places them for the distinct count, so they cross the wire once.
    Where a side was measured to fit a broadcast it prunes the changes in the scan: ``repos`` by repository,
    with ``prune`` the hits themselves by commit. ``sieved`` is for hits that do not fit, but are written: a
    filter of fixed size then drops most other changes in the scan, before any shuffle.
    """
    if tables.file_changes is None:
        trees = tables.tree_entries if repos is None else keep_repos(tables.tree_entries, repos)
        if tables.tree_digests is not None:
            return files_changed(tree_diff_by_directory(hits, trees, tables.tree_digests))
        return files_changed(tree_diff(hits, trees))
    changes = tables.file_changes
    if repos is not None and "repo_id" in changes.columns:
        changes = keep_repos(changes, repos)
    key = commit_key(changes)
    if sieved:
        changes = sift(changes, key_sieve(hits, key), key)
    if prune or not tables.unique_paths:
        wanted = hits.select(*key)
        changes = changes.join(F.broadcast(wanted) if prune else wanted, key, "left_semi")
    return files_changed(changes, tables.unique_paths)


def with_readable_diff(hits: DataFrame, tables: MiningTables, repos: DataFrame | None = None) -> DataFrame:
    """Drop commits whose trees cannot be compared because the parent is not there; others go on.

    Landed changes were compared before; there a ``diff_ok`` column of the commits is respected, where null
    says nothing against a commit. ``repos``,
    measured to fit a broadcast, limits the commits among which the parents are looked up.
    """
    if tables.file_changes is None:
        hits = first_parent(hits, tables.commits if repos is None else keep_repos(tables.commits, repos))
    return hits.where(F.coalesce("diff_ok", F.lit(True))) if "diff_ok" in hits.columns else hits


def filter_commits(
    repos: DataFrame,
    keywords: Sequence[str],
    max_modified_files: int,
    tables: MiningTables,
    broadcast: bool | None = None,
    only: DataFrame | None = None,
    with_count: bool = False,
    staged: bool = False,
    prune: bool | None = None,
) -> DataFrame:
    """Commits of ``repos`` with any keyword and at most so many changed files.

    ``with_count`` adds ``files_changed``, which the plain report does not need. ``staged`` writes the
    commits with a keyword to the shared folder first and goes on from there: the messages are then searched
    once however often the commits are used, and their number is known. Trees always ask for it, since the
    commits are needed for the parents, for the trees and for the result. ``prune`` says whether the keys of
    staged hits fit a broadcast; ``None`` measures them.
    """
    staged = staged or tables.file_changes is None
    hits = keyword_commits(repos, keywords, tables, broadcast)
    if staged:
        hits = cut_lineage(hits)
    hits = with_readable_diff(hits, tables, only)
    known = staged and tables.file_changes is not None
    if known and prune is None:
        prune = fits_broadcast(hits.select(*commit_key(hits)))
    counts = change_counts(hits, tables, only, bool(known and prune), bool(known and not prune))
    if with_count:
        return max_files(with_files_changed(hits, counts), max_modified_files)
    return within_file_limit(hits, counts, max_modified_files)


def mined_commits(
    query: MiningQuery, tables: MiningTables, with_count: bool = False, staged: bool = False,
    small: bool | None = None, prune: bool | None = None,
) -> DataFrame:
    """Kept commits of the search form, with the columns of their repository.

    One job is run here: it measures the repositories that pass domain and stars, which bounds the ones
    chosen. If they fit, they are broadcast, and prune commits and changes in the scan. ``small`` and ``prune``
    give the answer for the repositories and for staged hits instead.
    """
    candidates = candidate_repos(query, tables)
    if small is None:
        small = fits_broadcast(candidates)
    return filter_commits(
        choose_repos(query, tables, small), query.keywords, query.max_modified_files, tables,
        broadcast=small, only=candidates if small else None, with_count=with_count, staged=staged, prune=prune,
    )


def mine(query: MiningQuery, tables: MiningTables, staged: bool = False) -> DataFrame:
    """Report rows of the search form. The repositories are measured here; the rest is lazy unless staged."""
    return to_report(mined_commits(query, tables, staged=staged))


def mine_from_list(
    repos: DataFrame, keywords: Sequence[str], max_modified_files: int, tables: MiningTables, staged: bool = False
) -> DataFrame:
    """Report rows of the list form. Stars and commit counts play no part in it."""
    small = fits_broadcast(repos.select(*REPO_COLUMNS))
    only = repos if small else None
    return to_report(
        filter_commits(repos, keywords, max_modified_files, tables, small, only, staged=staged)
    )


def write_mined(
    repos: DataFrame,
    query: MiningQuery,
    tables: MiningTables,
    base: str,
    fmt: str = "csv",
    with_files: bool = False,
    history: str | None = None,
) -> str:
    """Write the ordered report of the given repositories and answer with the message of the run.

    ``with_files`` adds the repository and the number of changed files to the report. ``history`` is the
    table of past searches, to which the run is added. A run without a matching commit writes no report.
    """
    chosen = cut_lineage(repos.select(*REPO_COLUMNS))
    listed = chosen.count()
    path, rows = "", 0
    if listed:
        small = fits_broadcast(chosen)
        only = chosen if small else None
        # The sort into report order reads its input twice, so it must not start from the messages.
        kept = cut_lineage(filter_commits(
            chosen, query.keywords, query.max_modified_files, tables, small, only, with_files, staged=True
        ))
        rows = kept.count()
        if rows:
            path = write_report(to_report(in_report_order(kept), files=with_files), base, fmt)
    if history:
        append_history(history_entry(query, run_totals(chosen.sparkSession, listed, rows)), history)
    if not listed:
        return NO_REPOSITORIES
    if not rows:
        return NO_COMMITS
    return f"Successfully generated report: {path} with {rows} commits from {listed} repositories"


def run_search(
    query: MiningQuery, tables: MiningTables, base: str, fmt: str = "csv", with_files: bool = False,
    history: str | None = None,
) -> str:
    """The search form from start to report."""
    return write_mined(choose_repos(query, tables), query, tables, base, fmt, with_files, history)


def run_list(
    repos: DataFrame,
    keywords: Sequence[str],
    max_modified_files: int,
    tables: MiningTables,
    base: str,
    fmt: str = "csv",
    with_files: bool = False,
    history: str | None = None,
) -> str:
    """The list form from start to report."""
    query = MiningQuery(keywords=keywords, max_modified_files=max_modified_files)
    return write_mined(repos, query, tables, base, fmt, with_files, history)


def history_entry(query: MiningQuery, summary: DataFrame) -> DataFrame:
    """One row for the table of past searches: the parameters and the summary of the run."""
    return summary.select(
        F.lit(",".join(query.domains)).alias("domains"),
        F.lit(",".join(query.keywords)).alias("keywords"),
        F.lit(query.commit_filter or "").alias("commit_filter"),
        F.lit(query.commit_threshold).alias("commit_threshold"),
        F.lit(query.min_stars).alias("min_stars"),
        F.lit(query.max_modified_files).alias("max_modified_files"),
        "repos_scanned",
        "commits_matched",
        "status",
    )
