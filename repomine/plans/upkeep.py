"""A search whose result is kept: a refresh looks at the new commits only."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repomine.functions.text import contains_any, truncate_text
from repomine.operators.diffs import max_files, with_files_changed
from repomine.operators.history import commits_of, new_commits, parent_columns
from repomine.operators.joins import fits_broadcast
from repomine.operators.report import to_report
from repomine.plans.mining import MiningQuery, MiningTables, candidate_repos, change_counts, choose_repos, with_readable_diff
from repomine.schemas import COMMIT_KEY, commit_key
from repomine.session import cut_lineage


def search_hits(commits: DataFrame, query: MiningQuery, tables: MiningTables) -> DataFrame:
    """The commits of any repository that have a keyword and change few enough files, with ``files_changed``.

    This is what is kept. Which repositories a search chooses depends on their counts of commits and changes
    with every refresh, so hits are kept for all of them. ``commits`` is what is searched, ``tables.commits`` the
    whole history, in which the trees of a search look up parents.
    """
    hits = commits.where(contains_any(F.col("message"), query.keywords))
    hits = cut_lineage(parent_columns(hits.withColumn("message", truncate_text(F.col("message")))))
    hits = with_readable_diff(hits, tables)
    prune = tables.file_changes is not None and fits_broadcast(hits.select(*commit_key(hits)))
    return max_files(with_files_changed(hits, change_counts(hits, tables, prune=prune)), query.max_modified_files)


def refresh_hits(kept: DataFrame, held: DataFrame, incoming: DataFrame, query: MiningQuery, tables: MiningTables) -> DataFrame:
    """``kept`` and the hits among the ``incoming`` commits that the table ``held`` does not have yet.

    Of the held commits only the keys are read; no message is searched twice. Changes are counted for the new
    hits alone. ``tables`` are the changes, or the trees, after the refresh.
    """
    fresh = cut_lineage(new_commits(held, incoming))
    if tables.file_changes is None:
        keys = held.select(*COMMIT_KEY).unionByName(fresh.select(*COMMIT_KEY))
        tables = dataclasses.replace(tables, commits=keys)
    return kept.unionByName(search_hits(fresh, query, tables))


def retract_hits(kept: DataFrame, history: DataFrame) -> DataFrame:
    """``kept`` without the commits that left the history, as a force-push makes them do. Only keys are read."""
    return kept.join(history.select(*COMMIT_KEY), COMMIT_KEY, "left_semi")


def mine_kept(query: MiningQuery, tables: MiningTables, kept: DataFrame) -> DataFrame:
    """The report of the search form from kept hits. Of the commits only the repositories are read, to count them."""
    small = fits_broadcast(candidate_repos(query, tables))
    chosen = choose_repos(query, tables, small)
    return to_report(commits_of(chosen, kept, broadcast=small))
