"""Run a search over landed tables: ``spark-submit … -m repomine search|list …`` or ``python -m repomine …``.

The fields are typed as in a form: terms are split on commas and keep their blanks.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from repomine.functions.text import split_terms
from repomine.plans.mining import DEFAULT_MAX_FILES, MiningQuery, MiningTables, run_list, run_search
from repomine.schemas import COUNT_RESPONSES, SEARCH_RESPONSES
from repomine.session import build_session
from repomine.sources import tables
from repomine.sources.lists import scan_repo_list
from repomine.sources.search import commit_count_from_responses, repos_from_responses

# Fixed value: the answer to a list without a single repository.
NO_LIST = "No valid repository URLs found in the file."


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="repomine")
    forms = top.add_subparsers(dest="form", required=True)
    search = forms.add_parser("search", help="choose repositories by domain, stars and commit count")
    listed = forms.add_parser("list", help="take the repositories of a text file")
    for form in (search, listed):
        form.add_argument("--commits", required=True, help="folder of the commits table (Parquet)")
        changed = form.add_mutually_exclusive_group(required=True)
        changed.add_argument("--file-changes", help="folder of the changed files")
        changed.add_argument("--tree-entries", help="folder of the file trees, compared here")
        form.add_argument("--keywords", default="", help="comma-separated, empty matches every commit")
        form.add_argument("--max-modified-files", type=int, default=DEFAULT_MAX_FILES)
        form.add_argument("--out", default="reports")
        form.add_argument("--format", choices=["csv", "parquet"], default="csv")
        form.add_argument("--with-files", action="store_true", help="add repository and number of changed files")
        form.add_argument("--history", help="folder of the table of past searches, to add this run to")
    source = search.add_mutually_exclusive_group(required=True)
    source.add_argument("--repos", help="folder of the repositories table")
    source.add_argument("--search-responses", help="folder of landed search answers (Parquet)")
    search.add_argument("--search-id", help="which of the landed searches to take; all of them by default")
    search.add_argument("--count-responses", help="folder of landed commit-count answers (Parquet)")
    search.add_argument("--domains", default="")
    search.add_argument("--commit-filter", default="", help="greater or less")
    search.add_argument("--commit-threshold", type=int, default=0)
    search.add_argument("--min-stars", type=int, default=0)
    listed.add_argument("--file", required=True, help="one repository URL per line, # for comments")
    return top


def main(arguments: Sequence[str] | None = None) -> str:
    args = parser().parse_args(arguments)
    spark = build_session()
    landed = MiningTables(
        commits=tables.scan_commits(spark, args.commits),
        file_changes=tables.scan_file_changes(spark, args.file_changes) if args.file_changes else None,
        tree_entries=tables.scan_tree_entries(spark, args.tree_entries) if args.tree_entries else None,
    )
    if args.form == "list":
        repos = scan_repo_list(spark, args.file)
        if repos.isEmpty():
            return NO_LIST
        keywords = split_terms(args.keywords)
        return run_list(
            repos, keywords, args.max_modified_files, landed, args.out, args.format, args.with_files, args.history
        )

    if args.repos:
        repos = tables.scan_repos(spark, args.repos)
    else:
        answers = spark.read.schema(SEARCH_RESPONSES).parquet(args.search_responses)
        repos = repos_from_responses(answers, args.search_id)
    counts = None
    if args.count_responses:
        answers = spark.read.schema(COUNT_RESPONSES).parquet(args.count_responses)
        counts = commit_count_from_responses(answers).withColumnRenamed("full_name", "repo_id")
    query = MiningQuery.from_form(
        args.domains, args.keywords, commit_filter=args.commit_filter, commit_threshold=args.commit_threshold,
        min_stars=args.min_stars, max_modified_files=args.max_modified_files,
    )
    inputs = MiningTables(
        landed.commits, repos, landed.file_changes, landed.tree_entries, counts, answered=not args.repos
    )
    return run_search(query, inputs, args.out, args.format, args.with_files, args.history)


if __name__ == "__main__":
    print(main())
