"""Canonical tables. Operators take these column names; other tables are renamed to them first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_TEXT, _INT, _LONG, _TIME = T.StringType(), T.IntegerType(), T.LongType(), T.TimestampType()

# repo_ord is the position in the input and gives the report its order.
REPOS = _struct(
    repo_id=_TEXT, full_name=_TEXT, clone_url=_TEXT, description=_TEXT,
    topics=T.ArrayType(_TEXT), stars=_INT, repo_ord=_LONG,
)
COMMIT_COUNTS = _struct(repo_id=_TEXT, commit_count=_LONG)

# Unique on (repo_id, hash): history.new_commits keeps it so on every append.
COMMITS = _struct(
    repo_id=_TEXT, hash=_TEXT, parents=T.ArrayType(_TEXT), author=_TEXT,
    authored_at=_TIME, committed_at=_TIME, message=_TEXT,
)
# What a commits table may have besides: whether the commit could be compared with its parent.
DIFF_OK = T.StructField("diff_ok", T.BooleanType(), True)
# Unique on (repo_id, hash, path). FILE_CHANGES may leave repo_id out: a hash names the same commit, with
# the same first parent, in every repository that holds it.
TREE_ENTRIES = _struct(repo_id=_TEXT, hash=_TEXT, path=_TEXT, mode=_TEXT, blob_id=_TEXT)
FILE_CHANGES = _struct(repo_id=_TEXT, hash=_TEXT, path=_TEXT, change_type=_TEXT)

REPORT = _struct(commit_url=_TEXT, commit_hash=_TEXT, author=_TEXT, date=_TEXT, message=_TEXT)
RUN_SUMMARY = _struct(repos_scanned=_LONG, commits_matched=_LONG, status=_TEXT)

# Landed service responses: one row per request.
SEARCH_RESPONSES = _struct(search_id=_TEXT, page=_INT, status=_INT, link=_TEXT, body=_TEXT)
COUNT_RESPONSES = _struct(full_name=_TEXT, status=_INT, link=_TEXT, body=_TEXT)

# One search page. Stars are read as text, so that "12" and 12 both count and junk becomes 0.
SEARCH_PAGE = _struct(
    items=T.ArrayType(
        _struct(
            clone_url=_TEXT, full_name=_TEXT, stargazers_count=_TEXT,
            description=_TEXT, topics=T.ArrayType(_TEXT),
        )
    )
)

COMMIT_KEY = ["repo_id", "hash"]


def commit_key(df: DataFrame) -> list[str]:
    """Key columns of a commit that a table has: ``hash`` alone or with ``repo_id``."""
    return [c for c in COMMIT_KEY if c in df.columns]
