"""Repository and commit URLs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The host, its pattern, the suffix of a clone URL and the path of a commit page.
HOST = "github.com"
HOST_PATTERN = r"github\.com"
GIT_SUFFIX = ".git"
COMMIT_PATH = "/commit/"


def is_repo_url(line: Column, host_pattern: str = HOST_PATTERN) -> Column:
    """True where the whole line is ``[http[s]://]host/owner/name[.git]``."""
    # The last group of the pattern is optional after ".+", so it decides nothing and is left out.
    return F.rlike(line, F.lit(rf"^(https?://)?{host_pattern}/.+/.+\z"))


def normalize_repo_url(line: Column, host: str = HOST, legacy: bool = False) -> Column:
    """Clone URL of an accepted line: with scheme and with ``.git``.

    ``legacy=True`` gives the old text of two odd cases: a line without scheme gets the host twice, and a
    slash at the end is kept before the suffix.
    """
    if legacy:
        bare, prefix = line, f"https://{host}/"
    else:
        bare, prefix = F.rtrim(line, F.lit("/")), "https://"
    full = F.when(F.startswith(bare, F.lit("http")), bare).otherwise(F.concat(F.lit(prefix), bare))
    return F.when(F.endswith(full, F.lit(GIT_SUFFIX)), full).otherwise(F.concat(full, F.lit(GIT_SUFFIX)))


def without_suffix(clone_url: Column, legacy: bool = False) -> Column:
    if legacy:
        return F.replace(clone_url, F.lit(GIT_SUFFIX), F.lit(""))
    return F.regexp_replace(clone_url, re.escape(GIT_SUFFIX) + r"\z", "")


def repo_key(clone_url: Column) -> Column:
    """``owner/name``, which identifies a repository; the short name alone would mix up two owners."""
    return F.regexp_extract(without_suffix(clone_url), r"^https?://[^/]+/(.+)\z", 1)


def repo_name(clone_url: Column) -> Column:
    """Short name with every unusual character replaced by an underscore."""
    return F.regexp_replace(
        F.regexp_extract(clone_url, r"([^/]*)\.git[^/]*\z", 1), "[^a-zA-Z0-9._-]", "_"
    )


def commit_url(clone_url: Column, commit_hash: Column, legacy: bool = False) -> Column:
    """Page of a commit. ``legacy=True`` drops every ``.git`` of the URL, not only the suffix."""
    return F.concat(without_suffix(clone_url, legacy), F.lit(COMMIT_PATH), commit_hash)
