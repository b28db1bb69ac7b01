"""Text: term lists, keyword predicates, trimming and cutting."""

from __future__ import annotations

import functools
import itertools
import operator
import os
from collections import Counter, defaultdict
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The report cuts a message longer than 2000 characters to 1997 and three dots.
MESSAGE_LIMIT = 2000
ELLIPSIS = "..."

# Trimming a line drops every character up to U+0020, not only the space.
BLANKS = "".join(map(chr, range(0x21)))

# Above this many terms one pattern search is faster than a search per term (see README, measurements).
MAX_SEPARATE_TERMS = 24
# Characters of a term that are searched at once, at least.
MIN_TAIL = 4
# Groups of a pattern within each other, at most.
MAX_NESTING = 64


def split_terms(text: str, trim: bool = False) -> list[str]:
    """Split a form field on commas. Inner blanks are kept, trailing empty terms are dropped.

    An empty field is one empty term, which matches everything; only commas give no term at all.
    """
    if text == "":
        return [""]
    terms = text.rstrip(",").split(",") if text.strip(",") else []
    return [t.strip() for t in terms] if trim else terms


def split_terms_col(text: Column) -> Column:
    """:func:`split_terms` for a column."""
    return (
        F.when(text == "", F.array(F.lit("")))
        .when(F.rtrim(text, F.lit(",")) == "", F.array().cast("array<string>"))
        .otherwise(F.split(F.rtrim(text, F.lit(",")), ",", -1))
    )


def join_terms(terms: Column) -> Column:
    return F.array_join(terms, " OR ")


def trim_line(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def _escaped(text: str) -> str:
    # A backslash is only an error before ASCII letters and digits.
    return "".join(c if c.isalnum() or ord(c) > 127 else "\\" + c for c in text)


def _rare_starts(terms: Sequence[str]) -> dict[str, int]:
    """A position in each term from which to search for it, so that few and rare characters start a search.

    Greedy cover of the terms by characters, the cheapest per term first. At least ``MIN_TAIL`` characters
    of a term follow, so that a chance hit is unlikely; short terms are searched from their beginning.
    """
    weight = Counter(itertools.chain.from_iterable(terms))
    holders: dict[str, set[str]] = defaultdict(set)
    for term in terms:
        for char in set(term[: max(len(term) - MIN_TAIL, 0) + 1]):
            holders[char].add(term)
    starts: dict[str, int] = {}
    while len(starts) < len(terms):
        char = min(holders, key=lambda c: (weight[c] / len(holders[c]), c))
        starts.update((term, term.index(char)) for term in holders.pop(char))
        holders = {c: left for c, held in holders.items() if (left := held - starts.keys())}
    return starts


def _alternation(tails: Sequence[tuple[str, str]], depth: int = 0) -> str:
    """Pattern for any of the sorted (rest of the tail, whole term) pairs, with common prefixes shared.

    Groups nest up to ``MAX_NESTING``; what lies deeper is listed, since both this function and the pattern
    engine go one step down the stack per group.
    """
    branches = []
    if depth == MAX_NESTING:
        return "|".join(f"{_escaped(tail)}(?<={_escaped(term)})" for tail, term in tails)
    for _, group in itertools.groupby(tails, key=lambda t: t[0][:1]):
        members = list(group)
        prefix = os.path.commonprefix([tail for tail, _ in members])
        if prefix == "":  # the tail ends here, the term must end here too
            branches += [f"(?<={_escaped(term)})" for _, term in members]
        else:
            rest = [(tail[len(prefix):], term) for tail, term in members]
            branches.append(f"{_escaped(prefix)}(?:{_alternation(rest, depth + 1)})")
    return "|".join(branches)


def terms_pattern(terms: Iterable[str]) -> str:
    """One pattern that finds any of the given non-empty terms.

    A term is searched from its rarest suitable character on, and the part before it is looked up when the
    rest was found. The look-ahead passes over a character that starts no search with a single test. Terms
    that begin with another term add nothing to "contains any" and are left out.
    """
    kept: list[str] = []
    for term in sorted(set(terms)):
        if not kept or not term.startswith(kept[-1]):
            kept.append(term)
    starts = _rare_starts(kept)
    tails = sorted((term[starts[term]:], term) for term in kept)
    first = "".join(_escaped(c) for c in sorted({tail[0] for tail, _ in tails}))
    return f"(?=[{first}])(?:{_alternation(tails)})"


def contains_any(text: Column, terms: Iterable[str]) -> Column:
    """True where the lower-cased text contains any lower-cased term as a plain substring.

    No term: false for every row. An empty term: true for every text that is not null.
    """
    wanted = sorted({t.lower() for t in terms})
    if not wanted:
        return F.lit(False)
    if "" in wanted:
        return text.isNotNull()
    if len(wanted) == 1:
        return F.contains(F.lower(text), F.lit(wanted[0]))
    if len(wanted) <= MAX_SEPARATE_TERMS:
        # The one-element array binds the lower-cased text to a variable. An OR of contains(lower(text), …)
        # would lower-case a long text once per term, which costs more than the searches.
        return F.exists(
            F.array(F.lower(text)),
            lambda low: functools.reduce(operator.or_, [F.contains(low, F.lit(t)) for t in wanted]),
        )
    return F.rlike(F.lower(text), F.lit(terms_pattern(wanted)))


def array_contains_any(texts: Column, terms: Iterable[str]) -> Column:
    """:func:`contains_any` over the elements of an array; NUL keeps a term from spanning two of them."""
    return contains_any(F.array_join(texts, "\0"), terms)


def truncate_text(text: Column, limit: int = MESSAGE_LIMIT) -> Column:
    """Cut a text longer than ``limit`` so that it has ``limit`` characters with the dots; null stays null.

    Lengths are code points, so text outside the basic plane is cut later than by UTF-16 units.
    """
    kept = F.substring(text, 1, limit - len(ELLIPSIS))
    return F.when(F.length(text) > limit, F.concat(kept, F.lit(ELLIPSIS))).otherwise(text)


# Our own dictionary: the source of the query names refactoring detection but defines no terms.
REFACTORING_TERMS: dict[str, list[str]] = {
    "clean_up": ["clean up", "cleanup", "dead code", "remove unused", "simplif"],
    "encapsulate": ["encapsulat", "hide field"],
    "extract": ["extract class", "extract interface", "extract method", "extract function", "split class"],
    "general": ["refactor", "restructur", "reorganiz", "reorganis"],
    "inline": ["inline class", "inline method", "inline function"],
    "move": ["move class", "move method", "move function", "pull up", "push down", "relocat"],
    "rename": ["renam"],
}


def refactoring_tags(message: Column, terms: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Sorted kinds of refactoring whose terms occur in the message; empty when there is none."""
    kinds = REFACTORING_TERMS if terms is None else terms
    tags = [F.when(contains_any(message, kinds[kind]), F.lit(kind)) for kind in sorted(kinds)]
    return F.array_compact(F.array(*tags)) if tags else F.array().cast("array<string>")
