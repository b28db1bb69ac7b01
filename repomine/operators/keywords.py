"""Keyword lists that come as a table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repomine.functions.text import contains_any
from repomine.operators.joins import small_side_join
from repomine.schemas import COMMIT_KEY
from repomine.session import cut_lineage

# A list up to this size becomes one pattern, evaluated in the scan of the commits.
MAX_PATTERN_TERMS = 20_000
MAX_PATTERN_CHARS = 1_000_000

@dataclass(frozen=True)
class Winnow:
    """Pieces of ``length`` characters, of which the one with the least hash of every ``window`` is kept.

    ``after`` names a character that stands before a piece; without it a piece begins at every character.
    """

    length: int
    window: int
    after: str = ""


# How terms are anchored, the sparsest first: a term takes the first that gives it a whole window. The last
# ones keep every piece, for terms shorter than any window.
WINNOWS = (Winnow(8, 8, " "), Winnow(8, 9), Winnow(5, 4), Winnow(4, 1), Winnow(2, 1), Winnow(1, 1))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _least_of_windows(hashes: Column, window: int) -> Column:
    """The least value of every ``window`` neighbours, from those of 1, 2, 4 … of them."""

    def wider(least: Column, width: int) -> Column:
        if width == window:
            return F.slice(least, F.lit(1), F.greatest(F.size(hashes) - (window - 1), F.lit(0)))
        step = min(width, window - width)
        # Beyond the end there is nothing, which `least` passes over.
        shifted = F.slice(least, F.lit(step + 1), F.greatest(F.size(least) - step, F.lit(0)))
        return _let(F.zip_with(least, shifted, lambda one, two: F.least(one, two)), lambda both: wider(both, width + step))

    return wider(hashes, 1)


def winnowed(text: Column, winnow: Winnow) -> Column:
    """Distinct hashes of the pieces of a text that have the least hash of a window.

    A term with a whole window of pieces shares the least of it with every text that holds the term, since
    the pieces within the term are neighbours in the text too. Of long texts about two in ``window + 1`` pieces
    are left. A look-ahead cuts the pieces, so that they may overlap; linear in the text.
    """
    pieces = F.regexp_extract_all(text, F.lit(f"(?s){winnow.after}(?=(.{{{winnow.length}}}))"), 1)
    kind = F.lit(WINNOWS.index(winnow) if winnow in WINNOWS else -1)
    hashes = F.transform(pieces, lambda piece: F.xxhash64(piece, kind))
    return F.array_distinct(_let(hashes, lambda all_of_them: _least_of_windows(all_of_them, winnow.window)))


def _anchors(terms: DataFrame) -> DataFrame:
    """``term, kind, piece``: of the pieces a term must share with a text, the one fewest terms have.

    Terms that begin alike (addresses, say) thus meet only texts that hold what tells them apart.
    """
    kinds = F.array(*[F.struct(F.lit(i).alias("kind"), winnowed(F.col("term"), w).alias("pieces")) for i, w in enumerate(WINNOWS)])
    first = F.get(F.filter(kinds, lambda k: F.size(k["pieces"]) > 0), 0)
    pieces = terms.select("term", first.alias("k")).select("term", "k.kind", F.explode_outer("k.pieces").alias("piece"))
    pieces = pieces.where("piece is not null")
    shared = pieces.groupBy("piece").agg(F.count("*").alias("terms"))
    best = pieces.join(shared, "piece").groupBy("term").agg(F.min(F.struct("terms", "kind", "piece")).alias("best"))
    return best.select("term", "best.kind", "best.piece")


def _match_by_anchors(commits: DataFrame, terms: DataFrame) -> DataFrame:
    """Commits that hold a term, by a shuffle of winnowed pieces of their text.

    Texts are cut only in the ways some term is anchored. Pieces that no term is anchored on are dropped
    against the distinct anchors before terms are joined, and a text meets all its candidate terms in one
    row, where the whole terms are checked.
    """
    if not terms.where("term = ''").isEmpty():
        return commits.where("message is not null")
    anchored = cut_lineage(_anchors(terms))
    kinds = sorted(r["kind"] for r in anchored.select("kind").distinct().collect())  # one row per way at most
    if not kinds:
        return commits.where(F.lit(False))
    low = F.lower("message")
    keyed = commits.where("message is not null")
    cut = _let(low, lambda text: F.concat(*[winnowed(text, WINNOWS[k]) for k in kinds]))
    # A plain explode would have Spark cut the text once more, to see whether there is any piece.
    pieces = keyed.select(*COMMIT_KEY, F.explode_outer(cut).alias("piece"))
    met = small_side_join(pieces, anchored.select("piece").distinct(), ["piece"], F.col("hash"), "left_semi")
    candidates = small_side_join(met, anchored.drop("kind"), ["piece"], F.col("hash")).groupBy(*COMMIT_KEY).agg(
        F.collect_set("term").alias("_terms")
    )
    held = keyed.select(*COMMIT_KEY, F.array(low).alias("_low")).join(candidates, COMMIT_KEY)
    hits = held.where(F.exists("_low", lambda text: F.exists("_terms", lambda term: F.contains(text, term))))
    return commits.join(hits.select(*COMMIT_KEY), COMMIT_KEY, "left_semi")


def match_keyword_table(
    commits: DataFrame,
    keywords: DataFrame,
    column: str = "keyword",
    max_terms: int = MAX_PATTERN_TERMS,
    max_chars: int = MAX_PATTERN_CHARS,
) -> DataFrame:
    """Commits whose message contains any keyword of a table.

    The list is measured first. Within the bounds it becomes a predicate on the message, with no join at
    all. Beyond them texts and terms meet by winnowed pieces in a shuffle, and the whole term is checked
    afterwards.
    """
    terms = keywords.select(F.lower(column).alias("term")).where("term is not null").distinct()
    size = terms.agg(F.count("*").alias("n"), F.sum(F.length("term")).alias("chars")).first()
    if size["n"] <= max_terms and (size["chars"] or 0) <= max_chars:
        return commits.where(contains_any(F.col("message"), [r["term"] for r in terms.collect()]))
    return _match_by_anchors(commits, terms)
