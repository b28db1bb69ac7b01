"""SpotSigs fingerprints: chains of content words that follow common words, compared by pruned Jaccard.

Where common words are rare, all content words begin chains."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repomine.llm.text import read_table
from repomine.session import cut_lineage

# Common words of four languages. A run of them is an anchor.
COMMON_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the",
    "this", "to", "was", "were", "with",
    "au", "aux", "ce", "dans", "de", "des", "du", "elle", "en", "est", "et", "la", "le", "les", "ou", "par", "pas",
    "pour", "que", "qui", "sur", "un", "une",
    "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "im", "ist", "mit", "nicht", "sich", "und", "von",
    "zu",
    "con", "del", "el", "es", "esta", "las", "lo", "los", "no", "para", "por", "se", "su", "y",
)

# Content words in a chain.
CHAIN = 3
# From so many content words after the last one behind an anchor, all begin chains, up to the next anchor: where
# fewer than one in so many has an anchor, the text is covered nevertheless.
SPARSE = 12

LEAST_LIKENESS = 0.8

# Characters of a slice of documents, about. Slices are many, so that their places even out.
SLICE_CHARS = 4 * 1024 * 1024
# Bounds are looked up in two steps of at most so many each.
MAX_BOUNDS = 256


def normal_text(text: Column) -> Column:
    """Lower-case words of letters and digits with one space after each; null is empty."""
    words = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.concat(F.ltrim(F.rtrim(words)), F.lit(" "))


def spots(text: Column, common: Sequence[str] = COMMON_WORDS, chain: int = CHAIN) -> Column:
    """Sorted different signatures (bigint) of a text.

    The text is cut into content words, each with the common words before it. A content word that has some,
    and the first one of the text, begin a chain of ``chain`` content words, fewer at the end of the text;
    so does one that has none of these among the ``SPARSE - 1`` content words before it. That looks at the
    nearest words only, so an edit changes the chains around it, however few common words a text has.
    The signature is the hash of the common words and the chain. A text of common words only has one
    signature, of those words; a text without words has none.
    """
    anchor = "|".join(sorted(set(common)))
    # The quantifiers of groups are possessive: the engine walks a long run of common words in a loop then, and
    # would otherwise go one step down its stack for each.
    run = rf"(?:(?:{anchor}) )"
    pieces = F.regexp_extract_all(normal_text(text), F.lit(rf"{run}*+[^ ]+ |{run}++$"), 0)
    # The one-element array binds the pieces to a variable: they are cut once, not once per word.
    bound = F.array(pieces)
    return F.array_sort(F.array_distinct(F.transform(bound, lambda p: _chains(p, chain))[0]))


def _content(piece: Column) -> Column:
    """The last word of a piece, which is the content word."""
    return F.substring_index(F.rtrim(piece), " ", -1)


def _chains(pieces: Column, chain: int) -> Column:
    def rest(step: int) -> Column:
        words = F.transform(F.slice(pieces, step + 1, F.greatest(F.size(pieces) - step, F.lit(0))), _content)
        return words

    chained = F.transform(pieces, lambda p, i: F.struct(p.alias("words"), ((i == 0) | F.contains(F.rtrim(p), F.lit(" "))).alias("begins")))
    for step in range(1, chain):
        chained = F.zip_with(
            chained,
            rest(step),
            lambda c, w: F.struct(F.concat(c["words"], F.coalesce(w, F.lit("")), F.lit(" ")).alias("words"), c["begins"].alias("begins")),
        )

    def begun(all_chains: Column) -> Column:
        def begins(c: Column, i: Column) -> Column:
            # The first chain of a text begins, so the search ends there at the latest.
            near = [F.get(all_chains, i - step)["begins"] for step in range(1, SPARSE)]
            return c["begins"] | ~reduce(Column.__or__, near)

        return F.transform(F.filter(all_chains, begins), lambda c: F.xxhash64(c["words"]))

    return F.transform(F.array(chained), begun)[0]


def fingerprint_text(signatures: Column) -> Column:
    """Short name of a set of signatures: its size and 128 bits of its hash."""
    digest = F.substring(F.sha2(F.array_join(F.transform(signatures, lambda s: F.hex(s)), ","), 256), 1, 32)
    return F.concat(F.lower(F.hex(F.size(signatures))), F.lit("-"), digest)


def length_class(size: Column, least: float = LEAST_LIKENESS) -> Column:
    """Partition of a set size: two sets that are ``least`` alike are in the same or in neighbouring ones.

    The classes grow by the factor ``1 / least``; empty sets are in class -1.
    """
    return F.when(size > 0, F.floor(F.log(size.cast("double")) / F.log(F.lit(1 / least)) + 1e-9)).otherwise(F.lit(-1)).cast("int")


def likeness(left: Column, right: Column, least: float = 0.0) -> Column:
    """Jaccard likeness of two sets of signatures; 1 for two empty ones.

    It is at most the smaller size over the larger one. Pairs for which that bound is below ``least`` (or is
    0) are not compared and get 0.
    """
    small, large = F.least(F.size(left), F.size(right)), F.greatest(F.size(left), F.size(right))
    shared = F.size(F.array_intersect(left, right))
    compared = shared / (F.size(left) + F.size(right) - shared)
    return (
        F.when(large == 0, F.lit(1.0))
        .when((small == 0) | (small / large < least), F.lit(0.0))
        .otherwise(compared)
    )


def fingerprints(docs: DataFrame, common: Sequence[str] = COMMON_WORDS, chain: int = CHAIN) -> DataFrame:
    """``doc_id, signatures, fingerprint`` of every row; null text counts as empty."""
    signed = docs.select("doc_id", spots(F.col("text"), common, chain).alias("signatures"))
    return signed.withColumn("fingerprint", fingerprint_text(F.col("signatures")))


def near_duplicates(docs: DataFrame, least: float = LEAST_LIKENESS) -> tuple[DataFrame, DataFrame]:
    """Near duplicates by likeness of at least ``least``: ``(pairs, members)``.

    ``members`` has ``doc_id, class_id`` for every row with an id: documents of one fingerprint are a class,
    named by its smallest id, so copies make no pairs. ``pairs`` has ``a, b, likeness`` of classes, a < b.
    Classes meet by a signature among the first of their sets in the order of rarity, enough that similar
    sets cannot miss each other; only sets of the same or a neighbouring length class are compared, and only
    if their sizes allow ``least``. Rows without id are left out. Texts without words are one class and like
    nothing else. An empty table gives two empty results.
    """
    signed = cut_lineage(fingerprints(docs.where("doc_id is not null")))
    classes = signed.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id"))
    members = signed.select("doc_id", "fingerprint").join(classes, "fingerprint").select("doc_id", "class_id")
    sets = cut_lineage(signed.join(classes.withColumnRenamed("class_id", "doc_id"), ["doc_id", "fingerprint"]).dropDuplicates(["doc_id"]).select("doc_id", "signatures"))
    single = sets.select("doc_id", F.size("signatures").alias("n"), F.explode("signatures").alias("sig"))
    # Order by rarity: the prefix of a set in this order has the signatures few others have.
    counts = single.groupBy("sig").agg(F.count("*").alias("holders"))
    ranked = single.join(counts, "sig").groupBy("doc_id").agg(
        F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("holders", "sig"))).alias("order")
    )
    prefix = F.slice("order", 1, (F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).cast("int"))
    keys = ranked.select("doc_id", "n", length_class(F.col("n"), least).alias("part"), F.explode(prefix).alias("at")).select("doc_id", "n", "part", "at.sig")
    left = keys.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), "sig", "part")
    right = keys.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), "sig", F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)).alias("part"))
    candidates = (
        left.join(right, ["sig", "part"])
        .where("a < b").where(F.least("na", "nb") >= F.greatest("na", "nb") * least - 1e-9)
        .select("a", "b").distinct()
    )
    compared = (
        candidates.join(sets.select(F.col("doc_id").alias("a"), F.col("signatures").alias("sa")), "a")
        .join(sets.select(F.col("doc_id").alias("b"), F.col("signatures").alias("sb")), "b")
        .select("a", "b", likeness(F.col("sa"), F.col("sb"), least).alias("likeness"))
    )
    return compared.where(F.col("likeness") >= least), members


def _bounds(docs: DataFrame, slice_chars: int) -> list[int]:
    """Ids at which slices of about equal size begin: existing ids, the smallest one first."""
    size = docs.agg(F.sum(F.length("text").cast("bigint")).alias("chars"), F.min("key").alias("first")).first()
    if size["first"] is None:
        return []
    slices = max(2, min(MAX_BOUNDS**2, (size["chars"] or 0) // slice_chars + 1))
    steps = [i / slices for i in range(1, slices)]
    found = docs.agg(F.percentile_approx("key", steps, F.lit(20 * slices)).alias("x")).first()["x"]
    return sorted({size["first"], *found})


def _slice_of(key: Column, bounds: list[int]) -> Column:
    """Number of the last bound that is not above the key, looked up in two steps."""
    parts = [bounds[i : i + MAX_BOUNDS] for i in range(0, len(bounds), MAX_BOUNDS)]
    longs = lambda values: F.array(*[F.lit(v).cast("bigint") for v in values])
    part = F.size(F.filter(longs([p[0] for p in parts]), lambda b: b <= key)) - 1
    own = F.array(*[longs(p) for p in parts])[part]
    return part * MAX_BOUNDS + F.size(F.filter(own, lambda b: b <= key)) - 1


def with_next_text(docs: DataFrame, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """``doc_id, text`` and ``next_text``, that of the next row by ``doc_id``; after the last comes the first.

    Rows without id come first, equal ids are ordered by text; a single row is its own next one. The texts
    are shuffled once, by slices of the id; the first row of a slice is also sent to the slice before.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("key"))
    bounds = _bounds(keyed, slice_chars)
    if not bounds:
        return keyed.select("doc_id", "text", F.col("text").alias("next_text"))
    own = _slice_of(F.col("key"), bounds)
    last = len(bounds) - 1
    before = F.when(F.col("slice") == 0, F.lit(last)).otherwise(F.col("slice") - 1)
    heads = F.col("key").isin(bounds) if len(bounds) <= MAX_BOUNDS else F.array_contains(F.array(*[F.lit(b) for b in bounds]), F.col("key"))
    places = F.when(heads, F.array(F.struct(F.col("slice").alias("at"), F.lit(False).alias("guest")), F.struct(before.alias("at"), F.lit(True).alias("guest")))).otherwise(
        F.array(F.struct(F.col("slice").alias("at"), F.lit(False).alias("guest")))
    )
    placed = keyed.withColumn("slice", own.cast("int")).select("doc_id", "text", "key", F.inline(places))
    order = Window.partitionBy("at").orderBy("guest", "key", "text")
    return placed.withColumn("next_text", F.lead("text").over(order)).where("not guest").select("doc_id", "text", "next_text")


def edited_text(text: Column, following: Column) -> Column:
    """The last quarter of the code points replaced by as many of the next text, or all of it."""
    quarter = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - quarter), F.substring(following, F.lit(1), quarter))


def op8_spotsigs(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint beside that of its edited text and of the next document."""
    rows = with_next_text(read_table(spark, sf_dir, "documents"))
    edited = rows.withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    signed = edited.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        spots(F.col("text")).alias("own"),
        spots(F.col("edited")).alias("changed"),
        spots(F.col("next_text")).alias("following"),
    )
    return signed.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint_text(F.col("own")).alias("fingerprint"),
        fingerprint_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
        length_class(F.size("own")).alias("length_class"),
    )
