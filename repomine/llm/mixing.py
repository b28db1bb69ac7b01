"""Mixing of sources to target weights: how often every document is taken, by pivotal dependent rounding."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repomine.llm.text import drop_shuffles, read_table
from repomine.operators.joins import small_side_join
from repomine.operators.ordering import number_rows
from repomine.session import cut_lineage

# Fixed values of the contract: the weights of the sources in order, repeating, and the most copies of a document.
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3

# A block of the reduction tree has about this many documents, at most so many in the mean.
BLOCK_BITS = 5
# Blocks per source and size class that are left to the last step.
LAST_BITS = 5
# Equal rows are unfolded in runs of this many, each run in a place of its own.
UNFOLD_ROWS = 1 << 16
# Nearer to 0 or 1 a probability is integral.
EPSILON = 1e-12

_WORD = r"[^\x20\x09-\x0D]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _chance(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) * F.lit(2.0**-53)


def _snap(p: Column) -> Column:
    return F.when(p < EPSILON, 0.0).when(p > 1 - EPSILON, 1.0).otherwise(p)


def _open(p: Column) -> Column:
    return (p > 0) & (p < 1)


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``source, source_size`` with ``source_no, target, base, p``.

    Sources in the order of their code points, null last, weigh ``weights`` in turn and share the sum of all
    sizes. A target stops at ``most`` times its source's size; what is above goes to the others by weight
    until none is above. ``base`` copies of every document are certain, one more has the probability ``p``.
    """
    numbered = number_rows(sizes, [F.asc_nulls_last("source")], name="source_no")
    turns = F.array(*map(F.lit, weights))
    sources = cut_lineage(numbered.withColumn("weight", turns[F.pmod(F.col("source_no") - 1, F.lit(len(weights))).cast("int")]))
    cap = F.col("source_size") * most
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    # Words per weight, raised until no further source reaches its cap: one row of sums a round.
    while True:
        over = cap <= level * F.col("weight")
        sums = sources.agg(
            F.sum(F.when(over, cap)).alias("cap"), F.sum(F.when(~over, F.col("weight"))).alias("weight"), F.count_if(over).alias("n"),
        ).first()
        if sums["n"] == stopped or not sums["weight"]:
            break
        stopped, level = sums["n"], (total - (sums["cap"] or 0)) / sums["weight"]
    target = F.least(cap.cast("double"), level * F.col("weight"))
    copies = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    out = sources.withColumn("target", target).withColumn("copies", copies).withColumn("base", F.floor("copies"))
    return out.withColumn("p", _snap(F.col("copies") - F.col("base"))).drop("weight", "copies")


def _settle_pair(seed: int, held: Column, other: Column) -> Column:
    """The probabilities ``held`` and ``other`` after words have moved between two documents until one is integral.

    The words expected of the two together stay, and so does each one's probability in the mean.
    """

    def moved(ways: Column) -> Column:
        gain, loss = ways["gain"], ways["loss"]
        up = _chance(seed, held["h"], other["h"]) * (gain + loss) < loss
        # A settled document has nothing to move.
        return _let(F.when(_open(held["p"]), F.when(up, gain).otherwise(-loss)).otherwise(0.0), lambda words: F.struct(
            _let(held["p"] + words / held["size"], _snap).alias("held"),
            _let(other["p"] - words / other["size"], _snap).alias("other"),
        ))

    ways = F.struct(
        F.least((1 - held["p"]) * held["size"], other["p"] * other["size"]).alias("gain"),
        F.least(held["p"] * held["size"], (1 - other["p"]) * other["size"]).alias("loss"),
    )
    return _let(ways, moved)


def _unit(unit: Column, p: Column) -> Column:
    return F.struct(unit["h"].alias("h"), unit["doc_id"].alias("doc_id"), unit["size"].alias("size"), p.alias("p"))


def _settle_block(seed: int, units: Column) -> Column:
    """``held, done``: the documents of a block paired one after the other; at most ``held`` keeps a fraction."""

    def step(state: Column, unit: Column) -> Column:
        def keep(after: Column) -> Column:
            one, two = _unit(state["held"], after["held"]), _unit(unit, after["other"])
            settled = (after["other"] == 0) | (after["other"] == 1)
            return F.struct(
                F.when(settled, one).otherwise(two).alias("held"),
                F.concat(state["done"], F.array(F.when(settled, two).otherwise(one))).alias("done"),
            )

        return _let(_settle_pair(seed, state["held"], unit), keep)

    start = F.struct(units[0].alias("held"), F.slice(units, 1, 0).alias("done"))
    return F.aggregate(F.slice(units, F.lit(2), F.greatest(F.size(units) - 1, F.lit(0))), start, step)


def _settle_rest(seed: int, units: Column) -> Column:
    """All ``units`` of a source settled, the largest first, each against all smaller ones as one bundle.

    What the rounding of a document gains or loses goes to the smaller ones, whose probabilities ``p`` become
    ``add + times * p``. So the words taken end within about the smallest document of what was expected.
    """

    def step(state: Column, unit: Column) -> Column:
        def sized(now: Column) -> Column:
            p, size, mass, room = now["p"], unit["size"], now["mass"], now["room"]

            def settle(words: Column) -> Column:
                # Where the smaller ones could not give or take enough, chance decides about the rest.
                moved = _let(_let(p + words / size, _snap), lambda q: F.when(_open(q), (now["again"] < q).cast("double")).otherwise(q))
                shrink = F.when(words > 0, 1 - words / F.greatest(mass, F.lit(EPSILON))).otherwise(
                    1 + words / F.greatest(room - mass, F.lit(EPSILON)))
                return _let(shrink, lambda k: F.struct(
                    F.when(words > 0, state["add"] * k).otherwise(1 - (1 - state["add"]) * k).alias("add"),
                    (state["times"] * k).alias("times"), (mass - words).alias("mass"), room.alias("room"),
                    F.concat(state["done"], F.array(_unit(unit, moved))).alias("done"),
                ))

            def choose(ways: Column) -> Column:
                gain, loss = ways["gain"], ways["loss"]
                return _let(F.when(now["chance"] * (gain + loss) < loss, gain).otherwise(-loss), settle)

            gain, loss = F.least((1 - p) * size, mass), F.least(p * size, room - mass)
            return _let(F.struct(F.greatest(gain, F.lit(0.0)).alias("gain"), F.greatest(loss, F.lit(0.0)).alias("loss")), choose)

        def bound(p: Column) -> Column:
            return _let(
                F.struct(
                    p.alias("p"), (state["mass"] - p * unit["size"]).alias("mass"), (state["room"] - unit["size"]).alias("room"),
                    _chance(seed + 1, unit["h"]).alias("chance"), _chance(seed + 2, unit["h"]).alias("again"),
                ),
                sized,
            )

        within = F.least(F.greatest(state["add"] + state["times"] * unit["p"], F.lit(0.0)), F.lit(1.0))
        return _let(_let(within, _snap), bound)

    def sums(value: Callable[[Column], Column]) -> Column:
        return F.aggregate(units, F.lit(0.0), lambda s, u: s + value(u))

    start = F.struct(
        F.lit(0.0).alias("add"), F.lit(1.0).alias("times"), sums(lambda u: u["p"] * u["size"]).alias("mass"),
        sums(lambda u: u["size"].cast("double")).alias("room"), F.slice(units, 1, 0).alias("done"),
    )
    return F.aggregate(units, start, step, lambda s: s["done"])


def _unfolded(rows: DataFrame) -> DataFrame:
    """``n`` equal rows for each, numbered by ``i``. Very many are dealt out in runs first."""
    few = rows.where(F.col("n") <= UNFOLD_ROWS).withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")))
    many = rows.where(F.col("n") > UNFOLD_ROWS)
    runs = many.withColumn("run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / UNFOLD_ROWS))))
    first = F.col("run") * UNFOLD_ROWS
    dealt = runs.repartition(*rows.columns, "run").withColumn(
        "i", F.explode(F.sequence(first + 1, F.least(first + UNFOLD_ROWS, F.col("n")))))
    return few.union(dealt.drop("run")).drop("n")


def _settled(units: DataFrame, largest: int, seed: int) -> DataFrame:
    """``source_no, doc_id, size, extra``: 1 for the documents of which one more copy is taken, else 0.

    ``units`` has ``source_no, h, doc_id, size, p``, and no source has more than ``largest`` in a class of
    sizes (a power of two). Blocks of documents are told by the first bits of ``h``; each leaves one fraction,
    and the fractions of 32 blocks form a block of the next step, until a class has 32 blocks or fewer.
    """
    found: list[DataFrame] = []
    units = units.withColumn("class", F.length(F.bin("size")))
    keys = ["source_no", "class"]
    unit = F.struct("h", "doc_id", "size", "p").alias("unit")
    if largest > 1 << (LAST_BITS + 1):
        first = max(LAST_BITS, math.ceil(math.log2(largest)) - BLOCK_BITS)
        for bits in [*range(first, LAST_BITS, -BLOCK_BITS), LAST_BITS]:
            blocks = units.groupBy(*keys, F.shiftrightunsigned("h", 64 - bits).alias("block")).agg(
                F.array_sort(F.collect_list(unit)).alias("units"))
            step = cut_lineage(blocks.select(*keys, _settle_block(seed, F.col("units")).alias("s")))
            drop_shuffles(units.sparkSession)
            held = step.select(*keys, "s.held.*")
            found += [step.select(*keys, F.inline("s.done")), held.where(~_open(F.col("p")))]
            units = held.where(_open(F.col("p"))).select("source_no", "h", "doc_id", "size", "p", "class")
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("least"), "h", "doc_id", "size", "p"))),
        lambda u: _unit(u, u["p"]),
    )
    last = units.groupBy("source_no").agg(ordered.alias("units"))
    found.append(last.select("source_no", F.inline(_settle_rest(seed, F.col("units")))).withColumn("class", F.lit(0)))
    columns = ["source_no", "doc_id", "size", F.col("p").cast("bigint").alias("extra")]
    return reduce(DataFrame.union, [f.select(*columns) for f in found])


def mix_sources(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES, seed: int = 11) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, copies, taken``.

    ``size`` is the number of words of the text. The targets of :func:`source_targets` give every document of
    a source the same expected number of copies. Its whole part is certain; the fraction is rounded to 0 or 1
    dependently: documents of a source and of about one size meet in blocks, words move at random between two
    of them until the probability of one is integral, and what is left of the blocks is reduced the same way
    in a tree. The last fractions of a source are settled from the largest document to the smallest. So the
    words taken of a source (``taken`` is ``copies * size``) end within about its smallest documents of the
    target, which a draw per document would miss by the size of the largest. Chances are hashes of ``seed``,
    the id, source, size and the number among equal rows, so reruns agree.

    No step holds more of a source than a block, and the last one 32 documents for each power of two of the
    size. A null or empty text has size 0 and is taken 0 times its 0 words (``copies`` is the whole part). A
    null source is a source, the last. Rows without id, and repeated rows, are documents like any other.
    Other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("bigint")
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), size.alias("size"))
    equal = cut_lineage(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")))
    drop_shuffles(spark)
    sizes = cut_lineage(equal.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))
    # Null is a key here.
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source_key")
    sources = cut_lineage(source_targets(sizes, weights, most))
    known = sources.select(key, "source_no", F.col("p"))
    spread = F.struct("doc_id", "size")
    equal = small_side_join(equal.select("*", key), known, ["source_key"], spread)
    equal = cut_lineage(equal.select("source_no", "doc_id", "size", "n", "p"))

    fractional = _open(F.col("p")) & (F.col("size") > 0)
    classes = equal.where(fractional).groupBy("source_no", F.length(F.bin("size")).alias("class")).agg(F.sum("n").alias("n"))
    largest = classes.agg(F.max("n")).first()[0] or 0
    h = F.xxhash64(F.lit(seed), "source_no", "doc_id", "size", "i").alias("h")
    units = _unfolded(equal.where(fractional)).select("source_no", h, "doc_id", "size", "p")
    certain = _unfolded(equal.where(~fractional)).select("source_no", "doc_id", "size", F.lit(0).cast("bigint").alias("extra"))
    every = _settled(units, largest, seed).union(certain)
    out = small_side_join(every, sources.drop("p"), ["source_no"], spread)
    copies = (F.col("base") + F.col("extra")).alias("copies")
    return out.select(
        "doc_id", "source", "size", "source_size", "target", copies, (copies * F.col("size")).alias("taken"),
    )


def op11_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents"))
