"""Tables written in an order, with a sparse index of it, so that rows are found by number or by key."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repomine.operators.ordering import SLICE_ROWS

# Rows between two entries of the index.
EVERY = 1_000
# Where a row lies: the part in the upper bits and the place within it in the lower 33.
_AT = "_at"
_PART_BITS = 33


def _sorts(order: Sequence[str]) -> list[Column]:
    return [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]


def _names(order: Sequence[str]) -> list[str]:
    return [c.removeprefix("-") for c in order]


def _part(at: Column) -> Column:
    return F.shiftright(at, _PART_BITS)


def write_in_order(df: DataFrame, order: Sequence[str], path: str, every: int = EVERY, parts: int = 0) -> None:
    """Write ``df`` below ``path``, sorted by the columns ``order`` (``-`` before a name: descending).

    ``rows`` are range-sorted parts, each in the order. ``index`` has an entry for every block of ``every``
    rows of a part: the key of its first row, that row's number in the whole order (from 1), its file and
    the rows it has. The index is combined from partial counts; windows hold the blocks of one part, or one
    row per part. Nulls come first, or last in a descending column. Rows of equal keys lie in any order. An
    empty table gives an empty index. The names ``_at`` and ``first_row`` are kept for this table's own use.
    """
    spark = df.sparkSession
    n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.count() // SLICE_ROWS + 1)
    placed = df.repartitionByRange(n, *_sorts(order)).sortWithinPartitions(*_sorts(order))
    placed = placed.withColumn(_AT, F.monotonically_increasing_id())
    placed.write.parquet(f"{path}/rows")

    rows = spark.read.schema(placed.schema).parquet(f"{path}/rows")
    keys = _names(order)
    place = F.col(_AT).bitwiseAND(F.lit((1 << _PART_BITS) - 1))
    blocks = rows.groupBy(
        _part(F.col(_AT)).alias("part"), F.floor(place / every).alias("block"), F.col("_metadata.file_path").alias("file")
    ).agg(F.min(_AT).alias("first_at"), F.count("*").alias("rows"), F.min_by(F.struct(*keys), _AT).alias("key"))
    # One row per part, so this window is as long as the table has parts.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.groupBy("part").agg(F.sum("rows").alias("size"))
    befores = sizes.select("part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    within = F.col("first_at") - F.shiftleft("part", _PART_BITS)
    index = blocks.join(befores, "part").select(
        (F.col("before") + within + 1).alias("first_row"), "rows", "part", "first_at", "file", "key"
    )
    index.sort("first_row").write.parquet(f"{path}/index")


def _index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/index")


def read_in_order(spark: SparkSession, path: str) -> DataFrame:
    """All rows of such a table with ``row_number``, from 1, whatever the order they are read in."""
    starts = _index(spark, path).groupBy("part").agg(F.min(F.col("first_row") - F.col("first_at")).alias("_start"))
    rows = spark.read.parquet(f"{path}/rows").withColumn("part", _part(F.col(_AT)))
    return rows.join(starts, "part").withColumn("row_number", F.col("_start") + F.col(_AT)).drop("part", "_start", _AT)


def read_rows(spark: SparkSession, path: str, first: int, last: int, every: int = EVERY) -> DataFrame:
    """Rows number ``first`` to ``last`` with ``row_number``; only the files that hold them are opened.

    What comes to the driver is an entry per block met: as many as ``every`` goes into the rows asked for,
    and two for each file met. ``every`` is the one the table was written with, or a greater one.
    """
    met = (F.col("first_row") <= last) & (F.col("first_row") > first - every) & (F.col("first_row") + F.col("rows") > first)
    found = _index(spark, path).where(met).select("first_row", "first_at", "part", "rows", "file").collect()
    if not found:
        rows = spark.read.parquet(f"{path}/rows").limit(0)
        return rows.withColumn("row_number", F.lit(None).cast("bigint")).drop(_AT)
    starts = sorted({(r["part"], r["first_row"] - r["first_at"]) for r in found})
    rows = spark.read.parquet(*sorted({r["file"] for r in found}))
    # Bounds on what is stored, so that row groups are skipped too.
    low, high = min(r["first_at"] for r in found), max(r["first_at"] + r["rows"] for r in found)
    rows = rows.where(F.col(_AT).between(low, high)).withColumn("part", _part(F.col(_AT)))
    small = F.broadcast(spark.createDataFrame(starts, "part bigint, _start bigint"))
    numbered = rows.join(small, "part").withColumn("row_number", F.col("_start") + F.col(_AT))
    return numbered.where(F.col("row_number").between(first, last)).drop("part", "_start", _AT)


def _before(left: Sequence[Column], right: Sequence[Column], order: Sequence[str]) -> Column:
    """Whether the key ``left`` comes before ``right`` in the order, nulls included."""
    cases, same = [], F.lit(True)
    for a, b, name in zip(left, right, order):
        if name.startswith("-"):
            less = F.coalesce(a > b, a.isNotNull() & b.isNull())
        else:
            less = F.coalesce(a < b, a.isNull() & b.isNotNull())
        cases.append(same & less)
        same = same & a.eqNullSafe(b)
    return functools.reduce(operator.or_, cases)


def row_of(spark: SparkSession, path: str, key: Sequence, order: Sequence[str], every: int = EVERY) -> int:
    """Number of the first row whose key is not before ``key``; one more than the table has if there is none.

    The index is asked for the last block that begins before the key, and only that block is read.
    """
    names, asked = _names(order), [F.lit(v) for v in key]
    index = _index(spark, path)
    begins = _before([F.col(f"key.{n}") for n in names], asked, order)
    start = index.where(begins).agg(F.max("first_row").alias("row")).first()["row"]
    if start is None:
        return 1
    block = read_rows(spark, path, start, start + every - 1, every)
    return start + block.where(_before([F.col(n) for n in names], asked, order)).count()
