"""Joins against a side that is usually small, safe when it is not and when one key is hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repomine.functions.buckets import bucketed

# A side is broadcast only when all its rows were measured to stay below this.
BROADCAST_BYTES = 64 * 1024 * 1024
ROW_OVERHEAD = 64

# Tasks a hot key is spread over. The salted exchanges are plain join exchanges, so adaptive execution
# splits whatever is still too large in one of them.
SALTS = 8
SALTABLE = ("inner", "left", "left_semi", "left_anti")


def fits_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure a side of flat columns: one aggregate over it, one row back."""
    widths = [
        F.coalesce(F.octet_length(name), F.lit(0)) if kind == "string" else F.lit(8)
        for name, kind in df.dtypes
    ]
    total = F.sum(sum(widths, F.lit(ROW_OVERHEAD)).cast("bigint")).alias("bytes")
    return (df.agg(total).first()["bytes"] or 0) <= max_bytes


def salted_join(
    big: DataFrame, small: DataFrame, on: list[str], spread_by: Column, how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Equi-join in which the rows of one key of ``big`` go to ``salts`` places.

    ``spread_by`` must differ between the rows that share a key. The small side is repeated for every salt;
    each row of ``big`` has one salt, so the result is that of the plain join. That holds for joins that
    give rows of ``big`` only with or without partners, not for those that keep rows of ``small``. Spark's
    estimate of a size leaves the repeats out, so the join is asked to sort: it must not be broadcast by it.
    """
    if how not in SALTABLE:
        raise ValueError(f"cannot salt a {how} join")
    salt = F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    repeated = small.withColumn("_salt", every_salt).hint("merge")
    joined = big.withColumn("_salt", salt).join(repeated, [*on, "_salt"], how)
    return joined.drop("_salt")


def small_side_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    spread_by: Column,
    how: str = "inner",
    broadcast: bool | None = None,
) -> DataFrame:
    """Broadcast the small side when it was measured to fit, else join salted. ``None`` measures here."""
    if broadcast is None:
        broadcast = fits_broadcast(small)
    if broadcast:
        return big.join(F.broadcast(small), on, how)
    return salted_join(big, small, on, spread_by, how)


def measured_join(big: DataFrame, other: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Broadcast the other side when it was measured to fit, else shuffle both.

    For sides that may have as many rows as ``big``, of which salted copies would be too many. Both have an
    exchange of their own, so adaptive execution splits a hot key.
    """
    return big.join(F.broadcast(other) if fits_broadcast(other) else other.hint("merge"), on, how)


def keep_repos(table: DataFrame, repos: DataFrame) -> DataFrame:
    """Rows of the given repositories, which were measured to fit a broadcast."""
    ids, on = bucketed(table, repos.select("repo_id"), ["repo_id"])
    return table.join(F.broadcast(ids), on, "left_semi")
