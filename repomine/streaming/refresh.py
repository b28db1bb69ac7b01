"""Newly landed commits as a stream."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from repomine.functions.text import contains_any, truncate_text
from repomine.operators.diffs import max_files
from repomine.operators.history import new_commits, parent_columns
from repomine.schemas import COMMIT_KEY, COMMITS, commit_key
from repomine.sources.tables import land

# Changes of a commit in one row of state: some 100 bytes each, held in memory several times over.
MOST_CHANGES = 200_000


def landed_stream(
    spark: SparkSession, path: str, schema: StructType = COMMITS, fmt: str = "parquet", max_files: int = 10_000
) -> DataFrame:
    """Files of a landing folder as a stream, so many per batch."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files).load(path)


def matching_stream(
    commits: DataFrame, keywords: Sequence[str], ingested: str | None = None, horizon: str | None = None
) -> DataFrame:
    """Commits with any keyword, each once.

    The keys seen are the state, and without a horizon they are kept for ever. Where files are delivered
    again only within a known time, name the column of the ingest time and that time. Author time must not
    be used for it: it is arbitrary in a history.
    """
    hits = commits.where(contains_any(F.col("message"), keywords))
    if ingested and horizon:
        return hits.withWatermark(ingested, horizon).dropDuplicatesWithinWatermark(COMMIT_KEY)
    return hits.dropDuplicates(COMMIT_KEY)


def mined_stream(
    commits: DataFrame, changes: DataFrame, keywords: Sequence[str], max_modified_files: int,
    ingested: str = "ingested_at", late: str = "1 day", apart: str = "1 hour",
    large: DataFrame | None = None,
) -> DataFrame:
    """Commits with any keyword that change at most so many files, with ``files_changed``; roots always pass.

    Two streams with an ingest time: commits, and changed files (``[repo_id,] hash, path``) that are ingested
    at most ``apart`` before or after their commit. Rows come at most ``late`` behind the newest of their
    stream; later ones are dropped, of the changes those whose window is closed. Repeated deliveries count once.

    Commits and changes of a key meet in one grouping by windows of ingest time, so state is a row for each key
    and window, not for each change. A window is as long as ``late`` (at least twice ``apart``) and takes the
    changes within ``apart`` of its ends too. Its commits are given out once both streams are past its end by
    ``late`` and ``apart``, and then its state goes, so state is bounded by what is ingested in that time. Time
    moves by the rows of either stream, of the commits by those with a keyword; a row without hash is a
    heartbeat, which only moves it. After a restart both streams must bring a row before it moves again.

    A row holds all changes of a commit. Name those that have too many for that in ``large``, as
    :func:`large_commits` finds them: they are dealt over ``parts`` by path and added up in a second grouping.
    The table must stay the same as long as the checkpoint is used.
    """
    key = commit_key(changes)
    hits = parent_columns(commits).where(contains_any(F.col("message"), keywords) | F.col("hash").isNull())
    hits = hits.select(*COMMIT_KEY, "is_root", truncate_text(F.col("message")).alias("message"), ingested)
    hits = hits.withWatermark(ingested, late).dropDuplicatesWithinWatermark(COMMIT_KEY)
    # As values, not as conditions on rows: those would be moved before the watermark, and heartbeats be lost.
    hit = F.when(F.col("hash").isNotNull(), F.struct(*hits.columns))
    known = functools.reduce(operator.and_, [F.col(c).isNotNull() for c in [*key, "path"]])
    at, none = F.col(ingested), F.lit(None)
    file = F.when(known, F.struct("path", at.alias("at")))
    files = changes.withWatermark(ingested, late).withColumn("file", file)
    if large is not None:
        hits, files = (df.join(F.broadcast(large), key, "left") for df in (hits, files))
    parts = F.lit(1) if large is None else F.coalesce("parts", F.lit(1))
    every, part = F.explode(F.sequence(F.lit(0), parts - 1)), F.pmod(F.xxhash64("file.path"), parts)
    rows = hits.select(*key, at, hit.alias("hit"), none.alias("file"), every.alias("part")).unionAll(
        files.select(*key, at, none.alias("hit"), "file", part.alias("part"))
    )
    around, near = _micros(commits.sparkSession, apart), F.expr(f"INTERVAL {apart}")
    step = max(_micros(commits.sparkSession, late), 2 * around, 1)
    rows = rows.withColumn("window", F.window(at, *[f"{n} microseconds" for n in (step + 2 * around, step, -around)]))
    # The windows overlap; a commit is in the one that has all that is near it.
    inside = (at >= F.col("window.start") + near) & (at < F.col("window.end") - near)
    met = rows.groupBy(*key, "part", "window").agg(
        F.collect_list(F.when(inside, F.col("hit"))).alias("hits"), F.collect_set("file").alias("files")
    )
    met = met.select("window", F.explode("hits").alias("hit"), "files")
    one = F.col(f"hit.{ingested}")
    found = F.filter("files", lambda f: f["at"].between(one - near, one + near))
    paths = F.array_distinct(F.transform(found, lambda f: f["path"]))
    counted = met.select("window", "hit", F.size(paths).cast("bigint").alias("files_changed"))
    if large is not None:
        counted = counted.groupBy("window", "hit").agg(F.sum("files_changed").alias("files_changed"))
    return max_files(counted.select("hit.*", "files_changed"), max_modified_files)


def large_commits(changes: DataFrame, most: int = MOST_CHANGES) -> DataFrame:
    """Commits with more changes, repeats included, than a row of state should hold, and ``parts`` that do."""
    # Keys are counted by 65,536 buckets first, which hardly shuffles; only those of full buckets by themselves.
    key, parts = commit_key(changes), F.count("*").alias("parts")
    placed = changes.select(*key, F.pmod(F.xxhash64(*key), F.lit(1 << 16)).alias("_bucket"))
    full = placed.groupBy("_bucket").agg(parts).where(F.col("parts") > most).select("_bucket")
    some = placed.join(F.broadcast(full), "_bucket", "left_semi")
    counts = some.groupBy(*key).agg(parts).where(F.col("parts") > most)
    return counts.withColumn("parts", F.ceil(F.col("parts") / most).cast("int"))


def _micros(spark: SparkSession, interval: str) -> int:
    """A month counts 31 days, as in a watermark."""
    start = "TIMESTAMP '2000-01-01'"
    return spark.sql(f"SELECT timestampdiff(MICROSECOND, {start}, {start} + INTERVAL {interval})").first()[0]


def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process everything that has landed, append it to a Parquet folder, and stop."""
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()


def append_unseen(stream: DataFrame, table: str, checkpoint: str) -> None:
    """Append to a commits table what it does not hold yet, batch by batch, and stop.

    The table itself is the memory, so there is no state to grow, and a batch that is repeated after a
    failure adds nothing twice. A batch reads the keys of the folders it touches.
    """

    def append(batch: DataFrame, _: int) -> None:
        held = batch.sparkSession.read.schema(batch.schema).parquet(table)
        # Used twice: for the folders it touches and for its rows.
        batch.persist(StorageLevel.DISK_ONLY)
        try:
            land(new_commits(held, batch), table)
        finally:
            batch.unpersist()

    # The first run starts from an empty table; an existing one is left as it is.
    land(stream.sparkSession.createDataFrame([], stream.schema), table, mode="ignore")
    query = (
        stream.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
