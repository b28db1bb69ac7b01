"""Commits and their changed files as two streams."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from repomine.session import configure
from repomine.streaming.refresh import landed_stream, large_commits, mined_stream, run_to_end

START = datetime(2024, 1, 1)
COMMITS = "repo_id string, hash string, parents array<string>, message string, ingested_at timestamp"
CHANGES = "repo_id string, hash string, path string, ingested_at timestamp"


def at(hours):
    return START + timedelta(hours=hours)


def test_joined_streams(spark, tmp_path):
    folders = {"commits": COMMITS, "changes": CHANGES}

    def land(name, *rows):
        spark.createDataFrame(list(rows), folders[name]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")

    for name in folders:
        land(name)
    streams = [landed_stream(spark, f"{tmp_path}/{n}", spark.createDataFrame([], ddl).schema) for n, ddl in folders.items()]
    mined = mined_stream(*streams, ["fix"], 2, late="4 hours", apart="1 hour")

    def advance():
        run_to_end(mined, f"{tmp_path}/rows", f"{tmp_path}/checkpoint")
        rows = spark.read.schema(mined.schema).parquet(f"{tmp_path}/rows")
        return sorted((r["repo_id"], r["hash"], r["files_changed"]) for r in rows.collect())

    def commit(key, hours, message="a fix", parents=("p",), repo="r"):
        return (repo, key, list(parents), message, at(hours))

    land(
        "commits", commit("two", 0), commit("two", 0.5), commit("three", 0), commit("root", 0, parents=()),
        commit("none", 0), commit("plain", 0, "feature"), commit("far", 0), commit("two", 0, repo="s"),
        commit("blank", 0, None),
    )
    land(
        "changes", ("r", "two", "a", at(0)), ("r", "two", "b", at(1)), ("r", "two", "b", at(0.2)),  # delivered twice
        *[("r", "three", p, at(0)) for p in "abc"], *[("r", "root", p, at(0)) for p in "abcd"],
        ("r", "far", "a", at(0)), ("r", "far", "b", at(3)), ("r", None, "x", at(0)), (None, "two", "x", at(0)),
    )
    assert advance() == []  # nothing is behind the horizon yet

    # One stream alone does not close it.
    land("commits", (None, None, None, None, at(10)))
    assert advance() == []
    # Nor does Spark keep how far a single stream had come over a restart: both bring a row.
    land("commits", (None, None, None, None, at(10)))
    land("changes", (None, None, None, at(10)))
    first = [("r", "far", 1), ("r", "none", 0), ("r", "root", 4), ("r", "two", 2), ("s", "two", 0)]
    assert advance() == first

    # Time is at 6 hours: what is older comes too late, what is newer still counts.
    land("commits", commit("late", 1), commit("new", 8))
    land("changes", ("r", "new", "a", at(8)), ("r", "new", "b", at(1)))
    land("commits", (None, None, None, None, at(40)))
    land("changes", (None, None, None, at(40)))
    assert advance() == sorted(first + [("r", "new", 1)])


def test_heartbeats_are_not_commits(spark, tmp_path):
    for name, ddl in (("commits", COMMITS), ("changes", CHANGES)):
        rows = spark.range(3).select(F.lit(None).alias("x"), "id")
        schema = spark.createDataFrame([], ddl).schema
        columns = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name != "ingested_at"]
        rows.select(*columns, F.timestamp_seconds(F.col("id") * 864_000).alias("ingested_at")).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    streams = [
        landed_stream(spark, f"{tmp_path}/{n}", spark.createDataFrame([], d).schema)
        for n, d in (("commits", COMMITS), ("changes", CHANGES))
    ]
    mined = mined_stream(*streams, [""], 2)
    run_to_end(mined, f"{tmp_path}/rows", f"{tmp_path}/checkpoint")
    assert spark.read.schema(mined.schema).parquet(f"{tmp_path}/rows").count() == 0


def test_state_is_not_counted_and_a_join_has_one_store(spark):
    configure(spark)
    assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows") == "false"
    assert spark.conf.get("spark.sql.streaming.join.stateFormatVersion") == "3"


def brute(commits, changes, limit, key):
    """Kept (repo_id, hash, files_changed), row by row."""
    kept = []
    for repo, name, parents, message, when in commits:
        if message and "fix" in message and name is not None:
            own = {
                path for r, h, path, seen in changes
                if h == name and path is not None and (key == ["hash"] or r is not None and r == repo)
                and abs(seen - when) <= timedelta(hours=1)
            }
            if not parents or len(own) <= limit:
                kept.append((repo, name, len(own)))
    return sorted(kept, key=str)


def streamed(spark, top, commits, changes, key, **options):
    top.mkdir()
    end = at(1000)
    tables = {
        "commits": (commits, (None, None, None, None, end), COMMITS),
        "changes": (changes, (None, None, None, end), CHANGES),
    }
    progress, streams = [], []
    for name, (rows, _, ddl) in tables.items():
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{top}/{name}")
        streams.append(landed_stream(spark, f"{top}/{name}", spark.createDataFrame([], ddl).schema))
    if key == ["hash"]:
        streams[1] = streams[1].drop("repo_id")
    mined = mined_stream(*streams, ["fix"], 2, late="4 hours", apart="1 hour", **options)
    for beat in (False, True):
        for name, (_, row, ddl) in tables.items():
            if beat:
                spark.createDataFrame([row], ddl).coalesce(1).write.mode("append").parquet(f"{top}/{name}")
        query = (
            mined.writeStream.format("parquet").option("checkpointLocation", f"{top}/checkpoint")
            .trigger(availableNow=True).start(f"{top}/rows")
        )
        query.awaitTermination()
        progress += query.recentProgress
    rows = spark.read.schema(mined.schema).parquet(f"{top}/rows").collect()
    return sorted(((r["repo_id"], r["hash"], r["files_changed"]) for r in rows), key=str), progress


def test_changes_over_the_edges_of_windows(spark, tmp_path):
    rng = random.Random(5)
    # Half hours: an hour before and after, and the edges of the windows of four hours, are met exactly.
    messages = ["a fix", "a feature", None]
    commits = [
        (
            f"r{i % 3}" if i % 9 else None, f"h{i // 2}", [] if i % 5 == 0 else ["p"], messages[i % 7 % 3],
            at(rng.randrange(1, 40) / 2),
        )
        for i in range(60)
    ]
    times = {h: when for _, h, _, _, when in commits}
    changes = [
        (
            rng.choice(["r0", "r1", "r2", None]), h, rng.choice(["a", "b", "c", "d", None]),
            times[h] + timedelta(hours=rng.randrange(-3, 4) / 2),
        )
        for h in times for _ in range(8)
    ]
    changes = [c for c in changes if c[3] > START] + changes[:20]
    for key in (["hash"], ["repo_id", "hash"]):
        want = brute(commits, changes, 2, key)
        found = large_commits(spark.createDataFrame(changes, CHANGES).select(*key), 3)
        assert max(r["parts"] for r in found.collect()) >= 2
        for name, large in (("whole", None), ("dealt", found)):
            got, _ = streamed(spark, tmp_path / f"{len(key)}_{name}", commits, changes, key, large=large)
            assert got == want
        assert any(n for *_, n in want)


def test_state_is_a_row_for_a_commit_not_for_a_change(spark, tmp_path):
    commits = [("r", f"h{i}", [], "a fix", at(1)) for i in range(10)]
    changes = [("r", f"h{i}", f"p{k}", at(1)) for i in range(10) for k in range(50)]
    got, progress = streamed(spark, tmp_path / "state", commits, changes, ["repo_id", "hash"])
    assert got == sorted(("r", f"h{i}", 50) for i in range(10))
    # The commits seen, and a row for each with its changes; two more are the heartbeats.
    assert sum(o["numRowsUpdated"] for p in progress for o in p["stateOperators"]) <= 2 * 10 + 2 * 2


def test_memory_of_state_is_bounded_for_an_executor(spark):
    configure(spark)
    assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage") == "true"
