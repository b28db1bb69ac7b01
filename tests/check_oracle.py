"""Run every registered query against its SQL: ``python tests/check_oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

import __spark_entry__ as spark_entry  # noqa: E402
from repomine.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(str(row[i]) for i in order) for row in rows)


def compare(spark, connection, sf_dir: str, name: str) -> tuple[int, str]:
    """Number of rows, and what differs or nothing when the rows agree."""
    df = spark_entry.queries()[name](spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    relation = connection.sql(spark_entry.oracle_sql()[name])
    theirs = rows_of(relation.columns, relation.fetchall())
    if sorted(df.columns) != sorted(relation.columns):
        return len(ours), f"columns {sorted(df.columns)} != {sorted(relation.columns)}"
    if ours == theirs:
        return sum(ours.values()), ""
    return sum(ours.values()), (
        f"{sum(ours.values())} rows against {sum(theirs.values())};"
        f" only here {list((ours - theirs).items())[:3]}; only there {list((theirs - ours).items())[:3]}"
    )


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    bad = 0
    for name in sys.argv[2:] or spark_entry.oracle_sql():
        start = time.time()
        try:
            rows, found = compare(spark, connection, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            rows, found = 0, f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name}: {rows} rows, {time.time() - start:.2f}s {found}", flush=True)
    print(f"{bad} failed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
