"""Compare every registered query with its SQL check in DuckDB.

Run as a script: ``python tests/compare.py [folder] [query ...]``.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def _plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, pd.Timestamp):
        return value.to_pydatetime()
    return value


def _rows(frame_columns, rows):
    order = sorted(range(len(frame_columns)), key=lambda i: frame_columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=repr)


_SPARK_TYPES = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "VARCHAR": "string",
    "DOUBLE": "double",
    "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz",
}


def difference(df, connection, sql: str) -> str | None:
    """None if both give the same rows, else what differs first."""
    result = connection.sql(sql)
    names, types = list(result.columns), [str(t) for t in result.types]
    want_schema = {n: _SPARK_TYPES.get(t, t) for n, t in zip(names, types)}
    got_schema = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if want_schema != got_schema:
        names = sorted(set(want_schema) | set(got_schema))
        return "schema " + str({n: (got_schema.get(n), want_schema.get(n)) for n in names
                                if got_schema.get(n) != want_schema.get(n)})
    want = _rows(names, result.fetchall())
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if len(want) != len(got):
        return f"{len(got)} rows instead of {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"row {str(a)[:400]} instead of {str(b)[:400]}"
    return None


def main(folder: str, names: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    queries, checks = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in checks:
                found = difference(df, connection, checks[name])
            else:
                found = None if df.count() >= 0 else "no rows"
        except Exception as error:  # report and go on
            found = f"{type(error).__name__}: {str(error)[:800]}"
        bad += found is not None
        kind = "" if name in checks else " (rows only)"
        print(f"{'ok ' if found is None else 'BAD'} {name}{kind} {time.time() - start:.1f}s {found or ''}", flush=True)
    print(f"{bad} of {len(names or queries)} differ")
    return bad


if __name__ == "__main__":
    arguments = sys.argv[1:] or ["/root/testdata/sf0.01"]
    sys.exit(min(main(arguments[0], arguments[1:]), 1))
