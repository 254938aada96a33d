"""Runs registered queries next to their SQL: ``python -m checks.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time
import traceback

import duckdb
from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


KINDS = {
    "tinyint": "int", "smallint": "int", "int": "int", "integer": "int", "bigint": "int",
    "double": "float", "float": "float", "string": "text", "varchar": "text",
    "timestamp": "time", "timestamp_ntz": "time",
}


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def _rows(columns: list[str], rows) -> list[tuple]:
    places = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(_cell(r[i]) for i in places) for r in rows), key=repr)


def difference(frame: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs between a Spark result and a SQL result, or None."""
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} and {sorted(names)}"
    kinds = {c[0]: str(c[1]) for c in cursor.description}
    for name, kind in frame.dtypes:
        if KINDS.get(kind.split("(")[0], kind) != KINDS.get(kinds[name].lower().split("(")[0], kinds[name]):
            return f"{name} is {kind}, expected {kinds[name]}"
    expected = _rows(names, cursor.fetchall())
    found = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    if len(found) != len(expected):
        return f"{len(found)} rows, expected {len(expected)}"
    for a, b in zip(found, expected):
        if a != b:
            return f"{a}\n  expected {b}"
    return None


def main(args: list[str]) -> None:
    from checks.oracle import oracle_sql
    from checks.queries import queries
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark, con, sql = session(), database(sf_dir), oracle_sql()
    for name, build in queries().items():
        if args[1:] and name not in args[1:]:
            continue
        start = time.time()
        try:
            frame = build(spark, sf_dir)
            note = difference(frame, con, sql[name]) if name in sql else f"no SQL, {frame.count()} rows"
        except Exception:
            note = traceback.format_exc(limit=-3)[-1500:]
        print(f"{name}: {note or 'equal'} ({time.time() - start:.1f} s)", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
