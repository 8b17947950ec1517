"""Run queries on Spark and their checks on DuckDB and compare the rows.

``python -m verification.compare [sf_dir] [name ...]``
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

from hearthline.session import local_session
from verification import catalog

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        if Path(f"{sf_dir}/{table}.parquet").exists():
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def rows_of(names: list[str], rows: list) -> list[tuple[str, ...]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "timestamp_ntz": "TIMESTAMP"}


def type_differences(df, description) -> list[str]:
    """Columns whose Spark and DuckDB types do not correspond."""
    sql_types = {d[0]: str(d[1]) for d in description}
    return [
        f"{name}: {kind} vs {sql_types.get(name)}" for name, kind in df.dtypes if TYPES.get(kind) != sql_types.get(name)
    ]


def compare(spark, connection, name: str, sf_dir: str) -> tuple[bool, str]:
    started = time.time()
    df = catalog.QUERIES[name](spark, sf_dir)
    spark_rows = rows_of(df.columns, df.collect())
    spark_seconds = time.time() - started
    started = time.time()
    result = connection.execute(catalog.ORACLES[name])
    names = [d[0] for d in result.description]
    sql_rows = rows_of(names, result.fetchall())
    note = f"{len(spark_rows)} rows, spark {spark_seconds:.1f}s, sql {time.time() - started:.1f}s"
    if sorted(names) != sorted(df.columns):
        return False, f"{note}; columns {sorted(df.columns)} vs {sorted(names)}"
    if type_differences(df, result.description):
        return False, f"{note}; types {type_differences(df, result.description)}"
    if len(sql_rows) != len(spark_rows):
        return False, f"{note}; sql has {len(sql_rows)}"
    different = [(a, b) for a, b in zip(spark_rows, sql_rows) if a != b]
    if different:
        return False, f"{note}; {len(different)} rows differ, {sorted(names)}: {different[0]}"
    return True, note


def main() -> int:
    arguments = sys.argv[1:]
    sf_dir = arguments[0] if arguments else "/root/testdata/sf0.01"
    names = arguments[1:] or list(catalog.QUERIES)
    spark, connection = local_session(), duck(sf_dir)
    failures = 0
    for name in names:
        try:
            good, note = compare(spark, connection, name, sf_dir)
        except Exception as error:  # noqa: BLE001
            good, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        failures += not good
        print(f"{'ok  ' if good else 'FAIL'} {name}: {note}", flush=True)
    print(f"{len(names) - failures} of {len(names)} agree")
    return failures


if __name__ == "__main__":
    raise SystemExit(main())
