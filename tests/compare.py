"""Run queries in Spark and their SQL in DuckDB, and compare rows.

    python tests/compare.py SF_DIR [NAME...]
"""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    """A value as both engines would print it; floats to 9 significant digits."""
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if hasattr(x, "replace") and hasattr(x, "tzinfo"):
        return x.replace(tzinfo=None)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def differences(df, sql: str, con) -> str:
    """Empty if both give the same columns and rows, else what differs first."""
    mine = rows_of(df.columns, df.collect())
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    theirs = rows_of(names, found.fetchall())
    if len(mine) != len(theirs):
        return f"{len(mine)} rows and {len(theirs)}"
    for a, b in zip(mine, theirs, strict=True):
        if a != b:
            return f"{sorted(names)}: {a} and {b}"
    return ""


def main(sf_dir: str, names: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sql, bad = duck(sf_dir), entry.queries(), entry.oracle_sql(), 0
    for name in names or queries:
        began = time.time()
        try:
            said = differences(queries[name](spark, sf_dir), sql[name], con) if name in sql else f"(no SQL) {queries[name](spark, sf_dir).count()} rows"
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(said) and not said.startswith("(no SQL)")
        print(f"{name}: {said or 'same'} [{time.time() - began:.1f} s]", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1], sys.argv[2:])))
