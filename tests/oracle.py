"""Compare registered queries with their SQL on the given tables.

Run as a script for a report: ``python tests/oracle.py [folder] [query ...]``.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


SAME_TYPE = {
    "string": "VARCHAR", "int": "INTEGER", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        path = Path(folder) / f"{table}.parquet"
        if path.exists():
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return float(value) + 0.0
    if isinstance(value, pd.Timestamp):
        return value.isoformat()[:19]
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_cell(r[i]) for i in order) for r in rows),
        key=lambda t: tuple((v is None, str(type(v)), v if v is not None else 0) for v in t),
    )


def compare(spark_df, relation) -> str | None:
    """None if both have the same columns and the same rows, else what differs first."""
    left_columns, right_columns = spark_df.columns, relation.columns
    if sorted(left_columns) != sorted(right_columns):
        return f"columns {sorted(left_columns)} != {sorted(right_columns)}"
    kinds = {
        c: (k, str(t)) for (c, k), t in zip(sorted(spark_df.dtypes), [t for _, t in sorted(zip(right_columns, relation.types))])
    }
    odd = {c: k for c, k in kinds.items() if SAME_TYPE.get(k[0], k[0].upper()) != k[1]}
    if odd:
        return f"types differ: {odd}"
    left = _rows(left_columns, [tuple(r) for r in spark_df.collect()])
    right = _rows(right_columns, relation.fetchall())
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)} rows"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return f"{len(bad)} of {len(left)} rows differ ({sorted(left_columns)}), first {bad[0]}"
    return None


def main() -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from __spark_entry__ import oracle_sql, queries
    from sitepanel.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con, failures = connect(folder), 0
    oracles = oracle_sql()
    for name, run in queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            frame = run(spark, folder)
            if name in oracles:
                problem = compare(frame, con.sql(oracles[name]))
                if problem is None and not frame.take(1):
                    problem = "no rows"
            else:
                problem = f"no oracle, {frame.count()} rows"
        except Exception as error:  # report every query, whatever it raises
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failures += problem is not None and not problem.startswith("no oracle")
        print(f"{name:28s} {time.time() - start:6.2f}s  {problem or 'ok'}", flush=True)
    print("failures:", failures)
    return failures


if __name__ == "__main__":
    sys.exit(main())
