"""Compare Spark results with DuckDB: python -m workloads.check [folder] [name ...].

CHECK_SLICE_ROWS lowers the rows a task may sort per key, so that the paths for very large
keys run on small data.
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

from arcline.session import SLICE_ROWS_CONF, build_session

from .catalog import CHECKS, QUERIES
from .views import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return connection


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns and rows in a fixed order, every value as text."""
    def text(value):
        if value is None or value is pd.NA or value is pd.NaT or value != value:
            return "null"
        if isinstance(value, (bool,)):
            return str(int(value))
        if isinstance(value, (int, float)) or hasattr(value, "dtype"):
            return f"{float(value):.6f}"
        return str(value)

    frame = frame[sorted(frame.columns)].map(text)
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def difference(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} vs {sorted(sql_frame.columns)}"
    if len(spark_frame) != len(sql_frame):
        return f"rows {len(spark_frame)} vs {len(sql_frame)}"
    left, right = canonical(spark_frame), canonical(sql_frame)
    unequal = (left != right).any(axis=1)
    if not unequal.any():
        return None
    at = unequal.idxmax()
    bad = [c for c in left.columns if left[c][at] != right[c][at]]
    return f"{int(unequal.sum())} rows differ, first: " + ", ".join(
        f"{c}: {left[c][at]} vs {right[c][at]}" for c in bad
    )


def main(arguments: list[str]) -> int:
    folder = arguments[0] if arguments else "/root/testdata/sf0.01"
    names = arguments[1:] or list(QUERIES)
    spark = build_session("check", master="local[8]", shuffle_partitions=8)
    if "CHECK_SLICE_ROWS" in os.environ:
        spark.conf.set(SLICE_ROWS_CONF, os.environ["CHECK_SLICE_ROWS"])
    connection = connect(folder)
    failed = 0
    for name in names:
        start = time.time()
        try:
            got = QUERIES[name](spark, folder).toPandas()
            took = time.time() - start
            if name not in CHECKS:
                verdict = "rows only" if len(got) else "EMPTY"
            else:
                verdict = difference(got, connection.execute(CHECKS[name]).df()) or "equal"
        except Exception as error:  # one broken query must not hide the others
            took, got, verdict = time.time() - start, [], f"ERROR {str(error)[:600]}"
        failed += verdict not in ("equal", "rows only")
        print(f"{name}: {verdict} ({len(got)} rows, {took:.1f} s)", flush=True)
        spark.catalog.clearCache()
    print(f"{len(names)} queries, {failed} not equal")
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
