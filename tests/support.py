"""Running a query's SQL on the same tables and comparing rows."""

import glob
import math
import os
from collections import Counter

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.6f}") + 0.0
    if hasattr(value, "is_finite"):  # Decimal
        return float(f"{float(value):.6f}")
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(float(r[i])) if isinstance(r[i], int) and not isinstance(r[i], bool) else plain(r[i]) for i in order) for r in rows)


def from_spark(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def from_sql(sql, folder=DATA):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = con.execute(sql)
    return sorted(c[0] for c in got.description), rows_of([c[0] for c in got.description], got.fetchall())


def check_oracle(spark, query, sql, folder=DATA):
    df = query(spark, folder)
    columns, expected = from_sql(sql, folder)
    assert sorted(df.columns) == columns
    assert from_spark(df) == expected
