"""Compare a Spark result with a DuckDB oracle, order-insensitively."""

from __future__ import annotations

import glob
import os

import duckdb


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def rows_of(df, order):
    data = df[order].astype(object)
    data = data.where(data.notna(), None)
    return sorted((tuple(map(str, r)) for r in data.itertuples(index=False, name=None)))


def mismatch(spark_df, con, sql) -> str | None:
    got = spark_df.toPandas()
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    order = sorted(got.columns)
    for c in order:  # whole numbers with nulls: pandas holds them as floats on the Spark side
        if got[c].dtype.kind == "f" and want[c].dtype.kind in "iu":
            got[c] = got[c].astype("Int64")
    kinds = [(c, str(got[c].dtype), str(want[c].dtype)) for c in order if got[c].dtype != want[c].dtype]
    a, b = rows_of(got, order), rows_of(want, order)
    if len(a) != len(b):
        return f"{len(a)} rows vs {len(b)}: {sorted(set(a) - set(b))[:2]} / {sorted(set(b) - set(a))[:2]}"
    if a != b:
        return f"values differ: {sorted(set(a) - set(b))[:2]} vs {sorted(set(b) - set(a))[:2]}"
    kinds = [k for k in kinds if "object" not in k[1:] and "str" not in k[1:]]
    return f"types {kinds}" if kinds else None
