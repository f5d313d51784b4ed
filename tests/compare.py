"""Compare a Spark result with the oracle: columns, row count, values."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float)):
        return float(value)
    return str(value)


def oracle_rows(con, sql: str):
    names = [c[0] for c in con.execute(f"DESCRIBE {sql}").fetchall()]
    return names, con.execute(sql).fetchall()


def differences(spark_df, con, sql: str) -> list[str]:
    names, wanted = oracle_rows(con, sql)
    if sorted(spark_df.columns) != sorted(names):
        return [f"columns {sorted(spark_df.columns)} != {sorted(names)}"]
    order = sorted(names)
    got = [tuple(_cell(r[c]) for c in order) for r in spark_df.collect()]
    at = [names.index(c) for c in order]
    want = [tuple(_cell(r[i]) for i in at) for r in wanted]
    if len(got) != len(want):
        return [f"rows {len(got)} != {len(want)}"]
    key = repr
    return [
        f"{order}: spark {g} oracle {w}"
        for g, w in zip(sorted(got, key=key), sorted(want, key=key))
        if g != w
    ]
