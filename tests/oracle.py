"""Runs queries and their SQL twins side by side; also a script: python -m tests.oracle NAME..."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(7) + 0.0
    text = df.astype(object).where(df.notna(), None).map(lambda v: f"{v:.7g}" if isinstance(v, float) and not v.is_integer() else str(int(v)) if isinstance(v, float) else str(v))
    return text.sort_values(list(text.columns)).reset_index(drop=True)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    a, b = canonical(got), canonical(want)
    off = (a != b).any(axis=1)
    return f"{off.sum()} rows differ:\n{a[off].head(3)}\n{b[off].head(3)}" if off.any() else ""


def main() -> None:
    import __spark_entry__ as entry
    from tests.conftest import session

    spark, con = session(), connect()
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in [a for a in sys.argv[1:] if not a.startswith("-")] or queries:
        if "-llm" not in sys.argv and (name.startswith("op") or name == "pipeline"):
            continue
        t = time.time()
        try:
            got = queries[name](spark, SF).toPandas()
            said = differences(got, con.execute(sql[name]).df()) if name in sql else f"rows only: {len(got)}"
            types = ""
            print(f"{time.time() - t:5.1f} {name}: {said or 'ok'} {len(got)} {types}", flush=True)
        except Exception as e:
            print(f"{time.time() - t:5.1f} {name}: ERROR {str(e)[:600]}", flush=True)


if __name__ == "__main__":
    main()
