"""Runs a registered query in Spark and its SQL in DuckDB and compares the two.

Usage: python tests/oracle.py [folder] [name ...]
"""

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]")
        elif df[c].dtype != object and not str(df[c].dtype).startswith(("str", "bool")):
            df[c] = df[c].astype("float64")
    # every column exactly equal: compare sorted rows as text
    rows = df.astype(object).where(df.notna(), None)
    return pd.DataFrame(sorted(rows.itertuples(index=False, name=None), key=repr), columns=df.columns)


def differences(spark_df, sql, con) -> str | None:
    """None when rows, columns, types and values agree."""
    result = con.sql(sql)
    kinds = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "tinyint": "TINYINT",
             "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}
    ours = {n: kinds.get(t, t) for n, t in spark_df.dtypes}
    theirs = dict(zip(result.columns, map(str, result.types)))
    if ours != theirs:
        return f"schema {[(k, ours.get(k), theirs.get(k)) for k in sorted(set(ours) | set(theirs)) if ours.get(k) != theirs.get(k)]}"
    a, b = normal(spark_df.toPandas()), normal(result.df())
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    bad = [(x, y) for x, y in zip(a.itertuples(index=False, name=None), b.itertuples(index=False, name=None)) if repr(x) != repr(y)]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, e.g. {str(bad[0][0])[:400]} vs {str(bad[0][1])[:400]}"
    return None


def main(folder, names):
    import __spark_entry__ as entry
    from tidemark.session import local_session

    spark = local_session(8)
    queries, sql = entry.queries(), entry.oracle_sql()
    con = connect(folder)
    failed = 0
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in sql:
                text = differences(df, sql[name], con)
                note = f"{con.execute(f'SELECT count(*) FROM ({sql[name]})').fetchall()[0][0]} rows" if text is None else ""
            else:
                text, note = None, f"rows only: {df.count()}"
        except Exception as e:  # report and go on
            text, note = f"{type(e).__name__}: {str(e)[:700]}", ""
        failed += text is not None
        print(f"{'FAIL' if text else 'ok':5}{name:28}{time.time() - start:7.2f}s  {text or note}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:])
