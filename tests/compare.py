"""Runs queries beside their SQL in DuckDB: python tests/compare.py SF_DIR [NAME-PREFIX...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings metrics resources ratings qa_pairs change_feed benchmark".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')" if not Path(f"{sf_dir}/{t}.parquet").is_dir() else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet/*.parquet')")
    return c


def canon(df: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples of plain text, columns by name, floats at 6 digits."""

    def one(x):
        if x is pd.NA:
            return "∅"
        if x is None or (isinstance(x, float) and x != x) or x is pd.NaT:
            return "∅"
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return str(bool(x))
        if isinstance(x, float) or "float" in type(x).__name__.lower():
            return f"{float(x):.6g}"
        if hasattr(x, "isoformat"):
            return pd.Timestamp(x).tz_localize(None).isoformat() if pd.Timestamp(x).tzinfo is None else pd.Timestamp(x).tz_convert("UTC").tz_localize(None).isoformat()
        if hasattr(x, "__len__") and not isinstance(x, (str, bytes)):
            return str([one(y) for y in x])
        try:
            return str(int(x)) if not isinstance(x, str) and x == int(x) else str(x)
        except Exception:
            return str(x)

    cols = sorted(df.columns)
    return sorted(tuple(one(x) for x in r) for r in df[cols].itertuples(index=False, name=None))


def differs(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(sql_df.columns)}"
    group = {"i": "whole", "u": "whole", "f": "float", "b": "truth", "M": "time"}
    for c in spark_df.columns:
        x, y = group.get(spark_df[c].dtype.kind, "other"), group.get(sql_df[c].dtype.kind, "other")
        if x != y and len(spark_df) and len(sql_df) and not spark_df[c].isna().any():
            return f"column {c} is {spark_df[c].dtype} and {sql_df[c].dtype}"
    a, b = canon(spark_df), canon(sql_df)
    if a == b:
        return ""
    sa, sb = set(a), set(b)
    return f"{len(a)} and {len(b)} rows; only in Spark {list(sa - sb)[:2]}, only in SQL {list(sb - sa)[:2]}"


if __name__ == "__main__":
    import __spark_entry__ as e
    from rillstone.session import build_session

    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    sf, want = sys.argv[1], sys.argv[2:]
    con, sql, bad = duck(sf), e.oracle_sql(), []
    for name, f in e.queries().items():
        if want and not any(name.startswith(w) for w in want):
            continue
        began = time.time()
        try:
            got = f(spark, sf).toPandas()
            took = time.time() - began
            said = differs(got, con.execute(sql[name]).fetchdf()) if name in sql else "no SQL"
        except Exception as x:  # noqa: BLE001
            took, got, said = time.time() - began, [], f"ERROR {str(x)[:700]}"
        if said and said != "no SQL":
            bad.append(name)
        print(f"{name:34s} {len(got):8d} rows {took:6.1f} s  {said or 'same'}", flush=True)
    print("BAD:", bad)
