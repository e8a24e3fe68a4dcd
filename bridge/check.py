"""Compare every query with its SQL twin. Usage: python -m bridge.check [--sf 0.01] [names...]"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from bridge.queries import QUERIES
from daybefore.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].dt.date
        df[c] = df[c].map(lambda v: "NULL" if v is None or v is pd.NaT or (isinstance(v, float) and v != v)
                          else repr(float(v)) if isinstance(v, float) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def compare(spark, con, name: str, sf_dir: str) -> tuple[str, str]:
    q = QUERIES[name]
    t0 = time.time()
    got = q(spark, sf_dir).toArrow().to_pandas(date_as_object=True, integer_object_nulls=True)
    t1 = time.time()
    if q.sql is None:
        return "ROWS", f"{len(got)} rows, spark {t1 - t0:.1f}s"
    want = con.sql(q.sql).to_arrow_table().to_pandas(date_as_object=True, integer_object_nulls=True)
    t2 = time.time()
    note = f"{len(got)} rows, spark {t1 - t0:.1f}s, duckdb {t2 - t1:.1f}s"
    if len(got) != len(want):
        return "FAIL", f"rows {len(got)} vs {len(want)}; {note}"
    a, b = canon(got), canon(want)
    if list(a.columns) != list(b.columns):
        return "FAIL", f"columns {list(a.columns)} vs {list(b.columns)}"
    diff = (a != b).any(axis=1)
    if diff.any():
        i = diff.idxmax()
        cols = [c for c in a.columns if a.at[i, c] != b.at[i, c]]
        return "FAIL", f"{int(diff.sum())} rows differ, e.g. {cols}: {a.loc[i].to_dict()} vs {b.loc[i].to_dict()}; {note}"
    return ("OK" if len(got) else "EMPTY"), note


def main(argv) -> int:
    sf = "0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con, bad = local_session(8), duck(sf_dir), 0
    for name in argv or list(QUERIES):
        try:
            status, note = compare(spark, con, name, sf_dir)
        except Exception as exc:  # report and go on with the next query
            status, note = "ERROR", f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += status in ("FAIL", "ERROR", "EMPTY")
        print(f"{status:6} {name:34} {note}", flush=True)
    print(f"{bad} not ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
