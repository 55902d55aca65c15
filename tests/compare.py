"""Runs registered queries beside their DuckDB check.

    python tests/compare.py sf0.01 [name ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
ROOT = "/root/testdata"


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)

    def cell(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NaT or v is pd.NA:
            return "<null>"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return f"{float(v):.9g}"
        return str(v)

    rows = [tuple(cell(v) for v in row) for row in pdf[cols].itertuples(index=False, name=None)]
    return sorted(rows)


def differences(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} against {sorted(right.columns)}"
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}"
    for c in left.columns:
        a, b = left[c].dtype.kind, right[c].dtype.kind
        if a != b and not {a, b} <= {"O", "U", "T"} and {a, b} != {"i", "u"}:
            return f"column {c}: {left[c].dtype} against {right[c].dtype}"
    a, b = canonical(left), canonical(right)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from harbinger.session import local_session

    sf_dir = os.path.join(ROOT, sys.argv[1])
    wanted = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    checks, failed = oracle_sql(), 0
    for name, fn in queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            got = fn(spark, sf_dir).toPandas()
            mid = time.time()
            if name in checks:
                problem = differences(got, con.sql(checks[name]).df())
            else:
                problem = None if len(got) else "no rows"
            tail = f"duckdb {time.time() - mid:.1f}s" if name in checks else "rows only"
            print(f"{'ok  ' if problem is None else 'FAIL'} {name} {len(got)} rows {mid - start:.1f}s {tail} {problem or ''}", flush=True)
            failed += problem is not None
        except Exception as exc:  # noqa: BLE001
            failed += 1
            print(f"ERR  {name}: {type(exc).__name__}: {str(exc)[:1500]}", flush=True)
    print("failed:", failed)
    spark.stop()
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
