"""Runs queries against their SQL: python tests/compare.py DATA_DIR [NAME ...]"""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, float):
        return round(x, 5) + 0.0
    if hasattr(x, "tolist"):
        x = x.tolist()
    return tuple(plain(v) for v in x) if isinstance(x, (list, tuple)) else x


def oracle(data_dir: str):
    import duckdb

    con = duckdb.connect()
    for p in Path(data_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def differences(spark, con, data_dir: str, name: str, query, sql: str) -> str:
    """Empty if the query's rows equal the SQL's, else what differs."""
    df = query(spark, data_dir)
    cols = sorted(df.columns)
    got = sorted((plain(tuple(r[c] for c in cols)) for r in df.collect()), key=repr)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    want = sorted((plain(tuple(r[names.index(c)] for c in cols)) for r in cur.fetchall()), key=repr)
    if len(got) != len(want):
        return f"{len(got)} rows, not {len(want)}; only here {list(set(got) - set(want))[:2]}, only there {list(set(want) - set(got))[:2]}"
    near = lambda a, b: a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) < 2e-5
    bad = [(a, b) for a, b in zip(got, want) if not all(near(x, y) for x, y in zip(a, b))]
    return f"{len(bad)} of {len(got)} rows differ, as {bad[:2]}" if bad else ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    d, only = sys.argv[1], sys.argv[2:]
    con, sqls = oracle(d), entry.oracle_sql()
    for name, q in entry.queries().items():
        if only and name not in only:
            continue
        began = time.time()
        try:
            said = differences(spark, con, d, name, q, sqls[name]) if name in sqls else f"rows {q(spark, d).count()}"
        except Exception:
            said = "ERROR " + " ".join(traceback.format_exc().splitlines()[-3:])[:400]
        print(f"{name:28s} {time.time() - began:5.1f}s {said or 'ok'}"[:420], flush=True)
