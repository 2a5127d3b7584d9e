"""Compare registered queries with their SQL, as the driver does: same rows whatever their order."""

from __future__ import annotations

import math
import sys
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(folder).glob("*.parquet")):
        src = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{src}')")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        v = v.astimezone(__import__("datetime").timezone.utc).replace(tzinfo=None)
    if hasattr(v, "year") and not hasattr(v, "hour"):
        v = __import__("datetime").datetime(v.year, v.month, v.day)
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


def compare(spark, con, run, sql: str, folder: str) -> str:
    """'' if equal, else what differs."""
    df = run(spark, folder)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return f"columns {cols} against {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"{a} against {b}"
    return ""


if __name__ == "__main__":
    import time

    import __spark_entry__ as e
    from taintgauge.session import local_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    queries, oracles = e.queries(), e.oracle_sql()
    for n in names or queries:
        t = time.time()
        try:
            said = compare(spark, con, queries[n], oracles[n], folder) if n in oracles else f"(rows only: {queries[n](spark, folder).count()})"
        except Exception as x:  # noqa: BLE001
            said = "ERROR " + " ".join(str(x).split())[:600]
        print(f"{n:28s} {time.time() - t:6.1f} s  {said or 'equal'}", flush=True)
