"""Run queries against their SQL in DuckDB: same columns, same rows in any order."""

from __future__ import annotations

import datetime
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, query, sql) -> str | None:
    """None when equal, else a description of the first difference."""
    df = query(spark, sf_dir)
    got_names, got = df.columns, df.collect()
    cur = con.execute(sql)
    want_names, want = [d[0] for d in cur.description], cur.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} != {sorted(want_names)}"
    a, b = _rows(got_names, got), _rows(want_names, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}; e.g. {a[:2]} / {b[:2]}"
    kinds = {str(type(x)) for r in a[:50] for x in r} ^ {str(type(x)) for r in b[:50] for x in r}
    for i, (x, y) in enumerate(zip(a, b)):
        if x != y:
            n = sum(p != q for p, q in zip(a, b))
            return f"{n} of {len(a)} rows differ, first at {i}:\n   {str(x)[:600]}\n   {str(y)[:600]}"
    return f"types differ: {kinds}" if kinds else None


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from geoctx.session import get_session

    sf = sys.argv[1]
    names = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = get_session("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    chosen = [q for q in queries if not names or any(q.startswith(n) for n in names)]
    bad = 0
    for q in chosen:
        t = time.time()
        try:
            if q in oracles:
                res = compare(spark, con, sf_dir, queries[q], oracles[q])
                state = "ok" if res is None else "FAIL " + res
            else:
                state = f"rows only: {len(queries[q](spark, sf_dir).collect())}"
        except Exception as e:  # noqa: BLE001
            state = "ERROR " + str(e)[:900]
        bad += state.startswith(("FAIL", "ERROR"))
        print(f"{q:44s} {time.time() - t:6.2f}s {state}", flush=True)
    print(f"{len(chosen)} queries, {bad} bad", flush=True)
