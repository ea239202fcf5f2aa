"""Run registered queries next to their SQL checks: python tools/check_queries.py [sf] [name-prefix ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from fieldtally.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v, digits):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.{digits}g}"
    return repr(v)


def rows(cols, data, digits):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i], digits) for i in order) for r in data)


def compare(spark, con, folder, name, fn, sql):
    at = time.time()
    df = fn(spark, folder)
    data = [tuple(r) for r in df.collect()]
    took = time.time() - at
    if sql is None:
        return "ROWS", len(data), took, ""
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    types = {d[0]: str(d[1]) for d in res.description}
    want = res.fetchall()
    if sorted(cols) != sorted(df.columns):
        return "FAIL", len(data), took, f"columns {sorted(df.columns)} vs {sorted(cols)}"
    note = ""
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}
    odd = [f"{c}:{k}/{types[c]}" for c, k in df.dtypes if kinds.get(k) != types[c]]
    if odd:
        note = "types " + ",".join(odd)
    got_rows, want_rows = rows(df.columns, data, 17), rows(cols, want, 17)
    if got_rows == want_rows:
        return "OK", len(data), took, note
    near = rows(df.columns, data, 9) == rows(cols, want, 9)
    have, need = set(got_rows), set(want_rows)
    diff, other = sorted(have - need)[:2], sorted(need - have)[:2]
    return ("NEAR" if near else "FAIL"), len(data), took, f"{note} n={len(got_rows)}/{len(want_rows)} {diff} <> {other}"


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    wanted = sys.argv[2:]
    folder = f"/root/testdata/{sf}"
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    from fieldtally.catalog import ORACLES, QUERIES
    bad = 0
    for name, fn in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            state, n, took, note = compare(spark, con, folder, name, fn, ORACLES.get(name))
        except Exception as e:  # report and go on to the next query
            state, n, took, note = "ERROR", 0, 0.0, f"{type(e).__name__}: {str(e)[:600]}"
        bad += state not in ("OK", "ROWS")
        if n == 0:
            note += "  (no rows)"
        print(f"{state:5} {name:34} rows={n:<7} {took:6.2f}s {note}", flush=True)
    print("not ok:", bad)


if __name__ == "__main__":
    main()
