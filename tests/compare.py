"""Run a registered query and its SQL side by side and report differences."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if type(value).__name__ == "Decimal":
        return float(value) if value != int(value) else int(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((v is not None, str(type(v)), str(v)) for v in r))


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    seconds = time.time() - t0
    if sql is None:
        return seconds, len(got), "rows only" if got else "EMPTY"
    rel = con.sql(sql)
    want_cols, want = rows_of(rel.columns, rel.fetchall())
    if got_cols != want_cols:
        return seconds, len(got), f"COLUMNS {got_cols} != {want_cols}"
    if len(got) != len(want):
        return seconds, len(got), f"ROWS {len(got)} != {len(want)}; e.g. {[r for r in got[:2]]} vs {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return seconds, len(got), f"VALUES {len(bad)} differ, e.g. {bad[:2]}"
    types = [(type(a).__name__, type(b).__name__) for a, b in zip(got[0], want[0]) if type(a) is not type(b)] if got else []
    return seconds, len(got), ("ok" if not types else f"ok TYPES {types}") if got else "EMPTY"


def main():
    sys.path.insert(0, "/root/repo")
    from unitloom.session import local_session
    from unitloom.plans.all import ORACLES, QUERIES

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    only = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    con = duck(sf_dir)
    failed = 0
    for name, fn in QUERIES.items():
        if only and not any(name.startswith(o) for o in only):
            continue
        try:
            seconds, n, verdict = compare(spark, con, name, fn, ORACLES.get(name), sf_dir)
        except Exception as e:
            seconds, n, verdict = 0, 0, "ERROR " + str(e)[:1200]
        failed += verdict not in ("ok", "rows only")
        print(f"{name:32s} {seconds:6.1f}s {n:8d}  {verdict[:1500]}", flush=True)
    print("not ok:", failed)


if __name__ == "__main__":
    main()
