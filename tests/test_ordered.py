from __future__ import annotations

import random

from pyspark.sql import functions as F

from unitloom.operators.ordered import prefix_scan, ranked, sliding, top_per_group


def rows(seed=1, n=900):
    """One group holds more than a third of all rows."""
    rng = random.Random(seed)
    return [("hot" if i % 2 else f"g{rng.randrange(7)}", i * 3, rng.randrange(-50, 50), rng.random() < 0.3) for i in range(n)]


def by_group(data):
    out = {}
    for r in sorted(data, key=lambda r: (r[0], r[1])):
        out.setdefault(r[0], []).append(r)
    return out


def test_prefix_scan_crosses_slices(sliced):
    data = rows()
    df = sliced.createDataFrame(data, "g string, k bigint, v bigint, keep boolean")
    out = prefix_scan(
        df,
        ["g"],
        ["k"],
        {
            "s": ("sum", F.col("v")),
            "n": ("count", F.lit(1)),
            "lo": ("min", F.col("v")),
            "hi": ("max", F.col("v")),
            "fill": ("last", F.when(F.col("keep"), F.col("v"))),
            "lo_before": ("min_before", F.col("v")),
            "s_before": ("sum_before", F.col("v")),
        },
    )
    got = {(r.g, r.k): r for r in out.collect()}
    assert len(got) == len(data)
    for g, items in by_group(data).items():
        total, fill, seen = 0, None, []
        for n, (_, k, v, keep) in enumerate(items, 1):
            r = got[(g, k)]
            assert r.lo_before == (min(seen) if seen else None)
            assert (r.s_before or 0) == total
            total += v
            seen.append(v)
            fill = v if keep else fill
            assert (r.s, r.n, r.lo, r.hi, r.fill) == (total, n, min(seen), max(seen), fill)


def test_prefix_scan_without_group_and_descending(sliced):
    df = sliced.range(500).withColumn("v", F.col("id") % 7)
    got = [(r.id, r.rn) for r in ranked(df, [], [F.col("id").desc()]).orderBy("rn").collect()]
    assert got == [(499 - i, i + 1) for i in range(500)]


def test_prefix_scan_null_group(sliced):
    df = sliced.range(300).select(F.when(F.col("id") < 0, "x").alias("g"), F.col("id").alias("k"))
    assert [r.rn for r in ranked(df, ["g"], ["k"]).orderBy("k").collect()] == list(range(1, 301))


def test_sliding_equals_plain_window(sliced):
    data = rows(2)
    df = sliced.createDataFrame(data, "g string, k bigint, v bigint, keep boolean")
    out = sliding(
        df, ["g"], ["k"], lambda w: {"m": F.sum("v").over(w.rowsBetween(-4, 2)), "nx": F.lead("v").over(w)}, back=4, ahead=2, span=10
    )
    got = {(r.g, r.k): (r.m, r.nx) for r in out.collect()}
    assert len(got) == len(data)
    for g, items in by_group(data).items():
        vs = [r[2] for r in items]
        for i, (_, k, _, _) in enumerate(items):
            assert got[(g, k)] == (sum(vs[max(0, i - 4) : i + 3]), vs[i + 1] if i + 1 < len(vs) else None)


def test_top_per_group(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 3)
    got = {(r.g, r.id) for r in top_per_group(df, ["g"], [F.col("id").desc()], 2, "r").collect()}
    assert got == {(0, 99), (0, 96), (1, 97), (1, 94), (2, 98), (2, 95)}
