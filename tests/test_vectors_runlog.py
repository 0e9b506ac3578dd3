from __future__ import annotations

import numpy as np
import pytest

from pyspark.sql import functions as F

from unitloom.operators import runlog as rl, vectors as vx


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("exclude", [True, False])
def test_knn_equals_brute_force(spark, metric, exclude):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(300, 6)), 2)
    x[100:200] = x[100]  # a third of the table is one point
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<double>")
    got: dict[int, list] = {}
    for r in vx.knn(df, df, 4, metric, exclude, pivots=7, block=16).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append((r.id, round(r.score, 6)))
    if metric == "cosine":
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        s = u @ u.T
    else:
        s = -np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = np.round(s, 9)
    for i in range(len(x)):
        order = [j for j in np.lexsort((np.arange(len(x)), -s[i])) if not (exclude and j == i)][:4]
        assert [j for j, _ in got[i]] == order


def test_spectrum(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 5)) * [5, 2, 1, 1, 0.1]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<double>")
    got = vx.spectrum(vx.covariance(df)).first()
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    assert got.participation_singular == pytest.approx(s.sum() ** 2 / (s**2).sum(), rel=1e-9)
    assert got.participation_variance == pytest.approx((s**2).sum() ** 2 / (s**4).sum(), rel=1e-9)
    assert got.top1 == pytest.approx(s[0] ** 2 / (s**2).sum(), rel=1e-9)


def spikes(values, k, floor, hist, min_n):
    """The sequential rule, written out."""
    history, out = [], []
    for v in values:
        recent = sorted(history[-hist:])
        limit = max(k * recent[len(recent) // 2], floor) if len(recent) >= min_n else float("inf")
        bad = v is None or not np.isfinite(v) or v > limit
        out.append(bad)
        if not bad:
            history.append(v)
    return out


@pytest.mark.parametrize("span", [8, 25, 1 << 16])
def test_spikes_equal_sequential_rule(sliced, span):
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for run, n in (("hot", 240), ("a", 60), ("b", 7)):
        values = np.exp(rng.normal(size=n) * (1 + 0.8 * (np.arange(n) > n // 2))).tolist()
        values[n // 3] = float("nan")
        rows += [(run, i, v) for i, v in enumerate(values)]
        want.update({(run, i): b for i, b in enumerate(spikes(values, 2.0, 0.5, 12, 5))})
    df = sliced.createDataFrame(rows, "run string, step bigint, value double")
    got = {(r.run, r.step): r.spike for r in rl.spike_flags(df, 2.0, 0.5, 12, 5, span=span).collect()}
    assert got == want
    assert any(want.values())


def test_only_blocks_with_another_history_are_judged_again(sliced):
    span, hist, n = 20, 6, 200
    quiet = [1.0 + (i % 3) / 10 for i in range(n)]
    late = list(quiet)
    late[105] = 50.0  # one spike of the middle block, out of its successor's inherited values
    tail = list(quiet)
    tail[117] = 50.0  # one among the values that the next block was thought to inherit
    rows = [(run, i, v) for run, values in (("quiet", quiet), ("late", late), ("tail", tail)) for i, v in enumerate(values)]
    df = sliced.createDataFrame(rows, "run string, step bigint, value double")
    _, verdicts, last = rl.spike_rounds(df, 3.0, 0.0, hist, 3, span)
    again = {(r.run, r._block): r["count"] for r in verdicts.filter("_round > 0").groupBy("run", "_block").count().collect()}
    assert again == {("tail", 6): span}
    assert {(r.run, r._block): r._round for r in last.filter("_round > 0").collect()} == {("tail", 6): 1}
    flagged = {(r.run, r.step) for r in rl.spike_flags(df, 3.0, 0.0, hist, 3, span).filter("spike").collect()}
    assert flagged == {("late", 105), ("tail", 117)}
    assert rl.spike_flags(df.limit(0), 3.0, 0.0, hist, 3, span).count() == 0


def test_stalls_and_best(sliced):
    flags = [1, 1, 0, 1, 1, 1, 0, 0, 1]
    df = sliced.createDataFrame([("r", i, float(9 - i % 4), bool(f)) for i, f in enumerate(flags)], "run string, step bigint, value double, skip boolean")
    from pyspark.sql import functions as F

    got = sorted((r.first_step, r.last_step, r.n_skips) for r in rl.stall_runs(df, 2, F.col("skip")).collect())
    assert got == [(0, 1, 2), (3, 5, 3)]
    best = [(r.best, r.improved) for r in rl.running_best(df.drop("skip")).orderBy("step").collect()]
    assert best[:5] == [(9.0, True), (8.0, True), (7.0, True), (6.0, True), (6.0, False)]


def test_merge_segments_first_wins(spark):
    a = spark.createDataFrame([("r", 1, 1.0), ("r", 2, 2.0)], "run string, step bigint, value double")
    b = spark.createDataFrame([("r", 2, 9.0), ("r", 3, 3.0)], "run string, step bigint, value double")
    got = [(r.step, r.value) for r in rl.merge_segments([a, b]).orderBy("step").collect()]
    assert got == [(1, 1.0), (2, 2.0), (3, 3.0)]


def test_table_rows_are_copied_only_where_queries_go(spark):
    rng = np.random.default_rng(11)
    centres = np.eye(5) * 1000
    rows = [(i, (centres[i % 5] + rng.normal(size=5)).tolist()) for i in range(200)]
    table = spark.createDataFrame(rows, "id bigint, vec array<double>")
    queries = table.filter("id % 5 = 0").select((F.col("id") + 1000).alias("id"), "vec")
    many = queries
    for k in range(1, 4):
        many = many.unionByName(queries.select((F.col("id") + 1000 * k).alias("id"), "vec"))
    for asked, block, crowds in ((queries, 200, 1), (many, 20, 8)):
        routed, spread = vx.routed_blocks(asked, table, 3, "l2", False, pivots=10, block=block)
        assert routed.count() >= asked.count()
        assert spread.count() <= 40 * crowds  # the crowded cluster's rows alone, not 200 for each crowd


def test_rows_are_copied_by_the_size_of_what_meets_not_by_block(spark):
    rng = np.random.default_rng(3)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(800, 16)))], "id bigint, vec array<double>")
    routed, spread = vx.routed_blocks(table, table, 3, "l2", pivots=4, block=8)
    # Nothing is ruled out here, and 100 blocks of 8 rows would copy every row 100 times.
    assert routed.groupBy("id").count().agg(F.max("count")).first()[0] <= 12
    assert spread.groupBy("id").count().agg(F.max("count")).first()[0] <= 12


def test_best_of_many_equals_sorting():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 8))
    x[500:1500] = x[500]
    ids, own = np.arange(3000), np.arange(40) * 25
    got = [(r, i) for rows, near, _ in vx._best(x[own], x, ids, own, 5, False) for r, i in zip(rows, near)]
    for r, q in enumerate(own):
        score = np.round(-np.sqrt(((x - x[q]) ** 2).sum(1)), 9)
        score[q] = -np.inf
        assert [i for at, i in got if at == r] == np.lexsort((ids, -score))[:5].tolist()
