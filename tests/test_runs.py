"""Groups put together from runs: the same units in the same order, and no row moved for each unit."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from unitloom.operators import evaluate as ev, rewrite, runs, windows as win
from unitloom.operators.segment import segment_word, unit_array
from unitloom.sources import unit_store


def moved_rows(df):
    """Rows that a query writes to its exchanges."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        metric = node.metrics().get("shuffleRecordsWritten")
        total += metric.get().value() if metric.isDefined() else 0
        inner = [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in node.nodeName() else []
        children = node.children()
        todo += inner + [children.apply(i) for i in range(children.size())]
    return total


def windowed(spark, n=6_000, size=100, order=None):
    rows = [("s", i // size, i, i % size, f"u{i % 7}é ", i % 9 == 0) for i in range(n)]
    if order is not None:
        random.Random(order).shuffle(rows)
    return spark.createDataFrame(rows, "shard string, window_id long, seq long, idx long, unit string, doc_start boolean").coalesce(3)


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    rows = [("ab"[i % 2], i, " ".join(rng.choices(["alpha", "beta", "größer", "12", "!?"], k=300))) for i in range(30)]
    return spark.createDataFrame([*rows, ("a", 90, None), (None, 91, "x y"), ("a", 92, "")], "shard string, doc_id long, text string").coalesce(2)


@pytest.mark.parametrize("order", [None, 1])
def test_groups_hold_their_rows_in_order(spark, order):
    rng = random.Random(5)
    rows = [(rng.choice(["k", "l", None]), rng.choice([None, *range(12)]), rng.choice(["b", "a", "", "ü", None]), rng.choice([True, False, None])) for _ in range(400)]
    rows += [("long", i * (1 + i % 3 // 2), f"{i}", None) for i in range(500)]
    if order:
        rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, seq long, unit string, flag boolean").repartition(3)

    def finish(group):
        yield [*group.keys, group.low, group.lists(group.at), group.lists(group.unit), group.lists(group.flag)]

    got = runs.gathered(df, ["key"], "seq", finish, "key string, low long, at array<long>, units array<string>, flags array<boolean>", "flag")
    x = F.sort_array(F.collect_list(F.struct("seq", "unit", "flag")))
    want = df.groupBy("key").agg(F.min("seq").alias("low"), x.alias("x")).select("key", "low", "x.seq", "x.unit", "x.flag")
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, (tuple(r) for r in want.collect())))
    assert runs.gathered(df.limit(0), ["key"], "seq", finish, got.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", "), "flag").count() == 0


def test_windows_and_targets_move_a_row_for_each_window(spark):
    rows = windowed(spark)
    for made in (win.gather_windows(rows), win.future_targets(rows, 4, 0.8, 16), win.future_targets(rows, 4, 0.8, 16, counted=True)):
        assert moved_rows(made) < 200
    assert sorted(map(str, win.gather_windows(windowed(spark, order=2)).collect())) == sorted(map(str, win.gather_windows(rows).collect()))


def test_counted_targets_are_the_targets(spark):
    rows = windowed(spark, 700, 90)
    each = Counter((r.delta, r.k, r.r, r.byte) for r in win.future_targets(rows, 3, 0.8, 7).collect())
    counted = Counter()
    for r in win.future_targets(rows, 3, 0.8, 7, counted=True).collect():
        counted[r.delta, r.k, r.r, r.byte] += r.n
    assert counted == each
    by = ["delta", "k", "r"]
    counts = ev.stratified_loss(win.future_targets(rows, 3, 0.8, 7, counted=True), by, "byte", "n")
    assert sorted(map(str, counts.collect())) == sorted(map(str, ev.stratified_loss(win.future_targets(rows, 3, 0.8, 7), by, "byte").collect()))


def test_tensors_of_whole_batches(spark):
    rows = spark.createDataFrame([(1, ["aé", "", "xyz123"]), (2, []), (3, ["q"])], "window_id long, units array<string>")
    made = win.tensorize(rows, 4)
    assert "mapinarrow" in made._jdf.queryExecution().toString().lower()
    got = {r.window_id: r for r in made.collect()}
    assert got[1].byte_ids == [[97, 195, 169, 256], [256] * 4, [120, 121, 122, 49, 50, 51]]
    assert got[1].pad_mask == [[False, False, False, True], [True] * 4, [False] * 4]
    assert got[1].flat == [97, 195, 169, 120, 121, 122, 49, 50, 51] and got[1].flat_len == 9
    assert got[1].ends == [3, 3, 9] and got[1].patch_pos == [0] * 3 + [2] * 6
    assert (got[2].byte_ids, got[2].flat_len, got[2].ends) == ([], 0, []) and got[3].byte_ids == [[113, 256, 256, 256]]


def test_blocks_move_a_row_for_each_document(spark, texts):
    units = segment_word(texts)
    assert moved_rows(win.rolling_eval_blocks(units, 16)) < 100


def test_token_store_arranges_texts_and_not_tokens(spark, texts, tmp_path, monkeypatch):
    monkeypatch.setattr(unit_store, "RANGE_BYTES", 2_000)
    vocab = spark.createDataFrame([("alpha ", 1), ("12", 2)], "unit string, rnk int")
    encode = lambda docs: rewrite.encode_with_vocab(docs, unit_array("text", win.PATTERNS["prev"], 32), vocab, 5)
    unit_store.store_tokens(texts, str(tmp_path / "t"), encode)
    stored = unit_store.read_tokens(spark, str(tmp_path / "t"))
    assert len(list((tmp_path / "t").rglob("*.parquet"))) > 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    want = encode(texts).withColumn("shard", F.col("shard"))
    columns = ["doc_id", "pos", "token_id", "doc_start", "shard"]
    assert sorted(map(str, stored.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
