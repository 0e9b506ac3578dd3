from __future__ import annotations

import random

from pyspark.sql import functions as F

from unitloom.operators import windows as win
from unitloom.operators.segment import segment_word
from unitloom.sources import positional_store as store


def corpus(spark, n=700, seed=1):
    rng = random.Random(seed)
    words = ["alpha", "beta", "ein", "größer", "12", "  ", "!?", "x" * 50]
    rows = [(rng.choice("ab"), i, " ".join(rng.choices(words, k=rng.randrange(30)))) for i in range(n)]
    return spark.createDataFrame([*rows, ("a", n, None), ("b", n + 1, "")], "shard string, doc_id long, text string").repartition(5)


def scanned(df):
    """Rows that the scans of a finished query put out."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    total = 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        inner = leaf.plan().collectLeaves().apply(0) if hasattr(leaf, "plan") and "QueryStage" in leaf.nodeName() else leaf
        metric = inner.metrics().get("numOutputRows")
        total += metric.get().value() if metric.isDefined() else 0
    return total


def test_store_has_the_units_and_positions_of_a_split(sliced, tmp_path):
    docs = corpus(sliced)
    path = str(tmp_path / "s")
    store.write_positional(docs, path)
    columns = ["shard", "doc_id", "pos", "unit", "n_bytes", "doc_start", "seq", "shard_units", "first_window"]
    want = sorted(tuple(r) for r in win.sequence_units(docs, 64).select(columns).collect())
    assert sorted(tuple(r) for r in store.placed_units(sliced, path, 64).select(columns).collect()) == want
    offsets = {}
    for shard, seq, n, at in sorted((r.shard, r.seq, r.n_bytes, r.byte_off) for r in store.stored_units(sliced, path).collect()):
        assert at == offsets.get(shard, 0)
        offsets[shard] = at + n
    shards = {r.shard: (r.shard_units, r.shard_bytes) for r in sliced.read.parquet(f"{path}/shards").collect()}
    assert {s: b for s, (_, b) in shards.items()} == offsets


def test_range_tail_and_byte_lookups(spark, tmp_path):
    docs, path = corpus(spark, seed=2), str(tmp_path / "s")
    store.write_positional(docs, path)
    everything = win.sequence_units(docs, 64)
    want = sorted(tuple(r) for r in win.read_unit_range(everything, "a", 100, 50).select("seq", "unit", "byte_end", "byte_off").collect())
    assert sorted(tuple(r) for r in store.read_range(spark, path, "a", 100, 50).select("seq", "unit", "byte_end", "byte_off").collect()) == want
    windowed = win.make_windows(everything, 64)
    tail = sorted((r.window_id, r.idx, r.unit) for r in win.holdout_tail(windowed, 3).collect())
    got = win.make_windows(store.placed_units(spark, path, 64, store.last_windows(spark, path, 64, 3)), 64)
    assert sorted((r.window_id, r.idx, r.unit) for r in got.collect()) == tail
    assert store.unit_at_byte(spark, path, "a", 0).first().seq == 0
    some = store.stored_units(spark, path).filter("shard = 'b' AND seq = 321").first()
    assert store.unit_at_byte(spark, path, "b", some.byte_off + some.n_bytes - 1).first().seq == 321
    assert store.unit_at_byte(spark, path, "b", 10**9).count() == 0 and store.unit_at_byte(spark, path, "b", -1).count() == 0


def test_only_needed_row_groups_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "ROW_GROUP_BYTES", 32 << 10)
    monkeypatch.setattr(store, "PAGE_ROWS", 500)
    docs = spark.range(3_000).select(F.lit("s").alias("shard"), F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(1, 60), i -> md5(string(id * 100 + i))), ' ')").alias("text"))
    path = str(tmp_path / "s")
    store.write_positional(docs, path)
    units = store.stored_units(spark, path)
    total = units.count()
    part = units.filter((F.col("shard") == "s") & (F.col("seq") >= 5_000) & (F.col("seq") < 6_000)).select("unit")
    assert len(part.collect()) == 1_000 and scanned(part) < total / 10


def test_reading_splits_nothing_and_moves_no_text(spark, tmp_path):
    path = str(tmp_path / "s")
    store.write_positional(corpus(spark, 50), path)
    plan = win.make_windows(store.placed_units(spark, path, 8), 8)._jdf.queryExecution().toString()
    assert "regexp_extract" not in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan.replace("rangepartitioning(shard", "")


def test_empty_and_null(spark, tmp_path):
    docs = spark.createDataFrame([], "shard string, doc_id long, text string")
    store.write_positional(docs, str(tmp_path / "e"))
    assert store.placed_units(spark, str(tmp_path / "e"), 8).count() == 0
    docs = spark.createDataFrame([(None, 1, "a b"), (None, None, "c"), ("x", 2, None)], "shard string, doc_id long, text string")
    store.write_positional(docs, str(tmp_path / "n"))
    got = sorted(tuple(r) for r in store.placed_units(spark, str(tmp_path / "n"), 8).select("seq", "unit").collect())
    assert [s for s, _ in got] == list(range(len(got))) and "".join(u for _, u in got) == "ca b"


def test_places_are_stored_as_differences_and_ranges_follow_the_text(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    monkeypatch.setattr(store, "RANGE_BYTES", 2_000)
    docs, path = corpus(spark, 400), tmp_path / "s"
    store.write_positional(docs, str(path))
    staged = spark.read.parquet(str(next(path.glob("_split-*"))))
    assert "units" not in staged.columns
    assert staged.select("part").distinct().count() > int(spark.conf.get("spark.sql.shuffle.partitions"))
    big = max(path.glob("units/*.parquet"), key=lambda f: f.stat().st_size)
    group = pq.ParquetFile(big).metadata.row_group(0)
    named = {group.column(i).path_in_schema: group.column(i).encodings for i in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in named["seq"] and "DELTA_BINARY_PACKED" in named["byte_off"]


def test_unit_store_has_more_ranges_for_more_text(spark, tmp_path, monkeypatch):
    from unitloom.sources import unit_store

    docs = corpus(spark, 400)
    monkeypatch.setattr(unit_store, "RANGE_BYTES", 2_000)
    unit_store.store_documents(docs, str(tmp_path / "u"))
    files = list((tmp_path / "u").rglob("*.parquet"))
    assert len(files) > 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    want = sorted((r.shard, r.doc_id, r.pos, r.unit) for r in segment_word(docs).collect())
    assert sorted((r.shard, r.doc_id, r.pos, r.unit) for r in unit_store.read_units(spark, str(tmp_path / "u")).collect()) == want
