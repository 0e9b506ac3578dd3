"""Windows brought back to their size: the rows of a plain rule, from windows that are brought together once and moved as texts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.test_runs import moved_rows
from unitloom.operators import windows as win
from unitloom.plans.all import QUERIES

SIZE = 8
WORDS = ["a", "", "é ", "x\x1fy", "\x1e", "\x1e1", "\x1e2"]


def moved_bytes(df):
    """Bytes of the rows that a finished query wrote to its exchanges."""
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "Exchange":
            total += node.metrics().get("dataSize").get().value()
        inner = [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in node.nodeName() else []
        children = node.children()
        todo += inner + [children.apply(i) for i in range(children.size())]
    return total


def shard_units(spark, words, seed=2):
    rng = random.Random(seed)
    rows = [(s, n, i, rng.choice(words), i == 0) for s, n in (("a", 100), ("b", 33), ("c", 8), ("d", 5), (None, 40)) for i in range(n)]
    return spark.createDataFrame(rows, "shard string, shard_units long, seq long, unit string, doc_start boolean").coalesce(2)


@pytest.mark.parametrize("words", [WORDS, [*WORDS, None]])
def test_dealt_windows_are_the_gathered_ones(spark, words):
    rows = win.make_windows(shard_units(spark, words), SIZE, tail=True).withColumn("name", F.col("shard"))
    keys = ["name", "local_window"]
    want = win.gather_windows(rows, keys).select(*keys, "units")
    for order in (rows, rows.orderBy(F.rand(1))):
        got = win.gather_windows(order, keys, dealt=True)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert moved_rows(win.gather_windows(rows, keys, dealt=True)) < 60


@pytest.mark.parametrize("dealt", [False, True])
def test_refit_is_the_rule(spark, dealt):
    rows = win.make_windows(shard_units(spark, WORDS), SIZE, tail=True).withColumn("name", F.col("shard"))
    raw = win.gather_windows(rows, ["name", "local_window"], dealt).select(F.col("name").alias("shard"), "local_window", "units")
    held = {(r.shard, r.local_window): list(r.units) for r in raw.collect()}
    rng = random.Random(5)
    changed = {k: (u * 2)[: rng.choice([0, 3, 7, 8, 9, 12])] for k, u in held.items() if len(u) == SIZE}
    changed["c", 0] = changed["c", 0][:3]  # nothing follows it
    augmented = spark.createDataFrame([(*k, u) for k, u in changed.items()], "shard string, local_window long, units array<string>")
    want = []
    for (shard, w), units in changed.items():
        if shard is None:
            continue
        missing, ahead = SIZE - len(units), held.get((shard, w + 1), [])
        how = "trim" if missing < 0 else "same" if missing == 0 else "pad" if len(ahead) >= missing else "raw"
        fitted = held[shard, w] if how == "raw" else units[:SIZE] + ahead[: max(missing, 0)]
        want.append((shard, w, fitted, how))
    got = [(r.shard, r.local_window, list(r.units), r.how) for r in win.refit_windows(augmented, raw, SIZE).collect()]
    assert sorted(got) == sorted(want) and {h for *_, h in want} == {"trim", "same", "pad", "raw"}


def test_windows_are_brought_together_once_and_moved_as_texts(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, f"src{i % 3}", " ".join(rng.choices(["alpha", "be", "12", "ein"], k=700)), "en") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, source string, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    fitted = QUERIES["D7_refit_windows"](spark, str(tmp_path))
    assert len(fitted.collect()) > 60
    texts = sum(len(text) for _, _, text, _ in rows)
    assert moved_bytes(fitted) < 4 * texts
    gathered = [i for i in fitted._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].split("MapInArrow")[1:]]
    assert len(gathered) == 1


def test_store_moves_no_split_text(spark, tmp_path):
    from unitloom.sources import positional_store as store

    docs = spark.createDataFrame([("ab"[i % 2], i, "one two 3 " * (i % 5)) for i in range(90)], "shard string, doc_id long, text string")
    path = str(tmp_path / "s")
    store.write_positional(docs, path)
    split = spark.read.parquet(str(next((tmp_path / "s").glob("_split-*"))))
    ahead = {}
    for r in sorted(split.collect(), key=lambda r: (r.part, r.shard, r.doc_id)):
        assert (r.u0, r.b0) == ahead.get((r.part, r.shard), (0, 0))
        ahead[r.part, r.shard] = (r.u0 + r.n_units, r.b0 + len(r.text))
    codecs = {f.name.split(".")[-2] for f in (tmp_path / "s" / "units").glob("*.parquet")}
    assert codecs == {"zstd"}


def test_targets_come_back_as_windows(spark):
    """A row for each window leaves the workers, not one for each unit, and the targets are those of a plain loop."""
    texts = ["ab", "", "é", None, "xyz", "q" * 20, "é€", "b"]
    rows = [(w, 10 * i, texts[(i + (w or 0)) % 8]) for w in (1, 2, None) for i in range(40)]
    df = spark.createDataFrame(rows, "window_id long, idx long, unit string").coalesce(2)
    want = []
    for window in (1, 2, None):
        units = [(i, (u or "").encode()) for w, i, u in rows if w == window]
        for at, (idx, _) in enumerate(units):
            delta = 0
            for k, (_, ahead) in enumerate(units[at + 1 : at + 5], 1):
                for r, byte in enumerate(ahead):
                    delta += 1
                    if delta <= 16:
                        want.append((window, idx, delta, k, r, byte, round(0.8 ** (k - 1), 9)))
    made = win.future_targets(df, 4, 0.8, 16)
    assert made.columns == ["window_id", "idx", "delta", "k", "r", "byte", "weight"]
    assert sorted(map(str, ((*r[:-1], round(r.weight, 9)) for r in made.collect()))) == sorted(map(str, want))
    done, todo = 0, [made._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        metric = node.metrics().get("pythonNumRowsReceived")
        done += metric.get().value() if metric.isDefined() else 0
        inner = [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in node.nodeName() else []
        children = node.children()
        todo += inner + [children.apply(i) for i in range(children.size())]
    assert 0 < done < 40
