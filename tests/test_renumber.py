"""Renumbering and mapping: the same rows as a plain window and join, in whatever order they come, and few rows moved."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window, functions as F

from tests.test_runs import moved_rows
from unitloom.operators import rewrite

UNITS = "shard string, doc_id bigint, pos bigint, unit string, n_bytes bigint, doc_start boolean"


def documents(n, units, words, seed=4):
    rng = random.Random(seed)
    return [("ab"[d % 2], d, p, rng.choice(words), p, p == 0) for d in range(n) for p in range(units)]


def plain(rows):
    """The numbering by a window over the unit rows."""
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("shard", "doc_id").orderBy("pos", "piece", "unit")).cast("bigint") - 1).drop("piece")


def same(got, want):
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("shuffled", [False, True])
def test_places_are_those_of_a_window(spark, shuffled):
    rng = random.Random(7)
    words = ["a", "", "é ", "x\x1fy", "\x1e", "\x1e1", "\x1e2", "\x1f", None]
    rows = [(rng.choice(["s", None]), rng.choice([1, 2, None]), p, k, rng.choice(words), k, k % 2 == 0) for p in [*range(60), None] for k in range(1 + p % 3 if p else 1)]
    rows += [("s", 9, p, 0, w, 0, None) for p, w in enumerate(words)]
    if shuffled:
        rng.shuffle(rows)
    schema = UNITS.replace("pos bigint,", "pos bigint, piece bigint,")
    df = spark.createDataFrame(rows, schema).repartition(3)
    same(rewrite.renumber(df), plain(df))
    same(rewrite.renumber(df.drop("n_bytes", "doc_start")), plain(df.drop("n_bytes", "doc_start")))
    assert rewrite.renumber(df.limit(0)).count() == 0


def test_a_document_that_comes_twice_keeps_both(spark):
    rows = [("s", 1, p, 0, f"u{p}") for p in range(30)] * 2
    df = spark.createDataFrame(rows, "shard string, doc_id bigint, pos bigint, piece bigint, unit string").coalesce(1)
    got = [(r.pos, r.unit) for r in rewrite.renumber(df).orderBy("pos").collect()]
    assert got == [(i, f"u{i // 2}") for i in range(60)]


def test_a_document_is_moved_as_runs_and_once(spark):
    df = spark.createDataFrame(documents(20, 400, ["a ", "b ", "c"]), UNITS).withColumn("piece", F.lit(0).cast("bigint")).coalesce(2)
    rows = rewrite.renumber(df.select("shard", "doc_id", "pos", "piece", "unit"))
    text = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "unit"))).alias("units"))
    assert moved_rows(text) < 100
    plan = text._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange ") == 1


@pytest.mark.parametrize("limit", [0, 2, 3, 50])
def test_only_rows_of_rare_units_are_moved_for_a_large_mapping(spark, limit):
    rare = [("a", 1, 900 + i, f"rare{i}", 5, False) for i in range(12)]
    df = spark.createDataFrame([*documents(10, 300, ["the ", "cat ", None]), *rare], UNITS).coalesce(2)
    mapping = spark.createDataFrame([("cat ", ["c", "at "]), *[(f"rare{i}", ["ra", f"re{i}"]) for i in range(12)]], "unit string, pieces array<string>")
    freq = df.filter("unit IS NOT NULL").groupBy("unit").agg(F.count(F.lit(1)).alias("cnt"))
    got = rewrite.apply_mapping(df, mapping, limit, freq)
    same(got, rewrite.apply_mapping(df, mapping, 1_000))
    if limit in (2, 3):
        null_rows = df.filter("unit IS NULL").count()
        assert moved_rows(got) < null_rows + 100
