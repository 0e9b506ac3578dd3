from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from unitloom.operators import mixing


def shuffled_bytes(spark) -> int:
    """Bytes that all stages so far have written to shuffles."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def wide(spark, n):
    text = F.concat_ws(" ", *[F.md5(F.concat(F.col("id").cast("string"), F.lit(str(i)))) for i in range(40)])
    return spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"))


@pytest.mark.parametrize("every", [200, 4, 1])
def test_text_that_is_moved_follows_the_share_that_is_seen(spark, every):
    n = 8_000
    docs = wide(spark, n)
    seen = mixing.build_seen_ids(docs.filter(F.col("doc_id") % every == 0).unionByName(wide(spark, n).withColumn("doc_id", F.col("doc_id") + 10**6)), "doc_id")
    seen = seen.cache()
    seen.count()
    before = shuffled_bytes(spark)
    kept = mixing.drop_seen(docs, seen, "doc_id").agg(F.count("*"), F.sum(F.length("text"))).first()
    moved = shuffled_bytes(spark) - before
    seen.unpersist()
    assert kept[0] == n - -(-n // every)
    text = n * 1_300
    assert moved < text * (1.1 / every) + 40 * n


def test_seen_rows_go_whatever_the_filter_holds(spark, monkeypatch):
    monkeypatch.setattr(mixing, "WORDS", 2)  # full of bits: every row may be in it
    docs = spark.createDataFrame([(i, str(i)) for i in range(500)] + [(None, "no id"), (7, "twice")], "doc_id long, text string")
    seen = mixing.build_seen_ids(spark.range(0, 1000, 3).select(F.col("id").alias("doc_id")), "doc_id")
    got = sorted((r.doc_id for r in mixing.drop_seen(docs, seen, "doc_id").collect()), key=str)
    assert got == sorted([i for i in range(500) if i % 3] + [None, 7], key=str)
    assert mixing.drop_seen(docs, seen, "doc_id").columns == docs.columns
    assert mixing.drop_seen(docs, seen.limit(0), "doc_id").count() == 502 and mixing.drop_seen(docs.limit(0), seen, "doc_id").count() == 0
