"""Registered queries: streaming forms, compared with the same SQL as their batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import durable
from ..streaming import jobs
from .common_sql import UNITS
from .corpus import SEP, scratch
from .mixtures import seen_ids
from .registry import documents, query, table
from .runlogs import SPIKES, run_log


def delivered(spark, sf, copies: int = 1):
    """Documents written as several files, as a stream source."""
    src = scratch(spark)
    docs = documents(spark, sf).select("shard", "doc_id", "text")
    for _ in range(copies):
        docs.repartition(4, "doc_id").write.mode("append").parquet(src)
    return src


@query(
    "J1_stream_segment",
    f"WITH {UNITS} SELECT doc_id, count(*) AS n_units, md5(string_agg(unit, chr(31) ORDER BY pos)) AS stream FROM units GROUP BY doc_id",
)
def stream_segment(spark, sf):
    src, dst, mark = delivered(spark, sf), scratch(spark), scratch(spark)
    jobs.stream_segment(spark, src, dst, mark, max_files=2)
    jobs.stream_segment(spark, src, dst, mark, max_files=2)  # nothing new: must add nothing
    units = spark.read.parquet(dst)
    ordered = F.sort_array(F.collect_list(F.struct("pos", "unit")))
    return units.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_units"), F.md5(F.array_join(F.transform(ordered, lambda x: x["unit"]), SEP)).alias("stream")
    )


@query("J2_stream_spikes", f"WITH RECURSIVE {SPIKES} SELECT run, step, value, spike, consecutive FROM flagged")
def stream_spikes(spark, sf):
    """Three deliveries by step, the stream started anew for each: the state is carried by the checkpoint alone."""
    src, dst, mark = scratch(spark), scratch(spark), scratch(spark)
    rows = durable(run_log(spark, sf).select("run", "step", "value"))
    third = rows.agg(F.coalesce(F.max("step"), F.lit(0)) / 3).first()[0]
    for part in range(3):
        low, high = part * third, (part + 1) * third if part < 2 else float("inf")
        rows.filter((F.col("step") > low) & (F.col("step") <= high)).write.mode("append").parquet(src)
        log = jobs.file_stream(spark, src, "run BIGINT, step BIGINT, value DOUBLE")
        jobs.write_batches(jobs.stream_spikes(log, k=3.0, floor=0.0, hist=20, min_n=5), dst, mark)
    return spark.read.parquet(dst).drop("batch")


#: After the epoch, where every stream's watermark begins.
FIRST_SECOND = 1_700_000_000


@query("J3_stream_drop_seen", "SELECT source AS shard, doc_id, strlen(text) AS size FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def stream_drop_seen(spark, sf):
    """Every document arrives twice; seen and repeated ones are dropped.

    The time of a document is its id in seconds from FIRST_SECOND on, and ids are remembered for the delay the watermark allows.
    """
    src, dst, mark = delivered(spark, sf, copies=2), scratch(spark), scratch(spark)
    stream = jobs.file_stream(spark, src, jobs.DOCS, max_files=4).withColumn("at", F.timestamp_seconds(F.col("doc_id") + FIRST_SECOND))
    fresh = jobs.stream_drop_seen(stream, seen_ids(spark, sf), "doc_id", "at", "400 days")
    jobs.write_batches(fresh, dst, mark)
    return spark.read.parquet(dst).select("shard", "doc_id", F.octet_length("text").cast("bigint").alias("size"))


@query(
    "J4_stream_counts",
    """SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events
    WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1, 2""",
)
def stream_counts(spark, sf):
    """Windows closed by the final watermark."""
    src, dst, mark = scratch(spark), scratch(spark), scratch(spark)
    events = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events.write.parquet(src)
    stream = jobs.file_stream(spark, src, "ts TIMESTAMP, event_type STRING, value DOUBLE")
    jobs.write_batches(jobs.stream_counts(stream, "event_type", "value"), dst, mark)
    out = spark.read.parquet(dst).drop("batch")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("J5_ingest_progress", "SELECT count(*) AS rows, sum(strlen(text))::BIGINT AS bytes FROM documents")
def ingest_progress(spark, sf):
    docs = documents(spark, sf).select("doc_id", F.octet_length("text").cast("bigint").alias("size"))
    return jobs.observed(docs, lambda d: d.write.format("noop").mode("overwrite").save(), "size", f"ingest-{uuid.uuid4().hex}")
