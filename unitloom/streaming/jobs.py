"""File-fed streams: segmentation, seen-id filter, spike checks, windowed counts, progress."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import id_hash
from ..operators.runlog import SpikeRule
from ..operators.segment import segment_word

DOCS = "shard STRING, doc_id BIGINT, text STRING"


def file_stream(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def write_batches(stream: DataFrame, dst: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Drain what is there; every micro-batch replaces its own folder, so a retry cannot duplicate rows."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{dst}/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(save)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def stream_segment(spark: SparkSession, src: str, dst: str, checkpoint: str, l_max: int = 32, max_files: int | None = None) -> StreamingQuery:
    """New files become units exactly once per file."""
    docs = file_stream(spark, src, DOCS, max_files).filter("text <> ''")
    return write_batches(segment_word(docs, l_max=l_max), dst, checkpoint)


def stream_drop_seen(stream: DataFrame, seen: DataFrame, key: str, event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Rows with unseen ids, each id once.

    With an event time the memory of ids is bounded by the watermark; without one every
    id is remembered.
    """
    fresh = stream.withColumn("id_hash", id_hash(key)).join(seen, "id_hash", "left_anti")
    if event_time is None:
        return fresh.dropDuplicates(["id_hash"]).drop("id_hash")
    return fresh.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["id_hash"]).drop("id_hash")


def stream_spikes(log: DataFrame, k: float = 10.0, floor: float = 2000.0, hist: int = 1000, min_n: int = 50) -> DataFrame:
    """Spike flags over an arriving log of (run BIGINT, step BIGINT, value DOUBLE).

    State per run is its accepted history (at most ``hist`` values), the length of the
    current series of skips and the last step.  Steps must arrive in order between
    micro-batches; inside one they are sorted.
    """

    def judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        history, skips = (state.get if state.exists else ([], 0))
        rule = SpikeRule(k, floor, hist, min_n, history or [])
        rows = pd.concat(list(frames)).sort_values("step")
        spike, run_of_skips = [], []
        for value in rows["value"].tolist():
            bad, _ = rule.judge(value)
            skips = skips + 1 if bad else 0
            spike.append(bad)
            run_of_skips.append(skips)
        state.update((list(rule.recent), skips))
        yield pd.DataFrame({"run": rows["run"], "step": rows["step"], "value": rows["value"], "spike": spike, "consecutive": run_of_skips})

    return log.groupBy("run").applyInPandasWithState(
        judge,
        "run bigint, step bigint, value double, spike boolean, consecutive bigint",
        "history array<double>, skips bigint",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def stream_counts(stream: DataFrame, by: str, value: str, ts: str = "ts", width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Counts and sums per source and event-time window; rows later than ``delay`` are dropped."""
    return (
        stream.withWatermark(ts, delay)
        .groupBy(F.window(ts, width).alias("w"), by)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        .select(F.col("w.start").alias("window_start"), by, "n", "total")
    )


def observed(df: DataFrame, run: Callable[[DataFrame], None], size: str, name: str = "ingest") -> DataFrame:
    """Rows and bytes a job passed through, measured while it ran."""
    watch = Observation(name)
    run(df.observe(watch, F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes")))
    got = watch.get
    return df.sparkSession.createDataFrame([(got["rows"], got["bytes"])], "rows bigint, bytes bigint")


def ingest_progress(query: StreamingQuery) -> list[dict]:
    """Input rows and rate of every micro-batch of a finished or running query."""
    return [
        {"batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond} for p in query.recentProgress
    ]
