"""Registered queries: run-log time series over ``events`` (user = run, order = ts, event_id)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runlog as rl, segment as seg
from ..operators.ordered import ranked
from .common_sql import RUNLOG, UNITS
from .registry import documents, query, table
from .statistics import rounded


def run_log(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("run"), "event_id", "ts", "event_type", "value")
    return ranked(e, ["run"], ["ts", "event_id"], "step")


@query(
    "I1_rolling_mean",
    f"""WITH {RUNLOG} SELECT run, step, round(avg(value) OVER (PARTITION BY run ORDER BY step ROWS 4 PRECEDING), 6) AS rolling FROM runlog QUALIFY step >= 5""",
)
def rolling_mean(spark, sf):
    return rounded(rl.rolling_mean(run_log(spark, sf).select("run", "step", "value"), 5), "rolling").select("run", "step", "rolling")


@query(
    "I2_merge_segments",
    f"""WITH {RUNLOG}, s AS (SELECT run, step, value, 0 AS segment FROM runlog WHERE step <= 40 UNION ALL SELECT run, step, value + 1000, 1 FROM runlog WHERE step >= 20)
    SELECT run, step, segment::BIGINT AS segment, value FROM s QUALIFY row_number() OVER (PARTITION BY run, step ORDER BY segment) = 1""",
)
def merge_segments(spark, sf):
    log = run_log(spark, sf).select("run", "step", "value")
    return rl.merge_segments([log.filter("step <= 40"), log.filter("step >= 20").withColumn("value", F.col("value") + 1000)])


@query("I3_cut_phase", f"WITH {RUNLOG} SELECT run, step, value, CASE WHEN step < 30 THEN 0 WHEN step < 60 THEN 1 ELSE 2 END::BIGINT AS phase FROM runlog WHERE step >= 10")
def cut_phase(spark, sf):
    return rl.cut_phase(run_log(spark, sf), [10, 30, 60]).select("run", "step", "value", "phase")


#: The recursive rule row by row: k = 3, floor 0, 20 accepted values remembered, 5 needed.
SPIKES = f"""{RUNLOG}, m AS MATERIALIZED (SELECT run, step, value FROM runlog),
    flagged AS (
      SELECT run, step, value, value IS NULL OR NOT isfinite(value) AS spike, CAST(NULL AS DOUBLE) AS lim,
        CASE WHEN value IS NULL OR NOT isfinite(value) THEN CAST([] AS DOUBLE[]) ELSE [value] END AS h, (value IS NULL OR NOT isfinite(value))::BIGINT AS consecutive
      FROM m WHERE step = 1
      UNION ALL
      SELECT run, step, value, spike, lim, CASE WHEN spike THEN h WHEN len(h) >= 20 THEN list_append(h[2:], value) ELSE list_append(h, value) END,
        CASE WHEN spike THEN consecutive + 1 ELSE 0 END
      FROM (SELECT *, value IS NULL OR NOT isfinite(value) OR coalesce(value > lim, false) AS spike
            FROM (SELECT m.run, m.step, m.value, h, consecutive, CASE WHEN len(h) >= 5 THEN greatest(3.0::DOUBLE * list_sort(h)[len(h) // 2 + 1], 0.0::DOUBLE) END AS lim
                  FROM flagged JOIN m ON m.run = flagged.run AND m.step = flagged.step + 1)))"""


@query("I4_spike_flags", f'WITH RECURSIVE {SPIKES} SELECT run, step, value, spike, lim AS "limit" FROM flagged')
def spike_flags(spark, sf):
    return rl.spike_flags(run_log(spark, sf), k=3.0, floor=0.0, hist=20, min_n=5)


@query(
    "I4_spike_flags_window",
    f"""WITH {RUNLOG}, m AS (SELECT run, step, value, quantile_cont(value, 0.5) OVER w AS med, count(value) OVER w AS n FROM runlog WINDOW w AS (PARTITION BY run ORDER BY step ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
    l AS (SELECT *, CASE WHEN n >= 5 THEN greatest(med * 3, 0) END AS lim FROM m)
    SELECT run, step, value, round(lim, 6) AS "limit", coalesce(value > lim, false) AS spike FROM l""",
)
def spike_flags_window(spark, sf):
    log = run_log(spark, sf).select("run", "step", "value")
    return rounded(rl.spike_flags_window(log, 3.0, 0.0, 20, 5), "limit")


@query(
    "I5_stall_runs",
    f"""WITH {RUNLOG}, i AS (SELECT *, sum((event_type <> 'error')::INT) OVER (PARTITION BY run ORDER BY step) AS isl FROM runlog)
    SELECT run, min(step) AS first_step, max(step) AS last_step, count(*) AS n_skips FROM i WHERE event_type = 'error' GROUP BY run, isl HAVING count(*) >= 2""",
)
def stall_runs(spark, sf):
    return rl.stall_runs(run_log(spark, sf), 2, F.col("event_type") == "error")


@query(
    "I6_running_best",
    f"""WITH {RUNLOG} SELECT run, step, value, min(value) OVER (PARTITION BY run ORDER BY step) AS best,
      coalesce(value < min(value) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM runlog""",
)
def running_best(spark, sf):
    return rl.running_best(run_log(spark, sf).select("run", "step", "value"))


@query(
    "I7_bucket_means",
    f"""WITH {RUNLOG} SELECT run, step // 10 AS bucket, count(*) AS n, round(avg(value), 6) AS mean, round(avg((event_type = 'error')::INT) * 1000, 6) AS skip_permille FROM runlog GROUP BY 1, 2""",
)
def bucket_means(spark, sf):
    return rounded(rl.bucket_means(run_log(spark, sf), 10, F.col("event_type") == "error"), "mean", "skip_permille")


@query("I7_hourly_means", "SELECT date_trunc('hour', ts) AS hour, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def hourly_means(spark, sf):
    return rounded(rl.hourly_means(table(spark, sf, "events")), "mean")


@query(
    "I8_throughput",
    f"""WITH {RUNLOG}, c AS (SELECT run, step, (sum(value::DECIMAL(18, 2)) OVER w)::DOUBLE AS cum, (epoch_us(ts) - min(epoch_us(ts)) OVER w) / 1e6 AS seconds FROM runlog WINDOW w AS (PARTITION BY run ORDER BY step))
    SELECT run, step, cum, round(seconds, 3) AS seconds, round(CASE WHEN seconds > 0 THEN cum / seconds END, 9) AS rate,
      round(CASE WHEN seconds > 0 AND cum > 0 THEN greatest(5000 - cum, 0) / (cum / seconds) END, 2) AS eta FROM c""",
)
def throughput(spark, sf):
    log = run_log(spark, sf).withColumn("value", F.col("value").cast("decimal(18,2)"))
    out = rl.throughput(log, 5000.0)
    return out.select("run", "step", F.col("cum").cast("double").alias("cum"), F.round("seconds", 3).alias("seconds"), F.round("rate", 9).alias("rate"), F.round("eta", 2).alias("eta"))


@query(
    "I9_last_values",
    f"""WITH {RUNLOG}, r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS r FROM runlog)
    SELECT run, max(step) AS last_step, arg_max(value, step) AS last_value, round(avg(value), 6) AS tail_mean FROM r WHERE r <= 10 GROUP BY run""",
)
def last_values(spark, sf):
    return rounded(rl.last_values(run_log(spark, sf), 10), "tail_mean")


@query(
    "I10_exposure_ledger",
    f"""WITH {UNITS}, s AS (SELECT shard AS store, count(*) AS n_units FROM units GROUP BY shard), u AS (SELECT 'src' || (user_id % 20) AS store, sum(floor(value * 100))::BIGINT AS used FROM events GROUP BY 1)
    SELECT store, n_units, coalesce(used, 0)::BIGINT AS used, round(coalesce(used, 0) / n_units, 6) AS passes, (n_units - coalesce(used, 0) % n_units)::BIGINT AS unused,
      round((coalesce(used, 0) + 50000) / n_units, 6) AS projected FROM s LEFT JOIN u USING (store)""",
)
def exposure_ledger(spark, sf):
    events = table(spark, sf, "events")
    used = events.select(
        F.concat(F.lit("src"), F.pmod("user_id", F.lit(20)).cast("string")).alias("store"), F.floor(F.col("value") * 100).alias("units")
    )
    stores = seg.unit_counts(documents(spark, sf)).groupBy(F.col("shard").alias("store")).agg(F.sum("n_units").alias("n_units"))
    return rounded(rl.exposure_ledger(used, stores, 50000.0), "passes", "projected")
