"""Run-log time series: (run, step, value) rows, possibly with one very long run.

Frames with a bounded reach run in independent blocks (``sliding``); unbounded ones are
prefix scans.  Nothing sorts a whole run in one task.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import durable
from .ordered import prefix_scan, ranked, sliding, top_per_group


def rolling_mean(log: DataFrame, k: int, value: str = "value", run: str = "run", step: str = "step") -> DataFrame:
    """Mean over ``k`` records, full windows only."""
    out = sliding(
        log, [run], [step], lambda w: {"rolling": F.avg(value).over(w.rowsBetween(-(k - 1), 0))}, back=k - 1, rank="_rn"
    )
    return out.filter(F.col("_rn") >= k).drop("_rn")


def merge_segments(segments: Sequence[DataFrame], run: str = "run", step: str = "step") -> DataFrame:
    """Stack log segments; of rows with the same step the first segment's stays."""
    stacked = None
    for i, part in enumerate(segments):
        part = part.withColumn("segment", F.lit(i).cast("bigint"))
        stacked = part if stacked is None else stacked.unionByName(part)
    rest = [c for c in stacked.columns if c not in (run, step)]
    first = F.min(F.struct("segment", *[c for c in rest if c != "segment"]))
    return stacked.groupBy(run, step).agg(first.alias("_f")).select(run, step, "_f.*")


def cut_phase(log: DataFrame, marks: Sequence[int], step: str = "step") -> DataFrame:
    """Drop steps before the first mark and number the phases between marks."""
    phase = F.lit(len(marks) - 1)
    for i in range(len(marks) - 2, -1, -1):
        phase = F.when(F.col(step) < marks[i + 1], i).otherwise(phase)
    return log.filter(F.col(step) >= marks[0]).withColumn("phase", phase.cast("bigint"))


class SpikeRule:
    """Recursive threshold: only accepted values enter the history it is computed from."""

    def __init__(self, k: float = 10.0, floor: float = 2000.0, hist: int = 1000, min_n: int = 50, history=()):
        self.k, self.floor, self.hist, self.min_n = k, floor, hist, min_n
        self.recent = list(history)
        self.ordered = sorted(self.recent)

    def judge(self, value: float) -> tuple[bool, float]:
        """(is a spike, threshold); updates the history."""
        n = len(self.ordered)
        limit = max(self.k * self.ordered[n // 2], self.floor) if n >= self.min_n else math.inf
        if value is None or not math.isfinite(value) or value > limit:
            return True, limit
        self.recent.append(value)
        bisect.insort(self.ordered, value)
        if len(self.recent) > self.hist:
            old = self.recent.pop(0)
            del self.ordered[bisect.bisect_left(self.ordered, old)]
        return False, limit


def spike_rounds(
    log: DataFrame,
    k: float = 10.0,
    floor: float = 2000.0,
    hist: int = 1000,
    min_n: int = 50,
    span: int = 1 << 16,
    value: str = "value",
    run: str = "run",
    step: str = "step",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(numbered rows, verdicts of every round, last round of each block) of the spike rule.

    A run is cut into blocks of ``span`` rows.  Every block starts from a guess of the history it inherits, the last
    values of the block before, and all are judged in parallel.  After that only the blocks whose inherited history
    turned out to be another one than they were judged with are judged again, round by round, until none is left; settled
    runs and blocks leave the loop.  Histories hold at most ``hist`` values, and every round settles at least one more
    block of each run, so the verdicts of the last rounds are those of the sequential rule.
    """
    kind = log.schema[run].dataType.simpleString()
    narrow = ranked(log.select(run, step, F.col(value).cast("double").alias("_v")), [run], [step], "_rn")
    narrow = durable(narrow.withColumn("_block", F.floor((F.col("_rn") - 1) / span).cast("bigint")))
    # first guess: the block inherits the last values of the block before, spikes included
    tail = (F.pmod(F.col("_rn") - 1, F.lit(span)) >= span - hist) & F.col("_v").isNotNull() & ~F.isnan("_v")
    guess = (
        narrow.filter(tail)
        .groupBy(run, (F.col("_block") + 1).alias("_block"))
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("_rn", "_v"))), lambda x: x["_v"]).alias("_h"))
    )

    schema = f"{run} {kind}, _block bigint, _rn bigint, spike boolean, limit double, _end array<double>"

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rn")
        start = pdf["_h"].iloc[0]
        rule = SpikeRule(k, floor, hist, min_n, [] if start is None else list(start))
        verdicts = [rule.judge(v) for v in pdf["_v"].tolist()]
        end = [None] * (len(pdf) - 1) + [list(rule.recent)]
        return pd.DataFrame(
            {run: pdf[run], "_block": pdf["_block"], "_rn": pdf["_rn"], "spike": [s for s, _ in verdicts], "limit": [t for _, t in verdicts], "_end": end}
        )

    # What every block was last judged with; its keys are all blocks.
    used = durable(narrow.select(run, "_block").distinct().join(guess, [run, "_block"], "left"))
    work, verdicts, listed = used, [], []
    while not verdicts or not work.isEmpty():
        number = F.lit(len(verdicts))
        judged = durable(narrow.join(work, [run, "_block"]).groupBy(run, "_block").applyInPandas(judge, schema))
        verdicts.append(judged.select(run, "_block", "_rn", "spike", "limit", number.alias("_round")))
        listed.append(work.select(run, "_block", number.alias("_round")))
        if len(verdicts) > 1:
            used = durable(used.join(work, [run, "_block"], "left_anti").unionByName(work))
        ends = judged.filter("_end IS NOT NULL").select(run, (F.col("_block") + 1).alias("_block"), F.col("_end").alias("_h"))
        before = used.withColumnRenamed("_h", "_g")
        work = durable(ends.join(before, [run, "_block"]).filter(~F.col("_h").eqNullSafe(F.col("_g"))).select(run, "_block", "_h"))
    last = reduce(DataFrame.unionByName, listed).groupBy(run, "_block").agg(F.max("_round").alias("_round"))
    return narrow, reduce(DataFrame.unionByName, verdicts), last


def spike_flags(
    log: DataFrame,
    k: float = 10.0,
    floor: float = 2000.0,
    hist: int = 1000,
    min_n: int = 50,
    span: int = 1 << 16,
    value: str = "value",
    run: str = "run",
    step: str = "step",
) -> DataFrame:
    """Flag spikes; exact for runs of any length without holding a run in one task (see ``spike_rounds``)."""
    narrow, verdicts, last = spike_rounds(log, k, floor, hist, min_n, span, value, run, step)
    judged = verdicts.join(last, [run, "_block", "_round"], "left_semi")
    flags = judged.select(run, "_rn", "spike", F.when(F.col("limit") < float("inf"), F.col("limit")).alias("limit"))
    return narrow.join(flags, [run, "_rn"]).select(run, step, F.col("_v").alias(value), "spike", "limit")


def spike_flags_window(
    log: DataFrame, k: float, floor: float, hist: int, min_n: int, value: str = "value", run: str = "run", step: str = "step"
) -> DataFrame:
    """The non-recursive variant: threshold from the last ``hist`` values, spikes included."""

    def exprs(w: Window) -> dict[str, Column]:
        past = w.rowsBetween(-hist, -1)
        return {"_med": F.percentile(value, F.lit(0.5)).over(past), "_n": F.count(value).over(past)}

    out = sliding(log, [run], [step], exprs, back=hist, rank="_rn")
    limit = F.when(F.col("_n") >= min_n, F.greatest(F.col("_med") * k, F.lit(float(floor))))
    return out.withColumn("limit", limit).withColumn("spike", F.coalesce(F.col(value) > limit, F.lit(False))).drop("_med", "_n", "_rn")


def stall_runs(log: DataFrame, n: int, skip: Column, run: str = "run", step: str = "step") -> DataFrame:
    """Stretches of at least ``n`` consecutive skips."""
    flagged = log.select(run, step, skip.alias("_skip"))
    scanned = prefix_scan(flagged, [run], [step], {"_island": ("sum", F.when(F.col("_skip"), 0).otherwise(1).cast("bigint"))})
    return (
        scanned.filter("_skip")
        .groupBy(run, "_island")
        .agg(F.min(step).alias("first_step"), F.max(step).alias("last_step"), F.count(F.lit(1)).alias("n_skips"))
        .filter(F.col("n_skips") >= n)
        .drop("_island")
    )


def running_best(log: DataFrame, value: str = "value", run: str = "run", step: str = "step") -> DataFrame:
    """Smallest value so far and whether this step improved it."""
    out = prefix_scan(log, [run], [step], {"best": ("min", F.col(value)), "_before": ("min_before", F.col(value))})
    return out.withColumn("improved", F.coalesce(F.col(value) < F.col("_before"), F.lit(True))).drop("_before")


def bucket_means(log: DataFrame, width: int, skip: Column, value: str = "value", run: str = "run", step: str = "step") -> DataFrame:
    """Mean per fixed step bucket and skips per mille."""
    return log.groupBy(run, F.floor(F.col(step) / width).cast("bigint").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), (F.avg(skip.cast("double")) * 1000).alias("skip_permille")
    )


def hourly_means(log: DataFrame, value: str = "value", ts: str = "ts") -> DataFrame:
    return log.groupBy(F.window(ts, "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(
        F.col("w.start").alias("hour"), "n", "mean"
    )


def throughput(log: DataFrame, target: float, value: str = "value", run: str = "run", step: str = "step", ts: str = "ts") -> DataFrame:
    """Cumulative amount, rate since the first record, and seconds left to the target."""
    scanned = prefix_scan(log.select(run, step, ts, value), [run], [step], {"cum": ("sum", F.col(value)), "_t0": ("min", F.col(ts))})
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    seconds = (micros(ts) - micros("_t0")) / 1e6
    done = F.col("cum").cast("double")
    rate = F.when(seconds > 0, done / seconds)
    return scanned.withColumn("seconds", seconds).withColumn("rate", rate).withColumn(
        "eta", F.when(rate > 0, F.greatest(F.lit(float(target)) - done, F.lit(0.0)) / rate)
    ).drop("_t0")


def last_values(log: DataFrame, k: int, value: str = "value", run: str = "run", step: str = "step") -> DataFrame:
    """Final value and mean of the last ``k`` values of every run."""
    tail = top_per_group(log, [run], [F.col(step).desc()], k, "_r")
    return tail.groupBy(run).agg(
        F.max(step).alias("last_step"), F.max_by(value, step).alias("last_value"), F.avg(value).alias("tail_mean")
    )


def exposure_ledger(used: DataFrame, stores: DataFrame, planned: float = 0.0) -> DataFrame:
    """Units consumed per store by all runs: whole passes, remainder and projected passes."""
    total = used.groupBy("store").agg(F.sum("units").cast("bigint").alias("used"))
    out = stores.join(total, "store", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    size = F.col("n_units")
    return out.select(
        "store",
        "n_units",
        "used",
        (F.col("used") / size).alias("passes"),
        (size - F.pmod("used", size)).alias("unused"),
        ((F.col("used") + F.lit(float(planned))) / size).alias("projected"),
    )
