"""Evaluation over score tables.

A choice table holds one row per (item, choice): ``raw`` score, ``uncond`` score,
``n_units``, ``n_chars``, ``gold`` and optional grouping columns.  Per-item picks are
aggregates with map-side combining, never windows over an item.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import ratio, stderr
from ..session import ship
from .ordered import one_row, prefix_scan, ranked, top_per_group
from .stats import byte_class
from .windows import gather_windows


def with_scores(choices: DataFrame) -> DataFrame:
    """Add the four score variants."""
    units = F.greatest(F.col("n_units"), F.lit(1))
    return choices.select(
        "*",
        F.col("raw").alias("s_raw"),
        (F.col("raw") / units).alias("s_unit"),
        (F.col("raw") / F.greatest(F.col("n_chars"), F.lit(1))).alias("s_char"),
        ((F.col("raw") - F.col("uncond")) / units).alias("s_unit_pmi"),
    )


VARIANTS = ("s_raw", "s_unit", "s_char", "s_unit_pmi")


def best_choice(score: str, choice: str = "choice_idx") -> Column:
    """Choice with the highest score; ties go to the smallest index."""
    return F.max(F.struct(F.col(score).alias("s"), (-F.col(choice)).alias("c")))["c"] * -1


def item_picks(choices: DataFrame, by: Sequence[str] = (), item: str = "item_id") -> DataFrame:
    """One row per item: the pick of every score variant and the gold index."""
    scored = with_scores(choices)
    return scored.groupBy(item).agg(
        *[F.min(c).alias(c) for c in by],
        F.min("gold").alias("gold"),
        *[best_choice(v).cast("bigint").alias(v.replace("s_", "pick_", 1)) for v in VARIANTS],
    )


def group_choices(choices: DataFrame, item: str = "item_id") -> DataFrame:
    """Requests regrouped to items, choices in order; an item is one question with its few candidates."""
    ordered = F.sort_array(F.collect_list(F.struct("choice_idx", "raw", "n_units", "n_chars")))
    return choices.groupBy(item).agg(ordered.alias("choices"), F.min("gold").alias("gold"))


def mc_accuracy(picks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy per score variant, long form.

    ``acc`` divides by all items, as published numbers do; ``acc_valid`` only by items
    with a usable gold index.
    """
    long = picks.select(
        *by,
        "gold",
        F.explode(
            F.array(*[F.struct(F.lit(v.replace("s_", "acc_", 1)).alias("metric"), F.col(v.replace("s_", "pick_", 1)).alias("pick")) for v in VARIANTS])
        ).alias("m"),
    )
    hit = ((F.col("gold") >= 0) & (F.col("m.pick") == F.col("gold"))).cast("bigint")
    out = long.groupBy(*by, F.col("m.metric").alias("metric")).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("gold") >= 0).cast("bigint")).alias("n_valid"), F.sum(hit).alias("n_hit")
    )
    out = out.withColumn("acc", ratio("n_hit", "n")).withColumn("acc_valid", ratio("n_hit", "n_valid"))
    return out.withColumn("stderr", stderr("acc", "n"))


def pearson(x: str, y: str) -> Column:
    """Correlation as an aggregate; NULL below three points or without variance."""
    vx, vy = F.var_pop(x), F.var_pop(y)
    return F.when((F.count(F.lit(1)) >= 3) & (vx > 0) & (vy > 0), F.covar_pop(x, y) / F.sqrt(vx * vy))


def length_bias(choices: DataFrame, item: str = "item_id", by: Sequence[str] = ()) -> DataFrame:
    """Score-length correlations (pooled and within item), tie rate and shortest/longest picks, for all items or per ``by``.

    ``by`` are properties of an item (its smallest value counts, as in ``item_picks``).
    """
    scored = with_scores(choices)
    best = scored.groupBy(item).agg(
        *[F.min(c).alias(f"_by_{c}") for c in by],
        F.max("s_unit").alias("_best"),
        best_choice("s_unit").alias("_pick"),
        (F.min(F.struct("n_chars", "choice_idx"))["choice_idx"]).alias("_short"),
        (F.max(F.struct(F.col("n_chars"), (-F.col("choice_idx")).alias("c")))["c"] * -1).alias("_long"),
        F.avg("n_units").alias("_mean_units"),
        F.avg("s_unit").alias("_mean_score"),
        F.avg("s_unit_pmi").alias("_mean_pmi"),
    )
    # Centred by the item's means before squaring, so that large scores that are alike don't cancel.
    rows = scored.select(item, "n_chars", "raw", "n_units", "s_unit", "s_unit_pmi").join(best, item).select(
        item, *[F.col(f"_by_{c}").alias(c) for c in by], "n_chars", "raw", "n_units", "s_unit", "_pick", "_short", "_long", "_mean_units",
        (F.col("n_units") - F.col("_mean_units")).alias("_dx"),
        (F.col("s_unit") - F.col("_mean_score")).alias("_dy"),
        (F.col("s_unit_pmi") - F.col("_mean_pmi")).alias("_dz"),
        (F.abs(F.col("s_unit") - F.col("_best")) < 1e-9).cast("bigint").alias("_close"),
    )

    def within(y: str) -> Column:
        xx, yy = F.sum(F.col("_dx") * F.col("_dx")), F.sum(F.col(y) * F.col(y))
        return F.when((F.count(F.lit(1)) >= 3) & (xx > 1e-9) & (yy > 1e-9), F.sum(F.col("_dx") * F.col(y)) / F.sqrt(xx * yy))

    per_choice = rows.groupBy(*by).agg(
        within("_dy").alias("r_within"),
        within("_dz").alias("r_within_pmi"),
        pearson("n_chars", "raw").alias("r_raw_chars"),
        pearson("n_units", "s_unit").alias("r_unit_units"),
        F.count(F.lit(1)).alias("n_choices"),
    )
    items = rows.groupBy(item, *by).agg(
        F.sum("_close").alias("_c"), *[F.first(c).alias(c) for c in ("_pick", "_short", "_long", "_mean_units")]
    )
    per_item = items.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_items"),
        F.avg("_mean_units").alias("n_units_mean"),
        F.avg((F.col("_pick") == F.col("_short")).cast("double")).alias("eq_shortest"),
        F.avg((F.col("_pick") == F.col("_long")).cast("double")).alias("eq_longest"),
        F.coalesce(F.sum((F.col("_c") > 1).cast("bigint")), F.lit(0)).alias("n_ties"),
    )
    both = per_item.join(per_choice, list(by)) if by else per_item.transform(one_row, per_choice)
    return both.withColumn("tie_rate", ratio("n_ties", "n_items"))


def shortest_gate(choices: DataFrame, item: str = "item_id", margin: float = 0.04, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy must beat always picking the shortest choice, and short picks must not exceed chance + 2 sigma.

    For all items, or per ``by``, properties of an item.
    """
    per_item = with_scores(choices).groupBy(item).agg(
        *[F.min(c).alias(c) for c in by],
        best_choice("s_unit").alias("pick"),
        F.min(F.struct("n_chars", "choice_idx"))["choice_idx"].alias("short"),
        F.min("gold").alias("gold"),
    )
    n = F.count(F.lit(1))
    out = per_item.groupBy(*by).agg(
        n.alias("n"),
        F.avg((F.col("pick") == F.col("gold")).cast("double")).alias("acc_unit"),
        F.avg((F.col("short") == F.col("gold")).cast("double")).alias("baseline"),
        F.avg((F.col("pick") == F.col("short")).cast("double")).alias("short_rate"),
    )
    limit = F.lit(0.25) + 2 * F.sqrt(F.lit(0.25 * 0.75) / F.col("n"))
    return out.withColumn("limit", limit).withColumn(
        "passed", (F.col("acc_unit") >= F.col("baseline") + margin) & (F.col("short_rate") <= F.col("limit"))
    )


def run_checks(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Named pass/fail rules over one row of metrics, plus the overall verdict."""
    checks = F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(r, F.lit(False)).alias("passed")) for n, r in rules.items()])
    rows = df.select(checks.alias("_c"))
    overall = F.array(F.struct(F.lit("OVERALL").alias("check"), F.forall("_c", lambda c: c["passed"]).alias("passed")))
    return rows.select(F.explode(F.concat("_c", overall)).alias("c")).select("c.check", "c.passed")


def compare_runs(
    results: DataFrame, base: str, tags: Sequence[str], invalid: Sequence[str] = (), metric: str = "acc", by: Sequence[str] = ()
) -> DataFrame:
    """Task by tag table with deltas to ``base``, and a MEAN row over valid tasks only; one such table per ``by``."""
    wide = results.groupBy(*by, "task").pivot("tag", list(tags)).agg(F.first(metric))
    wide = wide.withColumn("valid", ~F.col("task").isin(list(invalid)))
    mean = wide.filter("valid").groupBy(*by).agg(*[F.avg(f"`{t}`").alias(t) for t in tags])
    mean = mean.select(*by, F.lit("MEAN").alias("task"), *tags, F.lit(True).alias("valid"))
    both = wide.unionByName(mean)
    return both.select("*", *[(F.col(f"`{t}`") - F.col(f"`{base}`")).alias(f"d_{t}") for t in tags if t != base])


def paired_delta(a: DataFrame, b: DataFrame, item: str = "item_id", value: str = "hit") -> DataFrame:
    """Mean same-item difference b - a with a 95% interval and discordant counts."""
    both = a.select(item, F.col(value).cast("double").alias("_a")).join(b.select(item, F.col(value).cast("double").alias("_b")), item)
    d = F.col("_b") - F.col("_a")
    half = 1.96 * F.stddev_samp(d) / F.sqrt(F.count(F.lit(1)))
    return both.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(d).alias("delta"),
        (F.avg(d) - half).alias("low"),
        (F.avg(d) + half).alias("high"),
        F.sum((d > 0).cast("bigint")).alias("only_b"),
        F.sum((d < 0).cast("bigint")).alias("only_a"),
    )


def subset_vs_full(items: DataFrame, n: int, item: str = "item_id", value: str = "hit", by: Sequence[str] = ()) -> DataFrame:
    """Metric over the first ``n`` items of each group next to the metric over all."""
    placed = ranked(items.select(*by, item, F.col(value).cast("double").alias("_v")), list(by), [item], "_place")
    return placed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_full"),
        F.avg("_v").alias("full"),
        F.sum((F.col("_place") <= n).cast("bigint")).alias("n_subset"),
        F.avg(F.when(F.col("_place") <= n, F.col("_v"))).alias("subset"),
    ).withColumn("gap", F.col("subset") - F.col("full"))


def topk_coverage(choices: DataFrame, k: int, item: str = "item_id") -> DataFrame:
    """Share of items whose gold is among the ``k`` best choices, and the gap to the single best."""
    top = top_per_group(with_scores(choices), [item], [F.col("s_unit").desc(), F.col("choice_idx")], k, "_r")
    hit = F.col("choice_idx") == F.col("gold")
    per_item = top.groupBy(item).agg(F.max(hit).alias("in_k"), F.max(hit & (F.col("_r") == 1)).alias("first"))
    return per_item.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("in_k").cast("double")).alias("coverage"), F.avg(F.col("first").cast("double")).alias("argmax")
    ).withColumn("gap", F.col("coverage") - F.col("argmax"))


def softmax_share(choices: DataFrame, score: str, temperature: float, item: str = "item_id") -> DataFrame:
    """Per item: best choice, its softmax share and the gold."""
    top = choices.groupBy(item).agg(F.max(score).alias("_m"), best_choice(score).cast("bigint").alias("pick"), F.min("gold").alias("gold"))
    mass = choices.select(item, score).join(top, item).groupBy(item).agg(
        F.sum(F.exp((F.col(score) - F.col("_m")) / temperature)).alias("_z"), F.first("pick").alias("pick"), F.first("gold").alias("gold"), F.first("_m").alias("best")
    )
    return mass.select(item, "pick", "gold", "best", (1 / F.col("_z")).alias("share"))


def confident_errors(shares: DataFrame, context: DataFrame, n: int, floor: float = 0.4, item: str = "item_id") -> DataFrame:
    """The ``n`` wrong items with the highest share, with their context."""
    wrong = shares.filter((F.col("pick") != F.col("gold")) & (F.col("share") >= floor))
    worst = wrong.orderBy(F.col("share").desc(), item).limit(n)
    return context.join(F.broadcast(worst), item)


def stratified_loss(cells: DataFrame, by: Sequence[str | Sequence[str]], value: str, count: str | None = None) -> DataFrame:
    """Mean of ``value`` along each stratum separately; a stratum is a column or several taken together.

    The stream is reduced to the joint cells first; the grouping sets then run over
    those few rows instead of multiplying the stream.
    """
    weight = F.lit(1) if count is None else F.col(count)
    sets = [[c] if isinstance(c, str) else list(c) for c in by]
    columns = list(dict.fromkeys(c for one in sets for c in one))
    joint = cells.groupBy(*columns).agg(F.sum(F.col(value) * weight).alias("_s"), F.sum(weight).alias("_n"))
    grouped = joint.groupingSets([[F.col(c) for c in one] for one in sets], *[F.col(c) for c in columns])
    return grouped.agg(F.sum("_n").alias("n"), (F.sum("_s") / F.sum("_n")).alias("mean"))


def target_attributes(windowed: DataFrame, n: int, k_max: int, key: str = "window_id", counted: bool = False) -> DataFrame:
    """Every target byte of ``windows.future_targets`` with what it is in its window's byte string.

    Columns: ``delta`` and ``byte`` as there, ``class`` of the byte, ``word_len`` the length class of its word, ``place``
    of a letter in its word, and for the byte that comes next (delta 1) ``ahead``: whether the word ends behind it.
    Words are runs without blanks and may cross unit borders.  A byte is described once, however many units it is a
    target of, and equal targets of some windows are counted together; ``counted`` gives them once, with their
    number ``n``, instead of as so many rows.
    """
    ship(windowed.sparkSession)
    found = gather_windows(windowed, [key]).select("units").mapInArrow(_target_counts(n, k_max), TARGETS)
    kind = byte_class(F.col("byte").cast("int"))
    names = F.array(*[F.lit(x) for x in WORD_LENGTHS])
    place = F.when(kind == "letter", F.get(F.array(F.lit("mid"), F.lit("last"), F.lit("first")), F.col("at"))).when(kind == "space", "space")
    columns = {
        "delta": F.col("delta"),
        "byte": F.col("byte"),
        "class": kind,
        "word_len": F.get(names, F.col("length")),
        "place": F.coalesce(place, F.lit("none")),
        "ahead": F.when(F.col("delta") > 1, "later").when(F.col("blank"), "end").otherwise("inside"),
    }
    found = found.select(*[c.alias(name) for name, c in columns.items()], "n")
    if counted:
        return found.groupBy(*columns).agg(F.sum("n").alias("n"))
    return found.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n")


#: Length classes of words; a blank is in none.
WORD_LENGTHS = ("none", "1-2", "3-5", "6-8", "9+")
#: Target bytes of some windows: length class, place (0 middle, 1 last, 2 first) and whether a blank follows.
TARGETS = "delta long, byte long, length int, at int, blank boolean, n long"
#: Windows whose targets are counted together.
WINDOWS_TOGETHER = 256


def _target_counts(n: int, k_max: int):
    """Counted targets of windows (units)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, WINDOWS_TOGETHER):
                units = batch.column(0).slice(low, WINDOWS_TOGETHER)
                held = pc.list_value_length(units).to_numpy(zero_copy_only=False).astype(np.int64)
                unit = units.flatten().cast(pa.large_binary())
                text = np.frombuffer(b"".join(unit.to_pylist()), np.uint8)
                stop = np.cumsum(pc.binary_length(unit).to_numpy(zero_copy_only=False).astype(np.int64))
                last = np.repeat(np.cumsum(held), held) - 1  # a unit's last unit of its window
                close = np.unique(np.r_[0, stop[last]]) if len(stop) else np.zeros(1, np.int64)
                code = _described(text, close)
                # Targets begin behind a unit and end with the n-th after it.
                size = np.minimum(stop[np.minimum(np.arange(len(stop)) + n, last)] - stop, k_max)
                for delta in range(1, int(size.max(initial=0)) + 1):
                    times = np.bincount(code[stop[size >= delta] + delta - 1])
                    kinds = np.flatnonzero(times)
                    rest, blank = np.divmod(kinds, 2)
                    rest, at = np.divmod(rest, 3)
                    byte, length = np.divmod(rest, len(WORD_LENGTHS))
                    columns = [np.full(len(kinds), delta), byte, length.astype(np.int32), at.astype(np.int32), blank.astype(bool), times[kinds]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in TARGETS.split(", ")])

    return run


def _described(text: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """A number for each byte: its value, its word's length class, its place there and whether a blank follows in its window."""
    blank = text == 32
    opens = np.zeros(len(text) + 1, dtype=bool)
    opens[borders] = True
    inner = ~opens[1:]  # not the last byte of a window
    opens[:-1] |= blank
    opens[1:] |= blank
    first = np.flatnonzero(opens[:-1])
    run = np.diff(np.r_[first, len(text)])
    size = np.repeat(run, run)
    length = np.where(blank, 0, 1 + np.searchsorted([2, 5, 8], size))
    at = np.where(opens[:-1], 2, opens[1:].astype(np.int64))
    at[-1:] = np.where(opens[len(text) - 1 : -1], 2, 1)
    follows = np.r_[blank[1:], False] & inner
    return ((text.astype(np.int64) * len(WORD_LENGTHS) + length) * 3 + at) * 2 + follows


def trend_violations(
    curve: DataFrame, series: str, x: str, y: str, step_tol: float = 0.005, range_tol: float = 0.05, growing: Sequence[str] = ()
) -> DataFrame:
    """How often a curve rises or falls by more than ``step_tol``, its range and a verdict.

    FAIL: the curve's range is under ``range_tol``, so it says nothing.  WARN: it rises somewhere, or, for a series in
    ``growing``, which should rise, it falls somewhere.
    """
    order = Window.partitionBy(series).orderBy(x)
    step = curve.withColumn("_d", F.col(y) - F.lag(y).over(order))
    out = step.groupBy(series).agg(
        F.sum((F.col("_d") > step_tol).cast("bigint")).alias("rises"),
        F.sum((F.col("_d") < -step_tol).cast("bigint")).alias("falls"),
        (F.max(y) - F.min(y)).alias("range"),
    )
    against = F.when(F.col(series).isin(*growing), F.col("falls")).otherwise(F.col("rises")) if growing else F.col("rises")
    verdict = F.when(F.col("range") < range_tol, "FAIL").when(against > 0, "WARN").otherwise("OK")
    return out.withColumn("verdict", verdict)


def side_by_side(sections: DataFrame, models: Sequence[str], file: str = "file") -> DataFrame:
    """Prompt by readout rows, one text column per model."""
    wide = sections.groupBy("prompt_id", "readout").pivot(file, list(models)).agg(F.first("text"))
    return wide.select("prompt_id", "readout", *[F.coalesce(F.nullif(F.col(f"`{m}`"), F.lit("")), F.lit("(empty)")).alias(m) for m in models])


def regression_alarm(series: DataFrame, metric: str, base: float | Column, limit: float) -> DataFrame:
    """Rows whose metric exceeds the baseline by more than ``limit``."""
    base = base if isinstance(base, Column) else F.lit(float(base))
    return series.withColumn("excess", F.col(metric) - base).withColumn("alarm", F.col("excess") > limit)


def auroc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve per group, ties sharing their rank.

    Rows are counted per distinct score before anything is ordered.
    """
    group = list(by) or ["_one"]
    src = df if by else df.withColumn("_one", F.lit(0))
    levels = src.groupBy(*group, score).agg(
        F.sum(F.when(F.col(label), 1).otherwise(0)).cast("bigint").alias("_p"), F.sum(F.when(F.col(label), 0).otherwise(1)).cast("bigint").alias("_q")
    )
    run = prefix_scan(levels, group, [score], {"_below": ("sum_before", F.col("_q"))})
    area = F.sum(F.col("_p") * (F.coalesce("_below", F.lit(0)) + F.col("_q") / 2))
    out = run.groupBy(*group).agg(F.sum("_p").alias("n_pos"), F.sum("_q").alias("n_neg"), area.alias("_a"))
    return out.select(*by, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_a") / (F.col("n_pos") * F.col("n_neg"))).alias("auroc"))
