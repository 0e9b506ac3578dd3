"""Corpus statistics over units.

Nearly everything starts from ``unit_counts_table``: one shuffle keyed by the unit
after map-side combining, so a unit that is a third of the stream costs one row per
task.  Later steps work on distinct units only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import byte_levenshtein, byte_text, canonical_form, id_hash, ratio, unit_type
from .ordered import one_row, prefix_scan, ranked, top_per_group


def count_doc_units(docs: DataFrame, unit_array: Column, by: Sequence[str] = ()) -> DataFrame:
    """Count units straight from the split array, without building unit rows first."""
    return docs.select(*by, F.explode(unit_array).alias("unit")).groupBy(*by, "unit").agg(F.count(F.lit(1)).alias("cnt"))


def unit_freq(freq: DataFrame, topn: int | None = None) -> DataFrame:
    """Counts with rank (count descending, then unit) and cumulative share."""
    total = freq.agg(F.sum("cnt").alias("total"))
    order = [F.col("cnt").desc(), F.col("unit")]
    if topn is not None and topn <= 10000:
        top = freq.orderBy(*order).limit(topn)
        # at most ``topn`` rows are left, so one small window is enough
        w = Window.partitionBy(F.lit(0)).orderBy(*order)
        out = top.select(
            "unit",
            "cnt",
            F.row_number().over(w).cast("bigint").alias("rnk"),
            F.sum("cnt").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_cum"),
        )
    else:
        out = prefix_scan(freq, [], order, {"rnk": ("count", F.lit(1)), "_cum": ("sum", F.col("cnt"))})
        out = out if topn is None else out.filter(F.col("rnk") <= topn)
    return out.transform(one_row, total).select("unit", "cnt", "rnk", (F.col("_cum") / F.col("total")).alias("cum_share"))


def coverage_curve(freq: DataFrame, marks: Sequence[int]) -> DataFrame:
    """Share of all occurrences held by the top k units, for each k in ``marks``.

    Units with the same count are interchangeable here, so the running sum goes over
    distinct counts (at most the square root of twice the stream) and not over units.
    """
    levels = freq.groupBy("cnt").agg(F.count(F.lit(1)).alias("n"))
    running = prefix_scan(
        levels,
        [],
        [F.col("cnt").desc()],
        {"rank_end": ("sum", F.col("n")), "cum_end": ("sum", F.col("n") * F.col("cnt"))},
    ).withColumn("mark", F.explode(F.lit(list(marks)).cast("array<bigint>")))
    # the part of this level inside the top ``mark`` units
    inside = F.greatest(F.least(F.col("n"), F.col("mark") - (F.col("rank_end") - F.col("n"))), F.lit(0))
    return running.groupBy("mark").agg(
        F.sum(inside * F.col("cnt")).alias("covered"), F.sum(F.col("n") * F.col("cnt")).alias("total")
    ).select("mark", (F.col("covered") / F.col("total")).alias("share"))


def oov_coverage(eval_freq: DataFrame, table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of evaluation occurrences whose unit is in ``table`` (both sides counted first)."""
    hits = eval_freq.join(table.select("unit", F.lit(1).alias("hit")), "unit", "left")
    return hits.groupBy(*by).agg(
        F.sum("cnt").alias("n"),
        F.sum(F.when(F.col("hit").isNotNull(), F.col("cnt")).otherwise(0)).alias("covered"),
    ).withColumn("coverage", ratio("covered", "n"))


def freq_bucket(count: Column) -> Column:
    return (
        F.when(F.coalesce(count, F.lit(0)) == 0, "zero").when(count <= 3, "low").when(count <= 63, "mid").otherwise("high")
    )


def freq_buckets(eval_freq: DataFrame, freq: DataFrame, metrics: Mapping[str, Column] | None = None) -> DataFrame:
    """Evaluation occurrences per frequency stratum, with the mean over occurrences of each of ``metrics`` (unit length by default)."""
    metrics = metrics or {"mean_bytes": F.octet_length("unit")}
    joined = eval_freq.join(freq.select("unit", F.col("cnt").alias("seen")), "unit", "left")
    return joined.groupBy(freq_bucket(F.col("seen")).alias("bucket")).agg(
        F.sum("cnt").alias("n"),
        F.count(F.lit(1)).alias("n_distinct"),
        *[(F.sum(F.col("cnt") * value) / F.sum("cnt")).alias(name) for name, value in metrics.items()],
    )


def distinct_growth(placed: DataFrame, ladder: Sequence[int], approx: bool = False) -> DataFrame:
    """Distinct units after the first k sampled windows; input has (unit, place), place 1-based."""
    steps = F.explode(F.lit(list(ladder)).cast("array<bigint>"))
    if approx:
        reach = placed.withColumn("step", steps).filter("place <= step")
        return reach.groupBy("step").agg(F.approx_count_distinct("unit").alias("n_distinct"))
    first = placed.groupBy("unit").agg(F.min("place").alias("first"))
    per_place = first.groupBy("first").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_place.withColumn("step", steps)
        .filter("first <= step")
        .groupBy("step")
        .agg(F.sum("n").alias("n_distinct"))
    )


def heaps_fit(curve: DataFrame, n_units: str, n_distinct: str, target: DataFrame) -> DataFrame:
    """Log-log least squares; extrapolates to the unit total in the one-row ``target``."""
    x, y = F.log(F.col(n_units)), F.log(F.col(n_distinct))
    fit = curve.agg(F.regr_slope(y, x).alias("beta"), F.regr_intercept(y, x).alias("log_k"))
    return fit.transform(one_row, target).select(
        "beta", "log_k", (F.exp("log_k") * F.pow(F.col("total"), F.col("beta"))).alias("estimate")
    )


def weighted_percentile(value: str, weight: str, p: float) -> Column:
    """Exact interpolated percentile of counted values."""
    return F.percentile(F.col(value), F.lit(p), F.col(weight))


def length_profile(freq: DataFrame, by: Sequence[str] = (), short: int = 8) -> DataFrame:
    """Byte-length statistics per group, from counts per distinct unit."""
    sized = freq.groupBy(*by, F.octet_length("unit").cast("bigint").alias("size")).agg(F.sum("cnt").alias("cnt"))
    return sized.groupBy(*by).agg(
        F.sum("cnt").alias("n"),
        (F.sum(F.col("size") * F.col("cnt")) / F.sum("cnt")).alias("mean"),
        weighted_percentile("size", "cnt", 0.5).alias("p50"),
        weighted_percentile("size", "cnt", 0.9).alias("p90"),
        weighted_percentile("size", "cnt", 0.99).alias("p99"),
        F.max("size").alias("max"),
        (F.sum(F.when(F.col("size") <= short, F.col("cnt")).otherwise(0)) / F.sum("cnt")).alias("short_share"),
    )


def length_histogram(freq: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return freq.groupBy(*by, F.octet_length("unit").cast("bigint").alias("size")).agg(
        F.sum("cnt").alias("cnt"), F.count(F.lit(1)).alias("n_distinct")
    )


def sample_per_length(freq: DataFrame, n: int, seed: int) -> DataFrame:
    """The same number of distinct units for every byte length."""
    sized = freq.select("unit", F.octet_length("unit").cast("bigint").alias("size")).withColumn("_h", id_hash(F.lit(str(seed)), "unit"))
    return top_per_group(sized, ["size"], ["_h", "unit"], n, "place").drop("_h")


def type_profile(freq: DataFrame) -> DataFrame:
    return freq.groupBy(unit_type("unit").alias("type")).agg(
        F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("n_distinct")
    )


def byte_class(code: Column) -> Column:
    # The codes of each class, in the order in which classes are tried.
    return (
        F.when(code.isin(32, 9, 10, 13), "space")
        .when(code.between(48, 57), "digit")
        .when(code.between(65, 90) | code.between(97, 122), "letter")
        .when(code.isin(46, 44, 33, 63, 59, 58, 39, 34, 45, 40, 41), "punct")
        .otherwise("other")
    )


def char_profile(docs: DataFrame, text: str = "text", cap: int = 12) -> DataFrame:
    """Bytes by class, word length, position in word and whether a space follows.

    Words are space-separated byte runs.  Words are counted before they are taken
    apart, so bytes are only expanded once per distinct word.
    """
    pieces = F.regexp_extract_all(byte_text(text), F.lit(r"(?s)[^ ]+ ?| "), F.lit(0))
    words = docs.select(F.explode(pieces).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("cnt"))
    # a blank after another blank or at the start is a piece of its own
    first_blank = docs.select(F.explode(F.regexp_extract_all(byte_text(text), F.lit(" +"), F.lit(0))).alias("b"))
    blanks = first_blank.groupBy("b").agg(F.count(F.lit(1)).alias("cnt"))
    spaces = blanks.select(
        F.lit("space").alias("class"),
        F.lit(0).cast("bigint").alias("word_len"),
        F.lit("none").alias("place"),
        F.explode(F.transform(F.sequence(F.lit(1), F.length("b")), lambda i: i < F.length("b"))).alias("next_space"),
        "cnt",
    )
    body = words.withColumn("body", F.rtrim("w")).filter("body <> ''").withColumn("size", F.length("body"))
    chars = body.select("size", "w", "cnt", F.posexplode(F.split("body", "")).alias("at", "ch"))
    place = F.when(F.col("at") == 0, "first").when(F.col("at") == F.col("size") - 1, "last").otherwise("mid")
    letters = chars.select(
        byte_class(F.ascii("ch")).alias("class"),
        F.least(F.col("size"), F.lit(cap)).cast("bigint").alias("word_len"),
        place.alias("place"),
        ((F.col("at") == F.col("size") - 1) & F.col("w").endswith(" ")).alias("next_space"),
        "cnt",
    )
    return letters.unionByName(spaces).groupBy("class", "word_len", "place", "next_space").agg(F.sum("cnt").alias("n"))


def boundary_alignment(freq: DataFrame) -> DataFrame:
    """Share of units that end with a space against the share of space bytes."""
    spaces = F.length("unit") - F.length(F.replace(F.col("unit"), F.lit(" "), F.lit("")))
    sized = freq.select("unit", "cnt", F.octet_length("unit").cast("bigint").alias("size"), spaces.alias("spaces"))
    return sized.agg(
        F.sum("cnt").alias("n"),
        (F.sum(F.when(F.col("unit").endswith(" "), F.col("cnt")).otherwise(0)) / F.sum("cnt")).alias("aligned"),
        (F.sum(F.col("spaces") * F.col("cnt")) / F.sum(F.col("size") * F.col("cnt"))).alias("base_rate"),
        (F.sum(F.col("size") * F.col("cnt")) / F.sum("cnt")).alias("span_mean"),
        weighted_percentile("size", "cnt", 0.5).alias("span_median"),
    )


def matched_prefix(pred: Column, true: Column) -> Column:
    """Number of leading bytes two strings share."""
    a, b = byte_text(pred), byte_text(true)
    upto = F.sequence(F.lit(1), F.least(F.length(a), F.length(b)))
    miss = F.filter(upto, lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    shortest = F.least(F.length(a), F.length(b))
    return F.when(shortest == 0, 0).otherwise(F.coalesce(F.get(miss, F.lit(0)) - 1, shortest)).cast("bigint")


def string_match_report(pairs: DataFrame, by: Sequence[str], pred="pred", true="true", weight="cnt") -> DataFrame:
    """Exact match, edits, normalised edit distance and matched prefix per readout."""
    size = F.greatest(F.octet_length(true), F.lit(1))
    rows = pairs.select(
        *by,
        F.col(weight).alias("w"),
        byte_levenshtein(pred, true).alias("edits"),
        size.alias("size"),
        matched_prefix(F.col(pred), F.col(true)).alias("prefix"),
        (F.octet_length(pred) > 0).cast("bigint").alias("alive"),
    )

    def mean(expr: Column) -> Column:
        return F.sum(expr * F.col("w")) / F.sum("w")

    return rows.groupBy(*by).agg(
        F.sum("w").alias("n"),
        mean((F.col("edits") == 0).cast("double")).alias("exact"),
        F.percentile(F.col("edits"), F.lit(0.5), F.col("w")).alias("median_edits"),
        mean(F.col("edits") / F.col("size")).alias("mean_ned"),
        mean(F.col("prefix") / F.col("size")).alias("prefix_share"),
        mean((F.col("edits") <= 1).cast("double")).alias("le1"),
        mean((F.col("edits") <= 2).cast("double")).alias("le2"),
        mean((F.col("edits") > 3).cast("double")).alias("gt3"),
        mean(F.col("alive").cast("double")).alias("survival"),
    )


def failure_class(pairs: DataFrame, vocab: DataFrame, pred="pred", true="true") -> DataFrame:
    """exact / typo (at most two edits) / far_real (another known unit) / garbage."""
    known = vocab.select(F.col("unit").alias(pred), F.lit(True).alias("_known"))
    edits = byte_levenshtein(pred, true)
    return pairs.join(known, pred, "left").withColumn(
        "failure",
        F.when(edits == 0, "exact").when(edits <= 2, "typo").when(F.col("_known"), "far_real").otherwise("garbage"),
    ).drop("_known")


def fidelity(pairs: DataFrame, by: Sequence[str] = ("op",), pred="pred", target="target", source="source") -> DataFrame:
    """Per edit operation: share equal to the edited string, share snapped back to the source."""
    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col(pred) == F.col(target)).cast("double")).alias("fidelity"),
        F.avg((F.col(pred) == F.col(source)).cast("double")).alias("snap_back"),
    )


def compare_arms(profile: DataFrame, arm: str, arms: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per metric, one column per arm, plus the difference of the first two."""
    long = profile.select(
        arm,
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m"),
    ).select(arm, "m.metric", "m.value")
    wide = long.groupBy("metric").pivot(arm, list(arms)).agg(F.max("value"))
    return wide.withColumn("delta", F.col(f"`{arms[1]}`") - F.col(f"`{arms[0]}`"))


def canonical_counts(freq: DataFrame) -> DataFrame:
    return freq.groupBy(canonical_form("unit").alias("form")).agg(F.sum("cnt").alias("cnt"), F.count(F.lit(1)).alias("n_forms"))
