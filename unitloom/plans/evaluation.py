"""Registered queries: evaluation over score tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import first_target, gold_index
from ..operators import evaluate as ev
from ..sources import logs
from .common_sql import CHOICES, SIZE, WINDOWS
from .corpus import _SECTIONS, section_lines
from .registry import query, table
from .statistics import rounded
from .windowing import _TARGETS, windowed
from ..operators import windows as win
from ..operators.ordered import one_row


def choices(spark, sf):
    """lineitem as a choice table: item = order, choice = line number (rows of one line merged)."""
    line = table(spark, sf, "lineitem")
    return line.groupBy(F.col("l_orderkey").alias("item_id"), (F.col("l_linenumber") - 1).cast("bigint").alias("choice_idx")).agg(
        (-F.min("l_extendedprice")).alias("raw"),
        (-F.min(F.col("l_extendedprice") * (1 - F.col("l_discount")))).alias("uncond"),
        F.max("l_quantity").alias("n_units"),
        (F.max("l_partkey") % 40 + 1).alias("n_chars"),
        F.min("l_returnflag").alias("task"),
        F.min("l_linestatus").alias("tag"),
        (F.col("l_orderkey") % 8 - 1).alias("gold"),
    )


_SCORED = f"""{CHOICES},
    sc AS (SELECT *, raw AS s_raw, raw / greatest(n_units, 1) AS s_unit, raw / greatest(n_chars, 1) AS s_char, (raw - uncond) / greatest(n_units, 1) AS s_unit_pmi FROM choices),
    pk AS (SELECT item_id, min(task) AS task, min(tag) AS tag, min(gold) AS gold,
      first(choice_idx ORDER BY s_raw DESC, choice_idx) AS pick_raw, first(choice_idx ORDER BY s_unit DESC, choice_idx) AS pick_unit,
      first(choice_idx ORDER BY s_char DESC, choice_idx) AS pick_char, first(choice_idx ORDER BY s_unit_pmi DESC, choice_idx) AS pick_unit_pmi FROM sc GROUP BY item_id)"""
_ACC = """lm AS (SELECT task, tag, gold, unnest(['acc_raw', 'acc_unit', 'acc_char', 'acc_unit_pmi']) AS metric, unnest([pick_raw, pick_unit, pick_char, pick_unit_pmi]) AS pick FROM pk)"""


@query(
    "H1_group_choices",
    f"""WITH {CHOICES} SELECT item_id, count(*) AS n_choices, min(gold) AS gold, string_agg(choice_idx || ':' || n_chars, ',' ORDER BY choice_idx) AS listing FROM choices GROUP BY item_id""",
)
def group_choices(spark, sf):
    g = ev.group_choices(choices(spark, sf))
    listing = F.array_join(F.transform("choices", lambda c: F.concat_ws(":", c["choice_idx"].cast("string"), c["n_chars"].cast("string"))), ",")
    return g.select("item_id", F.size("choices").cast("bigint").alias("n_choices"), "gold", listing.alias("listing"))


@query(
    "H2_gold_index",
    """SELECT o_orderkey AS item_id, CASE WHEN regexp_full_match(t, '[0-9]+') THEN t::INT WHEN t IN ('O', 'F', 'P') THEN CASE t WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END ELSE -1 END AS gold
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN substr(o_orderpriority, 1, 1) WHEN o_orderkey % 3 = 1 THEN o_orderstatus ELSE 'none' END AS t FROM orders)""",
)
def gold(spark, sf):
    k = F.col("o_orderkey") % 3
    t = F.when(k == 0, F.substring("o_orderpriority", 1, 1)).when(k == 1, F.col("o_orderstatus")).otherwise("none")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("item_id"), gold_index(t, F.array(F.lit("O"), F.lit("F"), F.lit("P"))).alias("gold")
    )


@query(
    "H2_gold_index_list",
    """SELECT o_orderkey AS item_id, CASE o_orderkey % 4 WHEN 0 THEN -1 WHEN 1 THEN 2 ELSE CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END END AS gold FROM orders""",
)
def gold_of_list(spark, sf):
    """Several right answers: none, an index, or texts of which the first counts."""
    k, status = F.col("o_orderkey") % 4, F.col("o_orderstatus")
    t = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("2"), F.lit("0"))).otherwise(F.array(status, F.lit("P")))
    choices = F.array(F.lit("O"), F.lit("F"), F.lit("P"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("item_id"), gold_index(first_target(t), choices).alias("gold"))


@query(
    "H3_mc_accuracy",
    f"""WITH {_SCORED}, {_ACC}, a AS (SELECT task, metric, count(*) AS n, sum((gold >= 0)::INT)::BIGINT AS n_valid, sum((gold >= 0 AND pick = gold)::INT)::BIGINT AS n_hit FROM lm GROUP BY ALL)
    SELECT *, round(n_hit / n, 6) AS acc, round(n_hit / greatest(n_valid, 1), 6) AS acc_valid, round(sqrt((n_hit / n) * (1 - n_hit / n) / n), 6) AS stderr FROM a""",
)
def mc_accuracy(spark, sf):
    return rounded(ev.mc_accuracy(ev.item_picks(choices(spark, sf), ["task"]), ["task"]), "acc", "acc_valid", "stderr")


def _bias_sql(by: str = "") -> str:
    """The diagnostics of all items, or of each value of an item's ``by``."""
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    join = f"a JOIN p USING ({by}) JOIN t USING ({by})" if by else "a, p, t"
    return f"""WITH {_SCORED}, it AS (SELECT item_id, {f"min({by}) AS {by}, " if by else ""}max(s_unit) AS best, avg(n_units) AS mu, avg(s_unit) AS ms, avg(s_unit_pmi) AS mp,
      first(choice_idx ORDER BY s_unit DESC, choice_idx) AS pick, first(choice_idx ORDER BY n_chars, choice_idx) AS short, first(choice_idx ORDER BY n_chars DESC, choice_idx) AS long FROM sc GROUP BY item_id),
    c AS (SELECT sc.* {f"EXCLUDE ({by}), it.{by}" if by else ""}, n_units - mu AS dx, s_unit - ms AS dy, s_unit_pmi - mp AS dz, abs(s_unit - best) < 1e-9 AS close FROM sc JOIN it USING (item_id)),
    t AS (SELECT {key}count(*) FILTER (close > 1) AS n_ties FROM (SELECT {key}item_id, sum(close::INT) AS close FROM c GROUP BY {key}item_id) {group}),
    a AS (SELECT {key}count(*) AS n_items, avg(mu) AS n_units_mean, avg((pick = short)::INT) AS eq_shortest, avg((pick = long)::INT) AS eq_longest FROM it {group}),
    p AS (SELECT {key}corr(dx, dy) AS r_within, corr(dx, dz) AS r_within_pmi, corr(n_chars, raw) AS r_raw_chars, corr(n_units, s_unit) AS r_unit_units, count(*) AS n_choices FROM c {group})
    SELECT {key}n_items, round(n_units_mean, 6) AS n_units_mean, round(eq_shortest, 6) AS eq_shortest, round(eq_longest, 6) AS eq_longest, round(r_within, 6) AS r_within,
      round(r_within_pmi, 6) AS r_within_pmi, round(r_raw_chars, 6) AS r_raw_chars, round(r_unit_units, 6) AS r_unit_units, n_choices, n_ties, round(n_ties / n_items, 6) AS tie_rate FROM {join}"""


_BIAS = ("n_units_mean", "eq_shortest", "eq_longest", "r_within", "r_within_pmi", "r_raw_chars", "r_unit_units", "tie_rate")


@query("H5_length_bias", _bias_sql())
def length_bias(spark, sf):
    return rounded(ev.length_bias(choices(spark, sf)), *_BIAS)


@query("H5_length_bias_by_task", _bias_sql("task"))
def length_bias_by_task(spark, sf):
    return rounded(ev.length_bias(choices(spark, sf), by=["task"]), *_BIAS)


_GATE = f"""{_SCORED}, gi AS (SELECT item_id, min(task) AS task, first(choice_idx ORDER BY s_unit DESC, choice_idx) AS pick, first(choice_idx ORDER BY n_chars, choice_idx) AS short, min(gold) AS gold FROM sc GROUP BY item_id),
    gate AS (SELECT count(*) AS n, avg((pick = gold)::INT) AS acc_unit, avg((short = gold)::INT) AS baseline, avg((pick = short)::INT) AS short_rate, 0.25 + 2 * sqrt(0.1875 / count(*)) AS lim FROM gi)"""


@query(
    "H6_shortest_gate",
    f"""WITH {_GATE} SELECT n, round(acc_unit, 6) AS acc_unit, round(baseline, 6) AS baseline, round(short_rate, 6) AS short_rate, round(lim, 6) AS "limit",
      acc_unit >= baseline + 0.04 AND short_rate <= lim AS passed FROM gate""",
)
def shortest_gate(spark, sf):
    return rounded(ev.shortest_gate(choices(spark, sf)), "acc_unit", "baseline", "short_rate", "limit")


@query(
    "H6_shortest_gate_by_task",
    f"""WITH {_GATE}, per AS (SELECT task, count(*) AS n, avg((pick = gold)::INT) AS acc_unit, avg((short = gold)::INT) AS baseline, avg((pick = short)::INT) AS short_rate, 0.25 + 2 * sqrt(0.1875 / count(*)) AS lim FROM gi GROUP BY task)
    SELECT task, n, round(acc_unit, 6) AS acc_unit, round(baseline, 6) AS baseline, round(short_rate, 6) AS short_rate, round(lim, 6) AS "limit",
      acc_unit >= baseline + 0.04 AND short_rate <= lim AS passed FROM per""",
)
def shortest_gate_by_task(spark, sf):
    return rounded(ev.shortest_gate(choices(spark, sf), by=["task"]), "acc_unit", "baseline", "short_rate", "limit")


@query(
    "H7_run_checks",
    f"""WITH {_GATE}, r AS (SELECT unnest(['beats shortest', 'short picks', 'enough items']) AS "check", unnest([acc_unit >= baseline + 0.04, short_rate <= lim, n >= 1000]) AS passed FROM gate)
    SELECT * FROM r UNION ALL SELECT 'OVERALL', bool_and(passed) FROM r""",
)
def run_checks(spark, sf):
    rules = {
        "beats shortest": F.col("acc_unit") >= F.col("baseline") + 0.04,
        "short picks": F.col("short_rate") <= F.col("limit"),
        "enough items": F.col("n") >= 1000,
    }
    return ev.run_checks(ev.shortest_gate(choices(spark, sf)), rules)


@query(
    "H8_compare_runs",
    f"""WITH {_SCORED}, {_ACC}, a AS (SELECT task, tag, metric, avg((gold >= 0 AND pick = gold)::INT) AS acc FROM lm GROUP BY ALL),
    w AS (SELECT metric, task, max(acc) FILTER (tag = 'F') AS F, max(acc) FILTER (tag = 'O') AS O, task <> 'R' AS valid FROM a GROUP BY metric, task),
    b AS (SELECT * FROM w UNION ALL SELECT metric, 'MEAN', avg(F), avg(O), true FROM w WHERE valid GROUP BY metric)
    SELECT metric, task, round(F, 6) AS F, round(O, 6) AS O, valid, round(O - F, 6) AS d_O FROM b""",
)
def compare_runs(spark, sf):
    picks = ev.item_picks(choices(spark, sf), ["task", "tag"])
    acc = ev.mc_accuracy(picks, ["task", "tag"])
    return rounded(ev.compare_runs(acc, "F", ["F", "O"], ["R"], by=["metric"]), "F", "O", "d_O")


@query(
    "H9_paired_delta",
    f"""WITH {_SCORED}, d AS (SELECT (pick_unit = gold AND gold >= 0)::INT - (pick_raw = gold AND gold >= 0)::INT AS d FROM pk)
    SELECT count(*) AS n, round(avg(d), 6) AS delta, round(avg(d) - 1.96 * stddev_samp(d) / sqrt(count(*)), 6) AS low, round(avg(d) + 1.96 * stddev_samp(d) / sqrt(count(*)), 6) AS high,
      sum((d > 0)::INT)::BIGINT AS only_b, sum((d < 0)::INT)::BIGINT AS only_a FROM d""",
)
def paired_delta(spark, sf):
    picks = ev.item_picks(choices(spark, sf))
    hit = lambda c: picks.select("item_id", ((F.col(c) == F.col("gold")) & (F.col("gold") >= 0)).alias("hit"))
    return rounded(ev.paired_delta(hit("pick_raw"), hit("pick_unit")), "delta", "low", "high")


@query(
    "H10_subset_vs_full",
    f"""WITH {_SCORED}, r AS (SELECT task, item_id, (pick_unit = gold AND gold >= 0)::INT AS hit, row_number() OVER (PARTITION BY task ORDER BY item_id) AS p FROM pk)
    SELECT task, count(*) AS n_full, round(avg(hit), 6) AS "full", sum((p <= 300)::INT)::BIGINT AS n_subset, round(avg(hit) FILTER (p <= 300), 6) AS subset,
      round(avg(hit) FILTER (p <= 300) - avg(hit), 6) AS gap FROM r GROUP BY task""",
)
def subset_vs_full(spark, sf):
    picks = ev.item_picks(choices(spark, sf), ["task"])
    items = picks.select("task", "item_id", ((F.col("pick_unit") == F.col("gold")) & (F.col("gold") >= 0)).alias("hit"))
    return rounded(ev.subset_vs_full(items, 300, by=["task"]), "full", "subset", "gap")


@query(
    "H11_topk_coverage",
    f"""WITH {_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s_unit DESC, choice_idx) AS r FROM sc),
    i AS (SELECT item_id, bool_or(choice_idx = gold AND r <= 3) AS in_k, bool_or(choice_idx = gold AND r = 1) AS f FROM r GROUP BY item_id)
    SELECT count(*) AS n, round(avg(in_k::INT), 6) AS coverage, round(avg(f::INT), 6) AS argmax, round(avg(in_k::INT) - avg(f::INT), 6) AS gap FROM i""",
)
def topk_coverage(spark, sf):
    return rounded(ev.topk_coverage(choices(spark, sf), 3), "coverage", "argmax", "gap")


@query(
    "H12_confident_errors",
    f"""WITH {_SCORED}, m AS (SELECT item_id, max(s_raw) AS best FROM sc GROUP BY item_id), z AS (SELECT item_id, 1 / sum(exp((s_raw - best) / 20000)) AS share FROM sc JOIN m USING (item_id) GROUP BY item_id),
    w AS (SELECT item_id, pick_raw AS pick, gold, share, best FROM z JOIN pk USING (item_id) JOIN m USING (item_id) WHERE pick_raw <> gold AND share >= 0.4),
    c AS (SELECT w.*, o_orderpriority AS context FROM w JOIN orders ON o_orderkey = item_id),
    top AS (SELECT item_id FROM w ORDER BY round(share, 9) DESC, item_id LIMIT 200)
    SELECT item_id, pick, gold, round(best, 6) AS best, round(share, 6) AS share, context FROM c SEMI JOIN top USING (item_id)""",
)
def confident_errors(spark, sf):
    shares = ev.softmax_share(choices(spark, sf), "raw", 20000.0)
    shares = shares.withColumn("share", F.round("share", 9))
    context = table(spark, sf, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderpriority").alias("context"))
    return rounded(ev.confident_errors(shares, context, 200), "best", "share").select("item_id", "pick", "gold", "best", "share", "context")


_STRATA = f"""{_TARGETS}, st AS (SELECT delta, k, r, count(*) AS n, round(avg(byte), 6) AS mean FROM tgt GROUP BY GROUPING SETS ((delta), (k), (r)))"""


def strata(spark, sf):
    targets = win.future_targets(windowed(spark, sf), 4, 0.8, 16, counted=True)
    return ev.stratified_loss(targets, ["delta", "k", "r"], "byte", "n")


@query("H13_stratified_loss", f"WITH {WINDOWS}, {_STRATA} SELECT * FROM st")
def stratified_loss(spark, sf):
    return rounded(strata(spark, sf), "mean")


@query(
    "H13_byte_strata",
    f"""WITH {WINDOWS}, u AS (SELECT window_id, idx, n_bytes, hex(encode(unit)) AS h, sum(n_bytes) OVER (PARTITION BY window_id ORDER BY idx) AS stop FROM win),
    b AS (SELECT window_id, stop - n_bytes + r AS p, ('0x' || substr(h, 2 * r + 1, 2))::INT AS c FROM (SELECT *, unnest(range(0, n_bytes)) AS r FROM u)),
    w AS (SELECT *, sum((c = 32)::INT) OVER (PARTITION BY window_id ORDER BY p) AS wid, lead(c) OVER (PARTITION BY window_id ORDER BY p) AS nxt FROM b),
    q AS (SELECT *, count(*) FILTER (c <> 32) OVER (PARTITION BY window_id, wid) AS len,
      row_number() OVER (PARTITION BY window_id, wid ORDER BY p) - CASE WHEN wid > 0 THEN 1 ELSE 0 END AS k FROM w),
    f AS (SELECT window_id, p, c, nxt, len, k, CASE WHEN c IN (32, 9, 10, 13) THEN 'space' WHEN c BETWEEN 48 AND 57 THEN 'digit'
        WHEN c BETWEEN 65 AND 90 OR c BETWEEN 97 AND 122 THEN 'letter' WHEN c IN (46, 44, 33, 63, 59, 58, 39, 34, 45, 40, 41) THEN 'punct' ELSE 'other' END AS class FROM q),
    a AS (SELECT window_id, stop, least(max(stop) OVER (PARTITION BY window_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) - stop, 16) AS m FROM u),
    t AS (SELECT window_id, stop + d - 1 AS p, d AS delta FROM (SELECT *, unnest(range(1, m::BIGINT + 1)) AS d FROM a)),
    j AS (SELECT delta, c, class, CASE WHEN c = 32 THEN 'none' WHEN len <= 2 THEN '1-2' WHEN len <= 5 THEN '3-5' WHEN len <= 8 THEN '6-8' ELSE '9+' END AS word_len,
      CASE WHEN class = 'space' THEN 'space' WHEN class <> 'letter' THEN 'none' WHEN k = 1 THEN 'first' WHEN k = len THEN 'last' ELSE 'mid' END AS place,
      CASE WHEN delta > 1 THEN 'later' WHEN nxt = 32 THEN 'end' ELSE 'inside' END AS ahead FROM t JOIN f USING (window_id, p))
    SELECT class, word_len, delta, place, ahead, count(*) AS n, round(avg(c), 6) AS mean FROM j
    GROUP BY GROUPING SETS ((class), (word_len, delta), (place), (ahead))""",
)
def byte_strata(spark, sf):
    """Means by byte class, by word length and distance, by place in the word and by whether the word ends next."""
    targets = ev.target_attributes(windowed(spark, sf), 4, 16, counted=True)
    return rounded(ev.stratified_loss(targets, ["class", ("word_len", "delta"), "place", "ahead"], "byte", "n"), "mean")


@query(
    "H14_trend_violations",
    f"""WITH {WINDOWS}, {_TARGETS}, st AS (SELECT delta, k, r, avg(byte) AS mean FROM tgt GROUP BY GROUPING SETS ((delta), (k), (r))),
    c AS (SELECT CASE WHEN delta IS NOT NULL THEN 'delta' WHEN k IS NOT NULL THEN 'k' ELSE 'r' END AS series, coalesce(delta, k, r) AS x, mean FROM st),
    d AS (SELECT *, mean - lag(mean) OVER (PARTITION BY series ORDER BY x) AS d FROM c)
    SELECT series, sum((d > 0.005)::INT)::BIGINT AS rises, sum((d < -0.005)::INT)::BIGINT AS falls, round(max(mean) - min(mean), 6) AS "range",
      CASE WHEN max(mean) - min(mean) < 0.05 THEN 'FAIL' WHEN sum((CASE WHEN series = 'r' THEN d < -0.005 ELSE d > 0.005 END)::INT) > 0 THEN 'WARN' ELSE 'OK' END AS verdict FROM d GROUP BY series""",
)
def trend_violations(spark, sf):
    series = F.when(F.col("delta").isNotNull(), "delta").when(F.col("k").isNotNull(), "k").otherwise("r")
    curve = strata(spark, sf).select(series.alias("series"), F.coalesce("delta", "k", "r").alias("x"), "mean")
    return rounded(ev.trend_violations(curve, "series", "x", "mean", growing=("r",)), "range")


@query(
    "H16_side_by_side",
    f"""WITH {_SECTIONS}, s AS (SELECT prompt_id // 3 AS prompt_id, file, readout, text FROM sections WHERE text <> '')
    SELECT prompt_id, readout, coalesce(any_value(text) FILTER (file = 'log0'), '(empty)') AS log0, coalesce(any_value(text) FILTER (file = 'log1'), '(empty)') AS log1,
      coalesce(any_value(text) FILTER (file = 'log2'), '(empty)') AS log2 FROM s GROUP BY prompt_id, readout""",
)
def side_by_side(spark, sf):
    sections = logs.parse_sections(section_lines(spark, sf), "file", ("conv_id", "turn", "k")).filter("text <> ''")
    return ev.side_by_side(sections.withColumn("prompt_id", F.floor(F.col("prompt_id") / 3)), ["log0", "log1", "log2"])


@query(
    "H17_regression_alarm",
    """WITH d AS (SELECT ts::DATE AS day, avg(value) AS metric FROM events GROUP BY 1), b AS (SELECT avg(value) AS base FROM events WHERE ts::DATE = (SELECT min(ts::DATE) FROM events))
    SELECT day, round(metric, 6) AS metric, round(metric - base, 6) AS excess, metric - base > 2.0 AS alarm FROM d, b""",
)
def regression_alarm(spark, sf):
    events = table(spark, sf, "events").select(F.to_date("ts").alias("day"), "value")
    daily = events.groupBy("day").agg(F.avg("value").alias("metric"))
    base = daily.agg(F.min_by("metric", "day").alias("base"))
    out = ev.regression_alarm(daily.transform(one_row, base), "metric", F.col("base"), 2.0)
    return rounded(out.drop("base"), "metric", "excess")


@query(
    "H18_auroc",
    """WITH j AS (SELECT n_chars, quality = 1 AS ok, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 3000 THEN 'mid' ELSE 'long' END AS bucket FROM documents JOIN labels USING (doc_id)),
    r AS (SELECT *, rank() OVER (PARTITION BY bucket ORDER BY n_chars) + (count(*) OVER (PARTITION BY bucket, n_chars) - 1) / 2 AS rk FROM j),
    a AS (SELECT bucket, sum(ok::INT)::BIGINT AS n_pos, sum((NOT ok)::INT)::BIGINT AS n_neg, sum(rk) FILTER (ok) AS s FROM r GROUP BY bucket)
    SELECT bucket, n_pos, n_neg, round((s - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg), 6) AS auroc FROM a""",
)
def auroc(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    bucket = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 3000, "mid").otherwise("long")
    rows = docs.select("n_chars", (F.col("quality") == 1).alias("ok"), bucket.alias("bucket"))
    return rounded(ev.auroc(rows, "n_chars", "ok", ["bucket"]), "auroc")
