"""Registered queries: corpus statistics and string metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import WORD_PREV
from ..operators import segment as seg, stats
from .common_sql import FREQ, UNITS, hash60
from .corpus import word_freq
from .registry import documents, query, table


def _r6(expr: str, name: str) -> str:
    return f"round({expr}, 6) AS {name}"


def rounded(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


_E1 = f"""WITH {FREQ}, r AS (SELECT unit, cnt, row_number() OVER w AS rnk, sum(cnt) OVER w AS cum FROM freq
      WINDOW w AS (ORDER BY cnt DESC, unit ROWS UNBOUNDED PRECEDING))
    SELECT unit, cnt, rnk, round(cum / (SELECT sum(cnt) FROM freq), 6) AS cum_share FROM r"""


@query("E1_unit_freq", _E1)
def unit_freq(spark, sf):
    return rounded(stats.unit_freq(word_freq(spark, sf)), "cum_share")


@query("E1_unit_freq_top50", _E1 + " WHERE rnk <= 50")
def unit_freq_top(spark, sf):
    return rounded(stats.unit_freq(word_freq(spark, sf), 50), "cum_share")


@query(
    "E2_coverage_curve",
    f"""WITH {FREQ}, r AS (SELECT cnt, row_number() OVER (ORDER BY cnt DESC, unit) AS rnk FROM freq),
    marks AS (SELECT unnest([10, 100, 1000, 5000, 20000]) AS mark)
    SELECT mark::BIGINT AS mark, round(sum(CASE WHEN rnk <= mark THEN cnt ELSE 0 END) / sum(cnt), 6) AS share FROM marks, r GROUP BY mark""",
)
def coverage_curve(spark, sf):
    return rounded(stats.coverage_curve(word_freq(spark, sf), [10, 100, 1000, 5000, 20000]), "share")


_BENCH = r"""braw AS (SELECT item_id, unnest(r) AS u, generate_subscripts(r, 1) AS i FROM (
      SELECT *, regexp_extract_all(text, '\p{N}|\p{L}+|[^\p{L}\p{N}]+') AS r FROM benchmark)),
    bcls AS (SELECT *, regexp_matches(u, '^\p{L}') AS is_l, lead(u) OVER w AS nxt, regexp_matches(lag(u) OVER w, '^\p{L}') AS prev_l
      FROM braw WINDOW w AS (PARTITION BY item_id ORDER BY i)),
    beval AS (SELECT CASE WHEN is_l AND nxt = ' ' THEN u || ' ' ELSE u END AS unit, count(*) AS n FROM bcls
      WHERE NOT (u = ' ' AND coalesce(prev_l, false)) GROUP BY 1)"""


def eval_freq(spark, sf):
    return stats.count_doc_units(table(spark, sf, "benchmark"), seg.unit_array("text", WORD_PREV, 32))


@query(
    "E3_oov_coverage",
    f"""WITH {FREQ}, {_BENCH}, top AS (SELECT unit FROM freq ORDER BY cnt DESC, unit LIMIT 2000)
    SELECT sum(n)::BIGINT AS n, sum(CASE WHEN t.unit IS NULL THEN 0 ELSE n END)::BIGINT AS covered,
      round(sum(CASE WHEN t.unit IS NULL THEN 0 ELSE n END) / sum(n), 6) AS coverage FROM beval b LEFT JOIN top t USING (unit)""",
)
def oov_coverage(spark, sf):
    return rounded(stats.oov_coverage(eval_freq(spark, sf), stats.unit_freq(word_freq(spark, sf), 2000)), "coverage")


@query(
    "E4_freq_buckets",
    f"""WITH {FREQ}, {_BENCH}, j AS (SELECT b.unit, n, coalesce(cnt, 0) AS c FROM beval b LEFT JOIN freq USING (unit))
    SELECT CASE WHEN c = 0 THEN 'zero' WHEN c <= 3 THEN 'low' WHEN c <= 63 THEN 'mid' ELSE 'high' END AS bucket, sum(n)::BIGINT AS n,
      count(*) AS n_distinct, round(sum(n * strlen(unit)) / sum(n), 6) AS mean_bytes,
      round(sum(n * length(unit)) / sum(n), 6) AS mean_chars, round(sum(n * (c = 0)::INT) / sum(n), 6) AS unseen FROM j GROUP BY 1""",
)
def freq_buckets(spark, sf):
    metrics = {"mean_bytes": F.octet_length("unit"), "mean_chars": F.length("unit"), "unseen": F.col("seen").isNull().cast("int")}
    return rounded(stats.freq_buckets(eval_freq(spark, sf), word_freq(spark, sf), metrics), *metrics)


@query(
    "E7_length_profile",
    f"""WITH {UNITS} SELECT lang, count(*) AS n, round(avg(strlen(unit)), 6) AS mean, quantile_cont(strlen(unit), 0.5)::DOUBLE AS p50,
      quantile_cont(strlen(unit), 0.9)::DOUBLE AS p90, round(quantile_cont(strlen(unit), 0.99), 6)::DOUBLE AS p99, max(strlen(unit)) AS max,
      round(avg((strlen(unit) <= 8)::INT), 6) AS short_share FROM units GROUP BY lang""",
)
def length_profile(spark, sf):
    return rounded(stats.length_profile(word_freq(spark, sf, ["lang"]), ["lang"]), "mean", "p99", "short_share")


@query(
    "E7_length_histogram",
    f"WITH {UNITS} SELECT lang, strlen(unit) AS size, count(*) AS cnt, count(DISTINCT unit) AS n_distinct FROM units GROUP BY lang, size",
)
def length_histogram(spark, sf):
    return stats.length_histogram(word_freq(spark, sf, ["lang"]), ["lang"])


@query(
    "E8_sample_per_length",
    f"""WITH {FREQ} SELECT unit, strlen(unit) AS size, row_number() OVER (PARTITION BY strlen(unit) ORDER BY {hash60("'11'", "unit")}, unit) AS place
    FROM freq QUALIFY place <= 20""",
)
def sample_per_length(spark, sf):
    return stats.sample_per_length(word_freq(spark, sf), 20, 11)


@query(
    "E9_type_profile",
    rf"""WITH {FREQ} SELECT CASE WHEN trim(unit, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'space'
      WHEN regexp_matches(unit, '[0-9]') THEN 'digitful' WHEN NOT regexp_matches(unit, '[A-Za-z]') THEN 'symbol'
      WHEN regexp_matches(unit, '^\s*\p{{Lu}}') THEN 'Capitalized' WHEN NOT regexp_matches(unit, '[A-`]') THEN 'lower' ELSE 'mixed' END AS type,
      sum(cnt)::BIGINT AS n, count(*) AS n_distinct FROM freq GROUP BY 1""",
)
def type_profile(spark, sf):
    return stats.type_profile(word_freq(spark, sf))


@query(
    "E10_char_profile",
    r"""WITH h AS (SELECT doc_id, hex(encode(text)) AS x, strlen(text) AS n FROM documents),
    b AS (SELECT doc_id, i, ('0x' || substr(x, 2 * i + 1, 2))::INT AS c FROM (SELECT doc_id, x, unnest(range(0, n)) AS i FROM h)),
    w AS (SELECT *, sum((c = 32)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS wid, lead(c) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM b),
    p AS (SELECT *, CASE WHEN c = 32 THEN 0 ELSE count(*) FILTER (c <> 32) OVER (PARTITION BY doc_id, wid) END AS len,
      row_number() OVER (PARTITION BY doc_id, wid ORDER BY i) - CASE WHEN wid > 0 THEN 1 ELSE 0 END AS k FROM w),
    f AS (SELECT CASE WHEN c IN (32, 9, 10, 13) THEN 'space' WHEN c BETWEEN 48 AND 57 THEN 'digit'
        WHEN c BETWEEN 65 AND 90 OR c BETWEEN 97 AND 122 THEN 'letter'
        WHEN c IN (46, 44, 33, 63, 59, 58, 39, 34, 45, 40, 41) THEN 'punct' ELSE 'other' END AS class,
      least(len, 12)::BIGINT AS word_len,
      CASE WHEN c = 32 THEN 'none' WHEN k = 1 THEN 'first' WHEN k = len THEN 'last' ELSE 'mid' END AS place,
      coalesce(nxt = 32, false) AS next_space FROM p)
    SELECT class, word_len, place, next_space, count(*) AS n FROM f GROUP BY ALL""",
)
def char_profile(spark, sf):
    return stats.char_profile(documents(spark, sf))


@query(
    "E16_boundary_alignment",
    f"""WITH {UNITS} SELECT count(*) AS n, round(avg((unit LIKE '% ')::INT), 6) AS aligned,
      round(sum(length(unit) - length(replace(unit, ' ', ''))) / sum(strlen(unit)), 6) AS base_rate,
      round(avg(strlen(unit)), 6) AS span_mean, median(strlen(unit))::DOUBLE AS span_median FROM units""",
)
def boundary_alignment(spark, sf):
    return rounded(stats.boundary_alignment(word_freq(spark, sf)), "aligned", "base_rate", "span_mean")


@query(
    "E18_compare_arms",
    f"""WITH {UNITS}, p AS (SELECT lang, count(*)::DOUBLE AS n, avg(strlen(unit)) AS mean, quantile_cont(strlen(unit), 0.9)::DOUBLE AS p90,
      max(strlen(unit))::DOUBLE AS max FROM units WHERE lang IN ('de', 'en') GROUP BY lang),
    l AS (SELECT lang, unnest(['n', 'mean', 'p90', 'max']) AS metric, unnest([n, mean, p90, max]) AS v FROM p)
    SELECT metric, round(max(v) FILTER (lang = 'de'), 6) AS de, round(max(v) FILTER (lang = 'en'), 6) AS en,
      round(max(v) FILTER (lang = 'en') - max(v) FILTER (lang = 'de'), 6) AS delta FROM l GROUP BY metric""",
)
def compare_arms(spark, sf):
    profile = stats.length_profile(word_freq(spark, sf, ["lang"]), ["lang"])
    return rounded(stats.compare_arms(profile, "lang", ["de", "en"], ["n", "mean", "p90", "max"]), "de", "en", "delta")


@query(
    "E11_canonical_counts",
    f"""WITH {FREQ} SELECT lower(trim(unit, ' ' || chr(9) || chr(10) || chr(13))) AS form, sum(cnt)::BIGINT AS cnt, count(*) AS n_forms FROM freq GROUP BY 1""",
)
def canonical_counts(spark, sf):
    return stats.canonical_counts(word_freq(spark, sf))
