"""Registered queries: scoring, re-splitting, encoding, typos and string reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import WORD_PREV
from ..operators import rewrite, segment as seg, stats
from ..session import durable
from ..sources import unit_store
from .common_sql import FREQ, UNITS, hash60
from .corpus import SEP, scratch, word_freq, word_units
from .registry import documents, query
from .statistics import rounded

MIN_COUNT, THRESH, FLOOR, TOPN, L_MAX = 2, 7.0, 3, 2000, 32

_MODEL = """hx AS (SELECT unit, cnt, hex(encode(unit)) AS h, strlen(unit) AS n FROM freq),
    bp AS (SELECT unit, cnt, CASE WHEN i = 0 THEN '^' ELSE substr(h, 2 * i - 1, 2) END AS prev, substr(h, 2 * i + 1, 2) AS byte
      FROM (SELECT *, unnest(range(0, n)) AS i FROM hx)),
    bc AS (SELECT prev, byte, sum(cnt) AS c FROM bp GROUP BY prev, byte),
    model AS (SELECT prev, byte, -log2(c / sum(c) OVER (PARTITION BY prev)) AS bits FROM bc),
    scored AS (SELECT unit, any_value(cnt) >= 2 AS ok, avg(bits) AS entropy FROM bp JOIN model USING (prev, byte) GROUP BY unit)"""


@query("C16_score_distinct", f"WITH {FREQ}, {_MODEL} SELECT unit, ok, round(entropy, 6) AS entropy FROM scored")
def score_distinct(spark, sf):
    freq = durable(word_freq(spark, sf))
    return rounded(rewrite.bigram_scorer(freq, MIN_COUNT)(freq), "entropy")


def _vocab(freq, n=TOPN):
    return stats.unit_freq(freq, n).select("unit", "rnk")


def _greedy_sql(units: str, l_max: int) -> str:
    """Greedy longest match of ``units`` against the top units, as (unit, pieces list)."""
    return f"""vocab AS (SELECT unit AS piece FROM freq WHERE strlen(unit) <= {l_max} AND unit IN (SELECT unit FROM freq ORDER BY cnt DESC, unit LIMIT {TOPN})),
    subs AS (SELECT unit, s, substring(unit, s, n) AS piece, n FROM (SELECT unit, s, unnest(range(1, least({l_max}, length(unit) - s + 1) + 1)) AS n
      FROM (SELECT unit, unnest(range(1, length(unit) + 1)) AS s FROM {units}))),
    best AS (SELECT unit, s, max(n) AS n FROM subs SEMI JOIN vocab USING (piece) GROUP BY unit, s),
    walk AS (
      SELECT unit, 1::BIGINT AS s FROM {units}
      UNION ALL SELECT w.unit, w.s + coalesce(b.n, 1) FROM walk w LEFT JOIN best b ON b.unit = w.unit AND b.s = w.s WHERE w.s + coalesce(b.n, 1) <= length(w.unit)),
    stepped AS (SELECT w.unit, w.s, b.n, sum((b.n IS NOT NULL)::INT) OVER (PARTITION BY w.unit ORDER BY w.s) AS isl FROM walk w LEFT JOIN best b ON b.unit = w.unit AND b.s = w.s),
    pieces AS (SELECT unit, s, substring(unit, s, n) AS piece FROM stepped WHERE n IS NOT NULL
      UNION ALL SELECT unit, min(s), string_agg(substring(unit, s, 1), '' ORDER BY s) FROM stepped WHERE n IS NULL GROUP BY unit, isl),
    cut AS (SELECT unit, s, unnest(string_split(list_reduce(list_transform(range(1, length(piece) + 1), lambda i: substring(piece, i, 1)),
        lambda acc, x: CASE WHEN strlen(split_part(acc, chr(31), -1)) + strlen(x) > {l_max} THEN acc || chr(31) || x ELSE acc || x END), chr(31))) AS piece,
        unnest(range(0, strlen(piece))) AS o FROM pieces)"""


@query(
    "C3_split_oversized",
    f"""WITH RECURSIVE {FREQ}, long AS (SELECT unit FROM freq WHERE strlen(unit) > 8), {_greedy_sql("long", 8)}
    SELECT unit, count(*) AS n_pieces, string_agg(piece, chr(31) ORDER BY s, o) AS pieces FROM cut WHERE piece IS NOT NULL GROUP BY unit""",
)
def split_oversized(spark, sf):
    freq = durable(word_freq(spark, sf))
    out = rewrite.split_oversized(freq, _vocab(freq), 8)
    return out.select("unit", F.size("pieces").cast("bigint").alias("n_pieces"), F.array_join("pieces", SEP).alias("pieces"))


def cascade(spark, sf):
    freq = durable(word_freq(spark, sf))
    scorer = rewrite.bigram_scorer(freq, MIN_COUNT)
    mapping, floor = rewrite.resplit_cascade(scorer(freq), _vocab(freq), scorer, THRESH, FLOOR, L_MAX)
    return freq, durable(mapping), floor


_CASCADE = f"""{_MODEL}, failed AS (SELECT unit FROM scored WHERE NOT ok OR entropy > {THRESH} OR strlen(unit) > {L_MAX}),
    {_greedy_sql("failed", L_MAX)},
    dp AS (SELECT DISTINCT piece AS unit FROM cut WHERE piece IS NOT NULL),
    dx AS (SELECT unit, hex(encode(unit)) AS h, unnest(range(0, strlen(unit))) AS i FROM dp),
    ps AS (SELECT x.unit, avg(coalesce(bits, 16)) AS entropy, any_value(coalesce(cnt, 0)) >= 2 AS ok FROM dx x
      LEFT JOIN model m ON m.prev = CASE WHEN i = 0 THEN '^' ELSE substr(h, 2 * i - 1, 2) END AND m.byte = substr(h, 2 * i + 1, 2)
      LEFT JOIN freq f ON f.unit = x.unit GROUP BY x.unit),
    chunks AS (SELECT unit AS piece, list_reduce(list_transform(range(1, length(unit) + 1), lambda i: substring(unit, i, 1)),
        lambda acc, x: CASE WHEN strlen(split_part(acc, chr(31), -1)) + strlen(x) > {FLOOR} THEN acc || chr(31) || x ELSE acc || x END) AS c
      FROM ps WHERE NOT ok OR entropy > {THRESH}),
    mapping AS (SELECT unit, string_agg(coalesce(c, piece), chr(31) ORDER BY s, o) AS pieces FROM (SELECT * FROM cut WHERE piece IS NOT NULL) LEFT JOIN chunks USING (piece) GROUP BY unit)"""


@query("C17_resplit_cascade", f"WITH RECURSIVE {FREQ}, {_CASCADE} SELECT unit, pieces, len(string_split(pieces, chr(31))) AS n_pieces FROM mapping")
def resplit_cascade(spark, sf):
    _, mapping, _ = cascade(spark, sf)
    return mapping.select("unit", F.array_join("pieces", SEP).alias("pieces"), F.size("pieces").cast("bigint").alias("n_pieces"))


@query(
    "C18_apply_mapping",
    f"""WITH RECURSIVE {FREQ}, {_CASCADE} SELECT doc_id, sum(len(string_split(coalesce(pieces, unit), chr(31))))::BIGINT AS n_units,
      md5(string_agg(coalesce(pieces, unit), chr(31) ORDER BY pos)) AS stream, 1::BIGINT AS n_starts FROM units LEFT JOIN mapping USING (unit) GROUP BY doc_id""",
)
def apply_mapping(spark, sf):
    _, mapping, _ = cascade(spark, sf)
    units = rewrite.apply_mapping(word_units(spark, sf), mapping)
    ordered = F.sort_array(F.collect_list(F.struct("pos", "piece", "unit")))
    return units.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_units"),
        F.md5(F.array_join(F.transform(ordered, lambda x: x["unit"]), SEP)).alias("stream"),
        F.sum(F.col("doc_start").cast("bigint")).alias("n_starts"),
    )


@query(
    "C18_renumber",
    f"""WITH RECURSIVE {FREQ}, {_CASCADE}, l AS (SELECT doc_id, pos, string_split(coalesce(pieces, unit), chr(31)) AS l FROM units LEFT JOIN mapping USING (unit)),
      p AS (SELECT doc_id, pos, k, l[k] AS u FROM (SELECT doc_id, pos, l, unnest(range(1, len(l) + 1)) AS k FROM l)),
      n AS (SELECT doc_id, u, row_number() OVER (PARTITION BY doc_id ORDER BY pos, k) - 1 AS place FROM p)
    SELECT doc_id, count(*) AS n_units, md5(string_agg(place || ':' || u, chr(31) ORDER BY place)) AS stream FROM n GROUP BY doc_id""",
)
def renumber(spark, sf):
    """Dense positions after the rewrite, checked with the unit at each of them."""
    freq, mapping, _ = cascade(spark, sf)
    rewritten = rewrite.apply_mapping(word_units(spark, sf), mapping, freq=freq)
    units = rewrite.renumber(rewritten.select("shard", "doc_id", "pos", "piece", "unit"))
    placed = F.sort_array(F.collect_list(F.struct("pos", "unit")))
    text = F.transform(placed, lambda x: F.concat(x["pos"].cast("string"), F.lit(":"), x["unit"]))
    return units.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_units"), F.md5(F.array_join(text, SEP)).alias("stream"))


@query(
    "C19_fit_windows",
    f"""WITH {FREQ}, m AS (SELECT unit, substring(unit, 1, length(unit) // 2) AS a, substring(unit, length(unit) // 2 + 1) AS b FROM freq WHERE length(unit) >= 12),
    r AS (SELECT doc_id, pos, 0 AS k, coalesce(a, unit) AS u FROM units LEFT JOIN m USING (unit) UNION ALL SELECT doc_id, pos, 1, b FROM units JOIN m USING (unit)),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, k) AS j FROM r)
    SELECT doc_id, count(*) AS n_units, md5(string_agg(u, chr(31) ORDER BY j)) AS stream FROM n WHERE j <= 64 GROUP BY doc_id""",
)
def fit_windows(spark, sf):
    """Long words halved, then every document's first window trimmed back to 64 units."""
    units = seg.unit_array("text", WORD_PREV, 32)
    half = lambda u: (F.length(u) / 2).cast("int")
    halves = lambda u: F.when(
        F.length(u) >= 12, F.array(F.substring(u, F.lit(1), half(u)), F.substring(u, half(u) + 1, F.length(u)))
    ).otherwise(F.array(u))
    rows = documents(spark, sf).select("doc_id", F.flatten(F.transform(units, halves)).alias("units"))
    fitted = rewrite.fit_windows(rows, 64)
    return fitted.select("doc_id", F.size("units").cast("bigint").alias("n_units"), F.md5(F.array_join("units", SEP)).alias("stream"))


@query(
    "C20_verify_stats",
    f"""WITH RECURSIVE {FREQ}, {_CASCADE},
    fl AS (SELECT DISTINCT unnest(string_split(c, chr(31))) AS unit FROM chunks),
    fx AS (SELECT unit, hex(encode(unit)) AS h, unnest(range(0, strlen(unit))) AS i FROM fl),
    fs AS (SELECT x.unit, avg(coalesce(bits, 16)) AS entropy, any_value(coalesce(cnt, 0)) >= 2 AS ok FROM fx x
      LEFT JOIN model m ON m.prev = CASE WHEN i = 0 THEN '^' ELSE substr(h, 2 * i - 1, 2) END AND m.byte = substr(h, 2 * i + 1, 2)
      LEFT JOIN freq f ON f.unit = x.unit GROUP BY x.unit),
    a AS (SELECT sum(cnt)::BIGINT AS n_in, sum(CASE WHEN pieces IS NOT NULL THEN cnt ELSE 0 END)::BIGINT AS n_flag,
      sum(cnt * coalesce(len(string_split(pieces, chr(31))), 1))::BIGINT AS n_out, count(pieces) AS n_flag_distinct FROM freq LEFT JOIN mapping USING (unit))
    SELECT a.*, (SELECT count(*) FROM fs) AS n_floor, (SELECT count(*) FROM fs WHERE NOT ok OR entropy > {THRESH}) AS n_floor_fail,
      round(n_out / n_in, 6) AS factor FROM a""",
)
def verify_stats(spark, sf):
    freq, mapping, floor = cascade(spark, sf)
    return rounded(rewrite.verify_stats(freq, mapping, floor, THRESH), "factor")


_TOKENS = f"""v AS (SELECT unit, row_number() OVER (ORDER BY cnt DESC, unit) - 1 AS id FROM freq QUALIFY id < {TOPN}),
    tok AS (SELECT shard, doc_id, pos, coalesce(id, {TOPN}) AS token_id FROM units LEFT JOIN v USING (unit)
      UNION ALL SELECT shard, doc_id, max(pos) + 1, {TOPN + 1} FROM units GROUP BY shard, doc_id)"""


def encoder(spark, sf):
    """Documents to token rows by the corpus' most frequent units."""
    vocab = durable(_vocab(word_freq(spark, sf)))
    return lambda docs: rewrite.encode_with_vocab(docs, seg.unit_array("text", WORD_PREV, 32), vocab, TOPN)


def tokens(spark, sf):
    return encoder(spark, sf)(documents(spark, sf))


@query(
    "C15_encode_with_vocab",
    f"""WITH {FREQ}, {_TOKENS} SELECT doc_id, count(*) AS n_tokens, sum(token_id * (pos % 97 + 1))::BIGINT AS checksum,
      sum((token_id = {TOPN})::INT)::BIGINT AS n_unknown, sum((token_id = {TOPN + 1})::INT)::BIGINT AS n_end FROM tok GROUP BY doc_id""",
)
def encode_with_vocab(spark, sf):
    return tokens(spark, sf).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.sum(F.col("token_id") * (F.col("pos") % 97 + 1)).alias("checksum"),
        F.sum((F.col("token_id") == TOPN).cast("bigint")).alias("n_unknown"),
        F.sum((F.col("token_id") == TOPN + 1).cast("bigint")).alias("n_end"),
    )


@query(
    "A8_write_read_tokens",
    f"""WITH {FREQ}, {_TOKENS} SELECT shard, count(*) AS n_tokens, count(DISTINCT doc_id) AS n_docs, max(token_id) AS max_id FROM tok GROUP BY shard""",
)
def write_read_tokens(spark, sf):
    path = scratch(spark)
    unit_store.store_tokens(documents(spark, sf), path, encoder(spark, sf))
    return unit_store.token_meta(unit_store.read_tokens(spark, path))


@query(
    "C13_typo_probability",
    f"""WITH {FREQ}, counted AS MATERIALIZED (SELECT * FROM freq), top AS (SELECT unit FROM counted ORDER BY cnt DESC, unit LIMIT 500)
    SELECT f.unit, round(0.4 * CASE WHEN strlen(f.unit) < 3 THEN 0 WHEN strlen(f.unit) <= 4 THEN 0.5 ELSE 1 END * CASE WHEN t.unit IS NULL THEN 1 ELSE 0.25 END, 6)::DOUBLE AS p
    FROM counted f LEFT JOIN top t USING (unit)""",
)
def typo_probability(spark, sf):
    freq = durable(word_freq(spark, sf))
    return rounded(rewrite.typo_probability(freq.select("unit"), durable(_vocab(freq, 500)), 0.4, 0.25), "p")


def _typo_sql(op: str, seed: int = 5) -> str:
    """(unit, cnt, op, typo) for one forced operation."""
    h, to = hash60(f"'{seed}'", f"'{op}'", "unit"), hash60(f"'{seed}'", f"'{op}'", "'to'", "unit")
    places = {
        "sub": "list_filter(range(1, n + 1), lambda i: regexp_full_match(c[i], '[0-9A-Za-z]'))",
        "case": "list_filter(range(1, n + 1), lambda i: regexp_full_match(c[i], '[A-Za-z]'))",
        "trans": "list_filter(range(1, n), lambda i: regexp_full_match(c[i], '[ -~]') AND regexp_full_match(c[i + 1], '[ -~]') AND c[i] <> c[i + 1])",
    }.get(op, "range(1, n + 1)")
    gate = 3 if op in ("sub", "case") else 5
    before, after = "substring(unit, 1, p - 1)", "substring(unit, p + 1)"
    turn = lambda base, n: f"chr((({base} + (ascii(c[p]) - {base} + 1 + {to} % {n - 1}) % {n}))::INT)"
    edit = {
        "sub": f"{before} || CASE WHEN regexp_matches(c[p], '[a-z]') THEN {turn(97, 26)} WHEN regexp_matches(c[p], '[A-Z]') THEN {turn(65, 26)} ELSE {turn(48, 10)} END || {after}",
        "del": f"{before} || {after}",
        "dup": f"{before} || c[p] || c[p] || {after}",
        "trans": f"{before} || c[p + 1] || c[p] || substring(unit, p + 2)",
        "case": f"{before} || CASE WHEN regexp_matches(c[p], '[a-z]') THEN upper(c[p]) ELSE lower(c[p]) END || {after}",
    }[op]
    return f"""SELECT unit, cnt, '{op}' AS op, CASE WHEN strlen(e) <= 32 THEN e END AS typo FROM (
      SELECT unit, cnt, CASE WHEN strlen(unit) >= {gate} AND p IS NOT NULL THEN {edit} END AS e FROM (
        SELECT unit, cnt, c, CASE WHEN len(pl) > 0 THEN pl[1 + {h} % len(pl)] END AS p FROM (
          SELECT *, {places} AS pl FROM ch)))"""


_CH = "ch AS (SELECT unit, cnt, length(unit) AS n, list_transform(range(1, length(unit) + 1), lambda i: substring(unit, i, 1)) AS c FROM freq)"
_TYPOS = f"{_CH}, typos AS (" + " UNION ALL ".join(_typo_sql(op) for op in rewrite.OPS) + ")"


def typos(spark, sf):
    freq = durable(word_freq(spark, sf))
    out = None
    for op in rewrite.OPS:
        part = rewrite.forced_typos(freq, op, 5).withColumn("op", F.lit(op))
        out = part if out is None else out.unionByName(part)
    return out


@query("C12_forced_typos", f"WITH {FREQ}, {_TYPOS} SELECT unit, op, typo FROM typos WHERE typo IS NOT NULL")
def forced_typos(spark, sf):
    return typos(spark, sf).select("unit", "op", "typo")


@query("C12_typo_variants")
def typo_variants(spark, sf):
    freq = durable(word_freq(spark, sf))
    return rewrite.typo_variants(freq.select("unit"), seed=5)


_PREFIX = """CASE WHEN least(strlen(typo), strlen(unit)) = 0 THEN 0 ELSE coalesce(list_min(list_filter(range(0, least(strlen(typo), strlen(unit))),
      lambda i: substr(hex(encode(typo)), 2 * i + 1, 2) <> substr(hex(encode(unit)), 2 * i + 1, 2))), least(strlen(typo), strlen(unit))) END"""


@query(
    "E13_string_match_report",
    f"""WITH {FREQ}, {_TYPOS}, m AS (SELECT op, cnt AS w, levenshtein(typo, unit) AS e, greatest(strlen(unit), 1) AS size, {_PREFIX} AS pre FROM typos WHERE typo IS NOT NULL),
    x AS (SELECT *, sum(w) OVER (PARTITION BY op ORDER BY e, w, pre ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY op) AS tot FROM m),
    md AS (SELECT op, (min(e) FILTER (cum >= (tot + 1) // 2) + min(e) FILTER (cum >= tot // 2 + 1)) / 2 AS median_edits FROM x GROUP BY op)
    SELECT op, sum(w)::BIGINT AS n, round(sum(w * (e = 0)::INT) / sum(w), 6) AS exact, any_value(median_edits)::DOUBLE AS median_edits,
      round(sum(w * e / size) / sum(w), 6) AS mean_ned, round(sum(w * pre / size) / sum(w), 6) AS prefix_share, round(sum(w * (e <= 1)::INT) / sum(w), 6) AS le1,
      round(sum(w * (e <= 2)::INT) / sum(w), 6) AS le2, round(sum(w * (e > 3)::INT) / sum(w), 6) AS gt3, 1.0::DOUBLE AS survival
    FROM m JOIN md USING (op) GROUP BY op""",
)
def string_match_report(spark, sf):
    pairs = typos(spark, sf).select("op", "cnt", F.col("typo").alias("pred"), F.col("unit").alias("true"))
    report = stats.string_match_report(pairs, ["op"])
    return rounded(report, "exact", "mean_ned", "prefix_share", "le1", "le2", "gt3", "survival")


@query(
    "E14_failure_class",
    f"""WITH {FREQ}, {_TYPOS} SELECT op, CASE WHEN levenshtein(t.typo, t.unit) = 0 THEN 'exact' WHEN levenshtein(t.typo, t.unit) <= 2 THEN 'typo'
      WHEN f.unit IS NOT NULL THEN 'far_real' ELSE 'garbage' END AS failure, count(*) AS n FROM (
        SELECT op, typo, unit FROM typos WHERE typo IS NOT NULL UNION ALL SELECT 'lower', lower(trim(unit)), unit FROM freq
        UNION ALL SELECT 'reverse', reverse(unit), unit FROM freq UNION ALL SELECT 'head', substring(unit, 1, 2), unit FROM freq) t
    LEFT JOIN freq f ON f.unit = t.typo GROUP BY ALL""",
)
def failure_class(spark, sf):
    freq = durable(word_freq(spark, sf))
    pairs = typos(spark, sf).select("op", F.col("typo").alias("pred"), F.col("unit").alias("true"))
    for op, pred in (("lower", F.lower(F.trim("unit"))), ("reverse", F.reverse("unit")), ("head", F.substring("unit", 1, 2))):
        pairs = pairs.unionByName(freq.select(F.lit(op).alias("op"), pred.alias("pred"), F.col("unit").alias("true")))
    return stats.failure_class(pairs, freq).groupBy("op", "failure").agg(F.count(F.lit(1)).alias("n"))


@query(
    "E15_fidelity",
    f"""WITH {FREQ}, {_TYPOS}, p AS (SELECT op, lower(typo) AS pred, typo AS target, unit AS source FROM typos WHERE typo IS NOT NULL)
    SELECT op, count(*) AS n, round(avg((pred = target)::INT), 6) AS fidelity, round(avg((pred = source)::INT), 6) AS snap_back FROM p GROUP BY op""",
)
def fidelity(spark, sf):
    """A readout that lower-cases everything, judged against the typo and its source."""
    rows = typos(spark, sf).select("op", F.lower("typo").alias("pred"), F.col("typo").alias("target"), F.col("unit").alias("source"))
    return rounded(stats.fidelity(rows), "fidelity", "snap_back")
