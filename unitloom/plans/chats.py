"""Registered queries: conversation data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chat, rewrite, segment as seg
from ..operators.ordered import ranked
from ..session import durable
from ..sources import unit_store
from .corpus import SEP, scratch, word_freq
from .common_sql import FREQ
from .registry import query, table
from .rewriting import MIN_COUNT, THRESH, _MODEL
from .statistics import rounded


def turns(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")


def _render_sql(sep: str = "''", src: str = "conversations") -> str:
    """Turn parts, whole renderings and their units for one separator expression."""
    return rf"""part AS (SELECT *, CASE role WHEN 'user' THEN '<|user|>' WHEN 'assistant' THEN '<|assistant|>' WHEN 'system' THEN '<|system|>' ELSE '' END AS mk,
      text || CASE WHEN role = 'assistant' THEN '<|end|>' ELSE '' END AS body, {sep} AS sp FROM {src}),
    rend AS (SELECT *, mk || body || sp AS t, sum(strlen(mk || body || sp)) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM part),
    span AS (SELECT conv_id, turn, role, t, (e - strlen(t))::BIGINT AS s, e::BIGINT AS e, (e - strlen(t) + strlen(mk))::BIGINT AS ts, (e - strlen(sp))::BIGINT AS te FROM rend),
    whole AS (SELECT conv_id, string_agg(t, '' ORDER BY turn) AS text FROM span GROUP BY conv_id),
    craw AS (SELECT conv_id, unnest(r) AS u, generate_subscripts(r, 1) AS i FROM (SELECT *, regexp_extract_all(text, '\p{{N}}|\p{{L}}+|[^\p{{L}}\p{{N}}]+') AS r FROM whole)),
    ccls AS (SELECT *, regexp_matches(u, '^\p{{L}}') AS is_l, lead(u) OVER w AS nxt, regexp_matches(lag(u) OVER w, '^\p{{L}}') AS prev_l
      FROM craw WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
    cm AS (SELECT conv_id, i, CASE WHEN is_l AND nxt = ' ' THEN u || ' ' ELSE u END AS unit FROM ccls WHERE NOT (u = ' ' AND coalesce(prev_l, false))),
    co AS (SELECT conv_id, i, unit, (sum(strlen(unit)) OVER (PARTITION BY conv_id ORDER BY i) - strlen(unit))::BIGINT AS off FROM cm),
    cu AS (SELECT co.*, s.conv_id IS NOT NULL AS is_target FROM co LEFT JOIN span s ON s.conv_id = co.conv_id AND s.role = 'assistant' AND off >= s.ts AND off < s.te)"""


RENDER = _render_sql()


@query("F1_normalize_turns", "SELECT conv_id * 1000 + turn AS row_id, 0::BIGINT AS turn, role, text || ' ' || role AS text FROM conversations")
def normalize_turns(spark, sf):
    """Nested messages whose content is a list of parts."""
    content = F.array(F.struct(F.col("text").alias("text")), F.struct(F.col("role").alias("text")))
    nested = turns(spark, sf).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), F.array(F.struct("role", content.alias("content"))).alias("messages")
    )
    return chat.normalize_turns(nested, "row_id")


@query("F1_normalize_alternate", "SELECT conv_id * 1000 + turn AS row_id, 0::BIGINT AS turn, role, text FROM conversations")
def normalize_alternate(spark, sf):
    nested = turns(spark, sf).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"),
        F.array(F.struct(F.col("role").alias("from"), F.col("text").alias("value"))).alias("conversations"),
    )
    return chat.normalize_turns(nested, "row_id")


@query("F2_render_chat", f"WITH {RENDER} SELECT conv_id, turn, s AS start, e AS \"end\", t AS text FROM span")
def render_chat(spark, sf):
    return chat.render_turns(turns(spark, sf)).select("conv_id", "turn", "start", "end", "text")


@query("F3_target_spans", f"WITH {RENDER} SELECT conv_id, turn, ts AS s, te AS e FROM span WHERE role = 'assistant'")
def target_spans(spark, sf):
    return chat.target_spans(chat.render_turns(turns(spark, sf)))


def chat_units(spark, sf):
    return chat.chat_units(chat.render_turns(turns(spark, sf)))


@query("F4_unit_targets", f"WITH {RENDER} SELECT conv_id, off AS byte_off, unit, strlen(unit) AS n_bytes, is_target FROM cu")
def unit_targets(spark, sf):
    return chat_units(spark, sf)


_SIZES = """sz AS (SELECT conv_id, count(*) AS n_units, sum(is_target::INT)::BIGINT AS n_target FROM cu GROUP BY conv_id),
    tz AS (SELECT conv_id, sum(length(text))::BIGINT AS n_chars, count(*) AS n_turns FROM conversations GROUP BY conv_id)"""


def _stat(c: str) -> str:
    return ", ".join(
        [f"round(avg({c}), 6) AS {c}_mean"]
        + [f"round(quantile_cont({c}, {q})::DOUBLE, 6) AS {c}_{n}" for q, n in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99"))]
        + [f"max({c}) AS {c}_max"]
    )


@query(
    "F5_sft_profile",
    f"""WITH {RENDER}, {_SIZES} SELECT count(*) AS n_convs, {_stat("n_units")}, {_stat("n_chars")}, round(sum(n_target) / sum(n_units), 6) AS target_share,
      round(avg((n_units > 512)::INT), 6) AS truncated FROM sz JOIN tz USING (conv_id)""",
)
def sft_profile(spark, sf):
    out = chat.sft_profile(chat.conversation_sizes(chat_units(spark, sf), turns(spark, sf)), 512)
    names = [f"{c}_{n}" for c in ("n_units", "n_chars") for n in ("mean", "p50", "p90", "p99")]
    return rounded(out, *names, "target_share", "truncated")


@query("F5_turn_histogram", "SELECT n_turns, count(*) AS n_convs FROM (SELECT conv_id, count(*) AS n_turns FROM conversations GROUP BY conv_id) GROUP BY n_turns")
def turn_histogram(spark, sf):
    return chat.turn_histogram(turns(spark, sf).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns")))


@query(
    "F6_epoch_estimate",
    f"""WITH {RENDER}, {_SIZES} SELECT round(avg(n_units) * 484570, 2) AS units, round(avg(n_units) * 484570 / 196608, 4) AS steps,
      round(avg(n_units) * 484570 / 196608 * 10.5 / 3600, 6) AS hours FROM sz""",
)
def epoch_estimate(spark, sf):
    profile = chat.sft_profile(chat.conversation_sizes(chat_units(spark, sf), turns(spark, sf)), 512)
    e = chat.epoch_estimate(profile, 484570, 196608, 10.5)
    return e.select(F.round("units", 2).alias("units"), F.round("steps", 4).alias("steps"), F.round("hours", 6).alias("hours"))


_MARK = "(contains(unit, '<|') OR contains(unit, '|>') OR unit IN ('user', 'assistant', 'system', 'end'))"
_CROSS = "(contains(unit, '|>') AND contains(unit, '<|'))"


@query("F7_marker_forms", f"WITH {RENDER} SELECT unit, count(*) AS cnt, {_CROSS} AS cross_turn FROM cu WHERE {_MARK} GROUP BY unit ORDER BY cnt DESC, unit LIMIT 15")
def marker_forms(spark, sf):
    return chat.marker_forms(chat_units(spark, sf)).orderBy(F.col("cnt").desc(), "unit").limit(15)


def _sep_sql() -> str:
    src = "(SELECT conv_id * 4 + k AS conv_id, turn, role, text, sep, sep_name FROM conversations, (VALUES (0, 'newline', chr(10)), (1, 'space', ' '), (2, 'none', '')) v(k, sep_name, sep))"
    return _render_sql("sep", src)


@query(
    "F8_compare_separators",
    f"""WITH {FREQ}, {_MODEL}, {_sep_sql()}, cn AS (SELECT conv_id % 4 AS k, unit, count(*) AS cnt, sum(is_target::INT) AS nt FROM cu GROUP BY ALL),
    du AS (SELECT DISTINCT unit FROM cn), dx AS (SELECT unit, hex(encode(unit)) AS h, unnest(range(0, strlen(unit))) AS i FROM du),
    ds AS (SELECT x.unit, NOT any_value(coalesce(f.cnt, 0)) >= {MIN_COUNT} OR avg(coalesce(bits, 16)) > {THRESH} AS bad FROM dx x
      LEFT JOIN model m ON m.prev = CASE WHEN i = 0 THEN '^' ELSE substr(h, 2 * i - 1, 2) END AND m.byte = substr(h, 2 * i + 1, 2)
      LEFT JOIN freq f ON f.unit = x.unit GROUP BY x.unit),
    g AS (SELECT CASE k WHEN 0 THEN 'newline' WHEN 1 THEN 'space' ELSE 'none' END AS sep_name, sum(cnt)::BIGINT AS n_units, sum(nt)::BIGINT AS n_target,
      coalesce(sum(cnt) FILTER (WHERE {_CROSS}), 0)::BIGINT AS n_cross, coalesce(sum(cnt) FILTER (WHERE {_MARK}), 0)::BIGINT AS n_marker,
      coalesce(sum(cnt) FILTER (WHERE bad), 0)::BIGINT AS n_flag, coalesce(sum(cnt) FILTER (WHERE bad AND {_MARK}), 0)::BIGINT AS n_flag_marker
      FROM cn JOIN ds USING (unit) GROUP BY k)
    SELECT *, round(n_target / n_units, 6) AS target_share, round(n_cross / n_units, 6) AS cross_share, round(n_flag / n_units, 6) AS flag_share,
      row_number() OVER (ORDER BY n_cross / n_units, n_flag / n_units, sep_name) = 1 AS recommended FROM g""",
)
def compare_separators(spark, sf):
    freq = durable(word_freq(spark, sf))
    out = chat.compare_separators(turns(spark, sf), rewrite.bigram_scorer(freq, MIN_COUNT), THRESH)
    return rounded(out, "target_share", "cross_share", "flag_share")


@query(
    "F9_write_target_store",
    f"""WITH {RENDER} SELECT (conv_id % 4)::VARCHAR AS shard, count(*) AS n_units, sum(is_target::INT)::BIGINT AS n_target, count(DISTINCT conv_id) AS n_docs,
      sum(strlen(unit))::BIGINT AS n_bytes, sum(place)::BIGINT AS places, sum(off)::BIGINT AS offsets
      FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY off) - 1 AS place FROM cu) GROUP BY 1""",
)
def write_target_store(spark, sf):
    placed = ranked(chat_units(spark, sf), ["conv_id"], ["byte_off"], "place")
    units = placed.select(
        F.pmod("conv_id", F.lit(4)).cast("string").alias("shard"),
        F.col("conv_id").alias("doc_id"),
        (F.col("place") - 1).alias("pos"),
        "byte_off",
        "unit",
        "n_bytes",
        (F.col("byte_off") == 0).alias("doc_start"),
        "is_target",
    )
    path = scratch(spark)
    unit_store.write_units(units, path)
    return unit_store.read_units(spark, path).groupBy("shard").agg(
        F.count(F.lit(1)).alias("n_units"),
        F.sum(F.col("is_target").cast("bigint")).alias("n_target"),
        F.sum(F.col("doc_start").cast("bigint")).alias("n_docs"),
        F.sum("n_bytes").alias("n_bytes"),
        F.sum("pos").alias("places"),
        F.sum("byte_off").alias("offsets"),
    )


def _pairs(spark, sf):
    """(context, continuation): a turn followed by an assistant turn."""
    t = turns(spark, sf)
    nxt = t.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("cont"))
    return t.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.col("text").alias("ctx"), F.concat(F.lit(" "), "cont").alias("cont"))


def _unit_sql(name: str, src: str, text: str) -> str:
    return rf"""{name}_raw AS (SELECT conv_id, turn, unnest(r) AS u, generate_subscripts(r, 1) AS i FROM (SELECT conv_id, turn, regexp_extract_all({text}, '\p{{N}}|\p{{L}}+|[^\p{{L}}\p{{N}}]+') AS r FROM {src})),
    {name}_cls AS (SELECT *, regexp_matches(u, '^\p{{L}}') AS is_l, lead(u) OVER w AS nxt, regexp_matches(lag(u) OVER w, '^\p{{L}}') AS prev_l FROM {name}_raw WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
    {name} AS (SELECT conv_id, turn, i, CASE WHEN is_l AND nxt = ' ' THEN u || ' ' ELSE u END AS unit FROM {name}_cls WHERE NOT (u = ' ' AND coalesce(prev_l, false)))"""


_BOUNDARY = rf"""pr AS (SELECT a.conv_id, a.turn, regexp_replace(a.text, '\s+$', '') AS ctx,
      substr(a.text, length(regexp_replace(a.text, '\s+$', '')) + 1) || ' ' || b.text AS cont FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant'),
    {_unit_sql("ju", "pr", "ctx || cont")}, {_unit_sql("xu", "pr", "ctx")}, {_unit_sql("ou", "pr", "regexp_replace(cont, '^[ ]*[[:space:]]*', '')")},
    jo AS (SELECT *, sum(strlen(unit)) OVER (PARTITION BY conv_id, turn ORDER BY i) - strlen(unit) < strlen(ctx) AS in_ctx FROM ju JOIN pr USING (conv_id, turn)),
    js AS (SELECT conv_id, turn, count(*) FILTER (in_ctx) AS jc, count(*) FILTER (NOT in_ctx) AS jn, string_agg(unit, chr(31) ORDER BY i) FILTER (in_ctx) AS jcs, string_agg(unit, chr(31) ORDER BY i) FILTER (NOT in_ctx) AS jns FROM jo GROUP BY ALL),
    xs AS (SELECT conv_id, turn, count(*) AS xc, string_agg(unit, chr(31) ORDER BY i) AS xcs FROM xu GROUP BY ALL),
    os AS (SELECT conv_id, turn, count(*) AS oc, string_agg(unit, chr(31) ORDER BY i) AS ocs FROM ou GROUP BY ALL),
    al AS (SELECT *, jn = 0 OR jn <> coalesce(oc, 0) AS fallback FROM js LEFT JOIN xs USING (conv_id, turn) LEFT JOIN os USING (conv_id, turn)),
    cc AS (SELECT conv_id, turn, fallback, coalesce(CASE WHEN fallback THEN xcs ELSE jcs END, '') AS ctx_units, coalesce(CASE WHEN fallback THEN ocs ELSE jns END, '') AS cont_units FROM al)"""


@query("D18_split_by_byte_boundary", f"WITH {_BOUNDARY} SELECT * FROM cc")
def split_by_byte_boundary(spark, sf):
    out = chat.split_by_byte_boundary(_pairs(spark, sf))
    return out.select("conv_id", "turn", "fallback", F.array_join("ctx_units", SEP).alias("ctx_units"), F.array_join("cont_units", SEP).alias("cont_units"))


@query(
    "D15_truncate_context",
    f"""WITH {_BOUNDARY}, l AS (SELECT conv_id, turn, CASE WHEN ctx_units = '' THEN [] ELSE string_split(ctx_units, chr(31)) END AS c, CASE WHEN cont_units = '' THEN [] ELSE string_split(cont_units, chr(31)) END AS t FROM cc)
    SELECT conv_id, turn, array_to_string(t[1:128], chr(31)) AS cont_units,
      array_to_string(CASE WHEN len(t) >= 128 THEN [] ELSE c[greatest(len(c) - (128 - len(t)) + 1, 1):] END, chr(31)) AS ctx_units FROM l""",
)
def truncate_context(spark, sf):
    pairs = chat.split_by_byte_boundary(_pairs(spark, sf)).select("conv_id", "turn", "ctx_units", "cont_units")
    out = chat.truncate_context(pairs, 128)
    return out.select("conv_id", "turn", F.array_join("cont_units", SEP).alias("cont_units"), F.array_join("ctx_units", SEP).alias("ctx_units"))
