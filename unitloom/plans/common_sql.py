"""SQL fragments shared by the comparison queries (plain common table expressions)."""

RAW = r"""
raw AS (
  SELECT source AS shard, doc_id, lang, unnest(r) AS u, generate_subscripts(r, 1) AS i
  FROM (SELECT *, regexp_extract_all(text, '\p{N}|\p{L}+|[^\p{L}\p{N}]+') AS r FROM documents)
),
cls AS (
  SELECT *, regexp_matches(u, '^\p{L}') AS is_l,
         lead(u) OVER (PARTITION BY doc_id ORDER BY i) AS nxt,
         regexp_matches(lag(u) OVER (PARTITION BY doc_id ORDER BY i), '^\p{L}') AS prev_l,
         regexp_matches(lead(u) OVER (PARTITION BY doc_id ORDER BY i), '^\p{L}') AS next_l,
         lag(u) OVER (PARTITION BY doc_id ORDER BY i) AS prv
  FROM raw
)"""

UNITS = RAW + r""",
units AS (
  SELECT shard, doc_id, lang, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos,
         CASE WHEN is_l AND nxt = ' ' THEN u || ' ' ELSE u END AS unit
  FROM cls WHERE NOT (u = ' ' AND coalesce(prev_l, false))
)"""

FREQ = UNITS + r""",
freq AS (SELECT unit, count(*) AS cnt FROM units GROUP BY unit)"""

SIZE = 512

WINDOWS = UNITS + rf""",
seqd AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY doc_id, pos) - 1 AS seq FROM units),
shards AS (SELECT shard, count(*) AS n_units, count(*) // {SIZE} AS n_win FROM seqd GROUP BY shard),
numbered AS (
  SELECT *, coalesce(sum(n_win) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_win
  FROM shards
),
win AS (
  SELECT s.shard, s.doc_id, s.pos, s.unit, s.seq, (n.first_win + s.seq // {SIZE})::BIGINT AS window_id, s.seq % {SIZE} AS idx,
         strlen(s.unit) AS n_bytes, s.pos = 0 AS doc_start
  FROM seqd s JOIN numbered n USING (shard) WHERE s.seq < n.n_win * {SIZE}
)"""

CHOICES = r"""
choices AS (
  SELECT l_orderkey AS item_id, (l_linenumber - 1)::BIGINT AS choice_idx,
         -min(l_extendedprice) AS raw, -min(l_extendedprice * (1 - l_discount)) AS uncond,
         max(l_quantity) AS n_units, max(l_partkey) % 40 + 1 AS n_chars,
         min(l_returnflag) AS task, min(l_linestatus) AS tag, l_orderkey % 8 - 1 AS gold
  FROM lineitem GROUP BY l_orderkey, l_linenumber
)"""

RUNLOG = r"""
runlog AS (
  SELECT user_id AS run, event_id, ts, event_type, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step
  FROM events
)"""


def hash60(*parts: str) -> str:
    """60-bit hash of the joined keys as BIGINT."""
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15))::BIGINT"
