"""Registered queries: windows, packing and sampling order."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ..functions import WORD_PREV, coin
from ..operators import segment as seg, stats, windows as win
from ..session import durable
from ..sources import positional_store
from .common_sql import SIZE, UNITS, WINDOWS, hash60
from .corpus import SEP, positional_units, word_units
from .registry import documents, query
from .statistics import rounded


def seq_units(spark, sf, where=None):
    return positional_store.placed_units(spark, positional_units(spark, sf), SIZE, where)


def windowed(spark, sf):
    return win.make_windows(seq_units(spark, sf), SIZE)


def layout(spark, sf):
    """Windows by shard, from the store's totals alone."""
    return positional_store.geometry(spark, positional_units(spark, sf), SIZE)


_IDS = f"""ids AS (SELECT DISTINCT window_id FROM win)"""


@query(
    "D1_make_windows",
    f"""WITH {WINDOWS} SELECT window_id, shard, min(seq) AS first_seq, count(*) AS n_units, sum(n_bytes)::BIGINT AS n_bytes, max(idx) AS last_idx
    FROM win GROUP BY window_id, shard""",
)
def make_windows(spark, sf):
    return windowed(spark, sf).groupBy("window_id", "shard").agg(
        F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n_units"), F.sum("n_bytes").alias("n_bytes"), F.max("idx").alias("last_idx")
    )


@query(
    "D2_window_units_flags",
    f"""WITH {WINDOWS} SELECT window_id, md5(string_agg(unit, chr(31) ORDER BY idx)) AS stream,
      string_agg(CASE WHEN doc_start THEN '1' ELSE '0' END, '' ORDER BY idx) AS flags FROM win GROUP BY window_id""",
)
def window_units_flags(spark, sf):
    rows = win.gather_windows(windowed(spark, sf))
    flags = F.array_join(F.transform("doc_start", lambda d: F.when(d, "1").otherwise("0")), "")
    return rows.select("window_id", F.md5(F.array_join("units", SEP)).alias("stream"), flags.alias("flags"))


@query(
    "D3_read_unit_range",
    f"""WITH {WINDOWS} SELECT shard, seq, doc_id, unit, strlen(unit) AS n_bytes, sum(strlen(unit)) OVER (ORDER BY seq)::BIGINT AS byte_end,
      (sum(strlen(unit)) OVER (ORDER BY seq) - strlen(unit))::BIGINT AS byte_off FROM seqd WHERE shard = 'src3' AND seq >= 1000 AND seq < 3000""",
)
def read_unit_range(spark, sf):
    return positional_store.read_range(spark, positional_units(spark, sf), "src3", 1000, 2000)


@query(
    "D3_unit_at_byte",
    f"""WITH {WINDOWS}, b AS (SELECT shard, seq, doc_id, pos, unit, strlen(unit) AS n_bytes, (sum(strlen(unit)) OVER (ORDER BY seq) - strlen(unit))::BIGINT AS byte_off,
      pos = 0 AS doc_start FROM seqd WHERE shard = 'src3')
    SELECT * FROM b WHERE byte_off <= (SELECT sum(n_bytes) // 2 FROM b) AND byte_off + n_bytes > (SELECT sum(n_bytes) // 2 FROM b)""",
)
def unit_at_byte(spark, sf):
    """The unit in the middle of a shard's bytes."""
    path = positional_units(spark, sf)
    total = spark.read.parquet(f"{path}/shards").filter("shard = 'src3'").agg(F.coalesce(F.sum("shard_bytes"), F.lit(0))).first()[0]
    return positional_store.unit_at_byte(spark, path, "src3", total // 2)


@query(
    "D4_sample_windows",
    f"""WITH {WINDOWS}, {_IDS} SELECT window_id, row_number() OVER (ORDER BY {hash60("'41'", "window_id")}, window_id) AS place FROM ids QUALIFY place <= 256""",
)
def sample_windows(spark, sf):
    return win.sample_windows(win.window_ids(layout(spark, sf), SIZE), 256, 41)


@query(
    "D4_draw_windows",
    f"""WITH {WINDOWS}, {_IDS} SELECT i AS draw, {hash60("'5'", "i")} % (SELECT count(*) FROM ids) AS window_id FROM range(1000) t(i)""",
)
def draw_windows(spark, sf):
    return win.draw_windows(win.window_count(layout(spark, sf), SIZE), 1000, 5)


@query(
    "D5_sample_units",
    f"""WITH {UNITS} SELECT shard, doc_id, pos, unit FROM units ORDER BY {hash60("'53'", "doc_id", "pos")}, doc_id, pos LIMIT 3000""",
)
def sample_units(spark, sf):
    return win.sample_units(word_units(spark, sf), 3000, 53)


@query(
    "D6_rotation_plan",
    f"""WITH s AS (SELECT DISTINCT source AS shard FROM documents), p AS (SELECT shard, row_number() OVER (ORDER BY {hash60("'0'", "shard")}, shard) AS place FROM s)
    SELECT block, slot, shard FROM (SELECT b AS block, j AS slot, (b + j) % (SELECT count(*) FROM s) + 1 AS place FROM range(50) t(b), range(4) u(j)) JOIN p USING (place)""",
)
def rotation_plan(spark, sf):
    return win.rotation_plan(documents(spark, sf), resident=4, every=2000, steps=100000, seed=0)


_MERGED = f"""w AS (SELECT s.*, seq // {SIZE} AS local_window, seq % {SIZE} AS k FROM seqd s),
    e AS (SELECT *, lead(unit) OVER (PARTITION BY shard, local_window ORDER BY k) AS nu FROM w),
    m AS (SELECT *, (nu IS NOT NULL AND {hash60("'3'", "shard || '/' || local_window", "k")} < 345876451382054092 AND strlen(unit) + strlen(nu) <= 32)::INT AS can FROM e),
    isl AS (SELECT *, k - coalesce(max(CASE WHEN can = 0 THEN k END) OVER (PARTITION BY shard, local_window ORDER BY k), -1) AS run FROM m),
    t AS (SELECT *, can = 1 AND run % 2 = 1 AS taken FROM isl),
    mrg AS (SELECT shard, local_window, k, CASE WHEN taken THEN unit || nu ELSE unit END AS unit FROM (
      SELECT *, coalesce(lag(taken) OVER (PARTITION BY shard, local_window ORDER BY k), false) AS gone FROM t) WHERE NOT gone),
    mid AS (SELECT shard, local_window, unit, row_number() OVER (PARTITION BY shard, local_window ORDER BY k) - 1 AS j FROM mrg)"""


def _all_windows(spark, sf, dealt=False):
    raw = win.make_windows(seq_units(spark, sf), SIZE, tail=True)
    gathered = raw.withColumnRenamed("shard", "shard_name").withColumn("shard", F.col("shard_name"))
    return (
        win.gather_windows(gathered, ["shard_name", "local_window"], dealt)
        .drop("shard", "seq0", "doc_start")
        .withColumnRenamed("shard_name", "shard")
        .withColumn("wkey", F.concat_ws("/", "shard", F.col("local_window").cast("string")))
    )


@query(
    "C10_augment_merge",
    f"""WITH {WINDOWS}, {_MERGED} SELECT shard, local_window, count(*) AS n_units, md5(string_agg(unit, chr(31) ORDER BY j)) AS stream FROM mid GROUP BY ALL""",
)
def augment_merge(spark, sf):
    merged = win.merge_pass(_all_windows(spark, sf), 0.3, 32, 3, "wkey")
    return merged.select("shard", "local_window", F.size("units").cast("bigint").alias("n_units"), F.md5(F.array_join("units", SEP)).alias("stream"))


@query(
    "C11_augment_split",
    f"""WITH {UNITS}, h AS (SELECT doc_id, pos, unit, length(unit) AS n, {hash60("'9'", "doc_id", "pos")} < 230584300921369395 AS hit,
      {hash60("'9cut'", "doc_id", "pos")} AS cut FROM units)
    SELECT doc_id, sum(CASE WHEN hit AND n >= 2 THEN 2 ELSE 1 END)::BIGINT AS n_units,
      md5(string_agg(CASE WHEN hit AND n >= 2 THEN substring(unit, 1, cut % (n - 1) + 1) || chr(31) || substring(unit, cut % (n - 1) + 2) ELSE unit END, chr(31) ORDER BY pos)) AS stream
    FROM h GROUP BY doc_id""",
)
def augment_split(spark, sf):
    docs = documents(spark, sf).select("doc_id", seg.unit_array("text", WORD_PREV, 32).alias("units"))
    out = win.split_pass(docs, 0.2, 9, "doc_id")
    return out.select("doc_id", F.size("units").cast("bigint").alias("n_units"), F.md5(F.array_join("units", SEP)).alias("stream"))


@query(
    "D7_refit_windows",
    f"""WITH {WINDOWS}, {_MERGED}, n AS (SELECT shard, local_window, count(*) AS got FROM mid GROUP BY ALL),
    nxt AS (SELECT shard, local_window - 1 AS local_window, unit, k FROM w),
    navail AS (SELECT shard, local_window, count(*) AS have FROM nxt GROUP BY ALL),
    plan AS (SELECT n.shard, n.local_window, got, {SIZE} - got AS miss, coalesce(have, 0) AS have FROM n JOIN numbered s USING (shard)
      LEFT JOIN navail a ON a.shard = n.shard AND a.local_window = n.local_window WHERE n.local_window < s.n_win),
    fit AS (
      SELECT p.shard, p.local_window, j, m.unit FROM plan p JOIN mid m USING (shard, local_window) WHERE miss <= have AND j < {SIZE}
      UNION ALL SELECT p.shard, p.local_window, got + k, x.unit FROM plan p JOIN nxt x USING (shard, local_window) WHERE miss <= have AND k < miss
      UNION ALL SELECT p.shard, p.local_window, k, r.unit FROM plan p JOIN w r USING (shard, local_window) WHERE miss > have)
    SELECT f.shard, f.local_window, count(*) AS n_units, md5(string_agg(f.unit, chr(31) ORDER BY j)) AS stream,
      any_value(CASE WHEN miss < 0 THEN 'trim' WHEN miss = 0 THEN 'same' WHEN have >= miss THEN 'pad' ELSE 'raw' END) AS how
    FROM fit f JOIN plan USING (shard, local_window) GROUP BY f.shard, f.local_window""",
)
def refit_windows(spark, sf):
    # Not made durable: its one exchange serves all three uses, and holds less than a checkpoint of the windows.
    raw = _all_windows(spark, sf, dealt=True)
    whole = raw.filter(F.size("units") == SIZE)
    merged = win.merge_pass(whole, 0.3, 32, 3, "wkey")
    out = win.refit_windows(merged.select("shard", "local_window", "units"), raw, SIZE)
    return out.select("shard", "local_window", F.size("units").cast("bigint").alias("n_units"), F.md5(F.array_join("units", SEP)).alias("stream"), "how")


@query(
    "D8_tensorize",
    f"""WITH {WINDOWS}, hx AS (SELECT window_id, idx, n_bytes, hex(encode(unit)) AS h, sum(n_bytes) OVER (PARTITION BY window_id ORDER BY idx)::BIGINT AS e FROM win)
    SELECT window_id, sum(n_bytes)::BIGINT AS flat_len, md5(string_agg(e::VARCHAR, ',' ORDER BY idx)) AS ends,
      md5(string_agg(h || repeat('..', (32 - n_bytes)::INT), '' ORDER BY idx)) AS canvas,
      sum(32 - n_bytes)::BIGINT AS n_pad, sum(idx * n_bytes)::BIGINT AS map_sum FROM hx GROUP BY window_id""",
)
def tensorize(spark, sf):
    t = win.tensorize(win.gather_windows(windowed(spark, sf)), 32)
    digests = t.select("window_id", "flat_len", "ends", "byte_ids", "pad_mask", "patch_pos").mapInArrow(
        _canvas_digests, "window_id long, flat_len long, ends array<bigint>, canvas string, n_pad long, map_sum long"
    )
    return digests.withColumn("ends", F.md5(F.array_join("ends", ",")))


def _canvas_digests(batches):
    """MD5 of every canvas as hex with ``..`` for padding, its padded cells and the sum of its byte-to-unit map."""
    text = np.array([list(b"%02X" % b) for b in range(256)] + [list(b"..")], np.uint8)
    for batch in batches:
        window, length, ends, cells, pads, units = batch.columns
        canvas = [hashlib.md5(text[row.values.flatten().to_numpy()]).hexdigest() for row in cells]
        n_pad = [pc.sum(row.values.flatten()).as_py() or 0 for row in pads]
        total = [int(row.values.to_numpy().sum()) for row in units]
        columns = [window, length, ends, pa.array(canvas), pa.array(n_pad, pa.int64()), pa.array(total, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["window_id", "flat_len", "ends", "canvas", "n_pad", "map_sum"])


_TARGETS = f"""tb AS (SELECT window_id, idx, n_bytes, hex(encode(unit)) AS h FROM win),
    tj AS (SELECT a.window_id, a.idx, b.idx - a.idx AS k, b.h, b.n_bytes,
      sum(b.n_bytes) OVER (PARTITION BY a.window_id, a.idx ORDER BY b.idx) - b.n_bytes AS before
      FROM tb a JOIN tb b ON a.window_id = b.window_id AND b.idx BETWEEN a.idx + 1 AND a.idx + 4),
    tgt AS (SELECT window_id, idx, (before + r + 1)::BIGINT AS delta, k, r, ('0x' || substr(h, 2 * r + 1, 2))::BIGINT AS byte, 0.8 ** (k - 1) AS weight
      FROM (SELECT *, unnest(range(0, n_bytes)) AS r FROM tj) WHERE before + r < 16)"""


@query(
    "D9_future_targets",
    f"""WITH {WINDOWS}, {_TARGETS} SELECT window_id, count(*) AS n, sum(delta)::BIGINT AS s_delta, sum(k)::BIGINT AS s_k, sum(r)::BIGINT AS s_r,
      sum(byte * delta)::BIGINT AS s_byte, round(sum(weight), 6) AS s_weight FROM tgt GROUP BY window_id""",
)
def future_targets(spark, sf):
    t = win.future_targets(windowed(spark, sf), 4, 0.8, 16)
    return t.groupBy("window_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("delta").alias("s_delta"), F.sum("k").alias("s_k"), F.sum("r").alias("s_r"),
        F.sum(F.col("byte") * F.col("delta")).alias("s_byte"), F.round(F.sum("weight"), 6).alias("s_weight"),
    )


_SEGS = """segs AS (SELECT window_id, piece, min(idx) AS first_idx, count(*) AS length FROM (
      SELECT *, sum(doc_start::INT) OVER (PARTITION BY window_id ORDER BY idx) AS piece FROM win) GROUP BY window_id, piece)"""


@query("D10_doc_segments", f"WITH {WINDOWS}, {_SEGS} SELECT window_id, first_idx, length FROM segs")
def doc_segments(spark, sf):
    return win.doc_segments(windowed(spark, sf))


@query(
    "D11_boundary_weight",
    f"""WITH {WINDOWS} SELECT shard, sum(CASE WHEN doc_start THEN 0 ELSE 1 END)::DOUBLE AS weight,
      round(sum(CASE WHEN doc_start THEN 0 ELSE n_bytes END) / greatest(sum(CASE WHEN doc_start THEN 0 ELSE 1 END), 1), 6) AS mean_bytes FROM win GROUP BY shard""",
)
def boundary_weights(spark, sf):
    from ..functions import boundary_weight, weighted_mean

    w = windowed(spark, sf).withColumn("w", boundary_weight())
    return w.groupBy("shard").agg(F.sum("w").alias("weight"), F.round(weighted_mean("n_bytes", "w"), 6).alias("mean_bytes"))


@query("D12_attention_pairs", f"WITH {WINDOWS}, {_SEGS} SELECT window_id, (sum(length * (length + 1)) // 2)::BIGINT AS allowed FROM segs GROUP BY window_id")
def attention_pairs(spark, sf):
    return win.attention_pairs(win.doc_segments(windowed(spark, sf)))


@query(
    "D13_packing_waste",
    f"""WITH {WINDOWS}, r AS (SELECT window_id, sum(n_bytes) AS row_bytes FROM win GROUP BY window_id)
    SELECT * FROM (SELECT round(avg(n_bytes), 6) AS mean, quantile_cont(n_bytes, 0.5)::DOUBLE AS p50, quantile_cont(n_bytes, 0.9)::DOUBLE AS p90,
      quantile_cont(n_bytes, 0.99)::DOUBLE AS p99, max(n_bytes) AS max FROM win),
    (SELECT count(*) AS n_windows, round(avg(row_bytes), 6) AS row_mean, min(row_bytes)::BIGINT AS row_min, max(row_bytes)::BIGINT AS row_max,
      round(1 - sum(row_bytes) / (count(*) * {SIZE} * 32), 6) AS pad_ratio, round({SIZE * 32}.0 / avg(row_bytes), 6) AS waste FROM r)""",
)
def packing_waste(spark, sf):
    return rounded(win.packing_waste(windowed(spark, sf), SIZE, 32), "mean", "row_mean", "pad_ratio", "waste")


@query(
    "D14_rolling_eval_plan",
    f"""WITH {UNITS}, b AS (SELECT doc_id, pos, CASE WHEN pos < 128 THEN 0 ELSE (pos - 128) // 64 + 1 END AS block FROM units)
    SELECT doc_id, block, CASE WHEN block = 0 THEN 0 ELSE 128 + (block - 1) * 64 END AS block_start,
      CASE WHEN block = 0 THEN 0 ELSE 128 + (block - 1) * 64 - 64 END AS context_start, count(*) AS n_scored, max(pos) AS last_pos FROM b GROUP BY ALL""",
)
def rolling_eval_plan(spark, sf):
    plan = win.rolling_eval_plan(word_units(spark, sf), 128)
    return plan.groupBy("doc_id", "block", "block_start", "context_start").agg(F.count(F.lit(1)).alias("n_scored"), F.max("pos").alias("last_pos"))


@query(
    "D14_rolling_eval_blocks",
    f"""WITH {UNITS}, b AS (SELECT *, CASE WHEN pos < 128 THEN 0 ELSE (pos - 128) // 64 + 1 END AS block FROM units),
    s AS (SELECT shard, doc_id, block, min(pos) AS first, count(*) AS n_scored, md5(string_agg(unit, '|' ORDER BY pos)) AS scored_md5 FROM b GROUP BY ALL),
    c AS (SELECT s.shard, s.doc_id, s.block, count(*) AS n_context, md5(string_agg(unit, '|' ORDER BY pos)) AS context_md5
      FROM s JOIN units u ON s.shard = u.shard AND s.doc_id = u.doc_id AND s.block > 0 AND u.pos >= s.first - 64 AND u.pos < s.first GROUP BY ALL)
    SELECT doc_id, block, coalesce(n_context, 0) AS n_context, n_scored, coalesce(context_md5, md5('')) AS context_md5, scored_md5 FROM s LEFT JOIN c USING (shard, doc_id, block)""",
)
def rolling_eval_blocks(spark, sf):
    text = lambda column: F.md5(F.array_join(column, "|"))
    blocks = win.rolling_eval_blocks(word_units(spark, sf), 128)
    return blocks.select(
        "doc_id", "block", F.size("context").cast("bigint").alias("n_context"), F.size("scored").cast("bigint").alias("n_scored"),
        text("context").alias("context_md5"), text("scored").alias("scored_md5"),
    )


@query(
    "D16_next_unit_pairs",
    f"""WITH {UNITS}, p AS (SELECT doc_id, pos, lag(unit) OVER (PARTITION BY doc_id ORDER BY pos) AS prev, unit AS next FROM units),
    c AS (SELECT prev, next, count(*) AS cnt FROM p WHERE pos > 0 GROUP BY ALL)
    SELECT prev, next, cnt FROM c
    UNION ALL SELECT '(persistence)', '(all)', sum(CASE WHEN prev = next THEN cnt ELSE 0 END)::BIGINT FROM c
    UNION ALL SELECT '(total)', '(all)', sum(cnt)::BIGINT FROM c""",
)
def next_unit_pairs(spark, sf):
    """Pair counts; pairs are built in the document row, so only counted pairs are shuffled."""
    docs = documents(spark, sf).select(seg.unit_array("text", WORD_PREV, 32).alias("units"))
    pairs = docs.select(F.explode(win.pair_arrays(F.col("units"))).alias("p")).select("p.*").filter("prev IS NOT NULL")
    counts = durable(pairs.groupBy("prev", "next").agg(F.count(F.lit(1)).alias("cnt")))
    totals = counts.agg(
        F.sum(F.when(F.col("prev") == F.col("next"), F.col("cnt")).otherwise(0)).alias("same"), F.sum("cnt").alias("all")
    ).select(
        F.explode(
            F.array(
                F.struct(F.lit("(persistence)").alias("prev"), F.lit("(all)").alias("next"), F.col("same").alias("cnt")),
                F.struct(F.lit("(total)").alias("prev"), F.lit("(all)").alias("next"), F.col("all").alias("cnt")),
            )
        ).alias("t")
    ).select("t.*")
    return counts.unionByName(totals)


@query(
    "D17_context_snippets",
    f"""WITH {UNITS}, s AS (SELECT doc_id, pos, coalesce(string_agg(unit, '') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), '') AS context FROM units)
    SELECT doc_id, count(*) AS n, sum(strlen(context))::BIGINT AS n_bytes, md5(string_agg(context, chr(31) ORDER BY pos)) AS stream FROM s GROUP BY doc_id""",
)
def context_snippets(spark, sf):
    docs = documents(spark, sf).select("doc_id", seg.unit_array("text", WORD_PREV, 32).alias("units"))
    rows = docs.select("doc_id", win.context_arrays(F.col("units"), 6).alias("context"))
    size = F.aggregate("context", F.lit(0).cast("bigint"), lambda a, c: a + F.octet_length(c))
    return rows.select(
        "doc_id", F.size("context").cast("bigint").alias("n"), size.alias("n_bytes"), F.md5(F.array_join("context", SEP)).alias("stream")
    )


@query(
    "B9_holdout_tail",
    f"""WITH {WINDOWS} SELECT window_id, shard, count(*) AS n_units, sum(n_bytes)::BIGINT AS n_bytes FROM win
    WHERE window_id > (SELECT max(window_id) FROM win) - 8 GROUP BY window_id, shard""",
)
def holdout_tail(spark, sf):
    ends = win.make_windows(seq_units(spark, sf, positional_store.last_windows(spark, positional_units(spark, sf), SIZE, 8)), SIZE)
    rows = ends.groupBy("window_id", "shard").agg(F.count(F.lit(1)).alias("n_units"), F.sum("n_bytes").alias("n_bytes"))
    return win.holdout_tail(durable(rows), 8)


_PLACED = f"""placed AS (SELECT window_id, row_number() OVER (ORDER BY {hash60("'59'", "window_id")}, window_id) AS place FROM ids)"""
_GROWTH = """first AS (SELECT unit, min(place) AS f FROM win JOIN placed USING (window_id) WHERE place <= 600 GROUP BY unit),
    curve AS (SELECT step, count(*) AS n_distinct FROM first, (SELECT unnest([10, 50, 100, 300, 600]) AS step) WHERE f <= step GROUP BY step)"""
LADDER = [10, 50, 100, 300, 600]


def growth(spark, sf):
    windows = windowed(spark, sf)
    placed = win.sample_windows(win.window_ids(layout(spark, sf), SIZE), max(LADDER), 59)
    return stats.distinct_growth(windows.join(placed, "window_id").select("unit", "place"), LADDER)


@query("E5_distinct_growth", f"WITH {WINDOWS}, {_IDS}, {_PLACED}, {_GROWTH} SELECT step::BIGINT AS step, n_distinct FROM curve")
def distinct_growth(spark, sf):
    return growth(spark, sf)


@query(
    "E6_heaps_fit",
    f"""WITH {WINDOWS}, {_IDS}, {_PLACED}, {_GROWTH}, f AS (SELECT regr_slope(ln(n_distinct), ln(step * {SIZE})) AS beta, regr_intercept(ln(n_distinct), ln(step * {SIZE})) AS log_k FROM curve)
    SELECT round(beta, 6) AS beta, round(log_k, 6) AS log_k, round(exp(log_k) * (SELECT count(*) FROM units) ** beta, 2) AS estimate FROM f""",
)
def heaps_fit(spark, sf):
    curve = growth(spark, sf).withColumn("n_units", F.col("step") * SIZE)
    total = seg.unit_counts(documents(spark, sf)).agg(F.sum("n_units").alias("total"))
    fit = stats.heaps_fit(curve, "n_units", "n_distinct", total)
    return fit.select(F.round("beta", 6).alias("beta"), F.round("log_k", 6).alias("log_k"), F.round("estimate", 2).alias("estimate"))


_PARTS = {"freq": (256, 41), "val": (4, 47), "probe": (24, 43), "ladder": (1000, 59)}


@query(
    "E17_eval_sample",
    f"WITH {WINDOWS}, {_IDS}, draws AS ("
    + " UNION ALL ".join(
        f"SELECT '{name}' AS part, window_id, place FROM (SELECT window_id, row_number() OVER (ORDER BY {hash60(repr(str(seed)), 'window_id')}, window_id) AS place FROM ids) WHERE place <= {n}"
        for name, (n, seed) in _PARTS.items()
    )
    + ") SELECT part, window_id, place, count(*) AS n_units, sum(n_bytes)::BIGINT AS n_bytes FROM draws JOIN win USING (window_id) GROUP BY ALL",
)
def eval_sample(spark, sf):
    windows = windowed(spark, sf)
    ids = durable(win.window_ids(layout(spark, sf), SIZE))
    draws = None
    for name, (n, seed) in _PARTS.items():
        part = win.sample_windows(ids, n, seed).withColumn("part", F.lit(name))
        draws = part if draws is None else draws.unionByName(part)
    return windows.join(draws, "window_id").groupBy("part", "window_id", "place").agg(
        F.count(F.lit(1)).alias("n_units"), F.sum("n_bytes").alias("n_bytes")
    )
