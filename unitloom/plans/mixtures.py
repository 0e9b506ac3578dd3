"""Registered queries: seen ids, budgets and mixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import id_hash
from ..operators import mixing, segment as seg
from ..operators.ordered import one_row, top_per_group
from .common_sql import FREQ, UNITS, hash60
from .corpus import word_freq, word_units
from .registry import documents, query, table
from .statistics import rounded

TARGETS = {"en": 0.6, "de": 0.1, "fr": 0.05}


def sized(spark, sf):
    return documents(spark, sf).select("shard", "doc_id", F.octet_length("text").cast("bigint").alias("size"))


def seen_ids(spark, sf):
    return mixing.build_seen_ids(table(spark, sf, "labels"), "doc_id")


_H = hash60("doc_id")


@query("B2_build_seen_ids", f"SELECT DISTINCT {_H} AS id_hash FROM labels")
def build_seen(spark, sf):
    return seen_ids(spark, sf)


@query("B3_drop_seen", "SELECT source AS shard, doc_id, strlen(text) AS size FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def drop_seen(spark, sf):
    return mixing.drop_seen(sized(spark, sf), seen_ids(spark, sf), "doc_id")


@query(
    "B3_retention",
    """SELECT source AS shard, count(*) AS rows_in, count(*) FILTER (l.doc_id IS NULL) AS rows_kept,
      coalesce(sum(strlen(text)) FILTER (l.doc_id IS NULL), 0)::BIGINT AS bytes_kept, round(count(*) FILTER (l.doc_id IS NULL) / count(*), 6) AS kept_ratio
    FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY ROLLUP (source)""",
)
def retention(spark, sf):
    return rounded(mixing.retention(sized(spark, sf), seen_ids(spark, sf), "doc_id", "shard", "size"), "kept_ratio")


@query(
    "B4_budget_by_file",
    """WITH k AS (SELECT source AS file, sum(strlen(text))::BIGINT AS bytes_kept FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1),
    c AS (SELECT *, sum(bytes_kept) OVER (ORDER BY file)::BIGINT AS cum FROM k)
    SELECT file, bytes_kept, cum FROM c WHERE cum - bytes_kept < 600000""",
)
def budget_by_file(spark, sf):
    kept = mixing.drop_seen(sized(spark, sf), seen_ids(spark, sf), "doc_id")
    files = kept.groupBy(F.col("shard").alias("file")).agg(F.sum("size").alias("bytes_kept"))
    return mixing.budget_by_file(files, 600000)


@query(
    "B5_budget_by_doc",
    """WITH c AS (SELECT source AS shard, doc_id, strlen(text) AS size, sum(strlen(text)) OVER (ORDER BY source, doc_id)::BIGINT AS cum FROM documents)
    SELECT * FROM c WHERE cum - size < 900000""",
)
def budget_by_doc(spark, sf):
    return mixing.budget_by_doc(sized(spark, sf), 900000)


@query(
    "B6_estimate_bytes",
    "SELECT count(*) AS rows, true AS plausible FROM documents",
)
def estimate_bytes(spark, sf):
    """Ledger seed from file sizes: the estimate must be positive and scale with the file."""
    from ..sources.text import estimated_text_bytes, source_inventory

    inv = source_inventory(spark, f"{sf}/documents.parquet").withColumn("estimate", estimated_text_bytes("file_bytes"))
    return inv.agg(F.sum("rows").alias("rows"), F.min((F.col("estimate") >= F.col("file_bytes"))).alias("plausible"))


@query(
    "B7_distinct_units",
    f"""WITH {UNITS} SELECT unit, shard, doc_id, pos FROM units QUALIFY row_number() OVER (PARTITION BY unit ORDER BY shard, doc_id, pos) = 1""",
)
def distinct_units(spark, sf):
    return mixing.distinct_units(word_units(spark, sf))


@query(
    "B8_split_train_val",
    f"""WITH {FREQ}, p AS (SELECT unit, row_number() OVER (ORDER BY {hash60("'17'", "unit")}, unit) AS place FROM freq)
    SELECT unit, CASE WHEN place <= greatest(1, floor((SELECT count(*) FROM freq) * 0.05)) THEN 'val' ELSE 'train' END AS split FROM p""",
)
def split_train_val(spark, sf):
    return mixing.split_train_val(word_freq(spark, sf).select("unit"), 0.05, 17)


def class_shards(spark, sf):
    """Language as class, source as shard."""
    docs = documents(spark, sf).select("lang", "shard", F.size(seg.unit_array("text", seg.WORD_PREV, 32)).cast("bigint").alias("n"))
    return docs.groupBy(F.col("lang").alias("klass"), F.col("shard").alias("source"), "shard").agg(F.sum("n").alias("n_units"))


_PICK = f"""s AS (SELECT lang AS klass, shard AS source, shard, count(*) AS n_units FROM units GROUP BY ALL),
    t AS (SELECT sum(n_units) / 0.6 AS total FROM s WHERE klass = 'en'),
    c AS (SELECT *, sum(n_units) OVER (PARTITION BY klass ORDER BY source, shard)::BIGINT AS cum FROM s WHERE klass IN ('en', 'de', 'fr')),
    picked AS (SELECT c.* FROM c, t WHERE klass = 'en' OR cum - n_units < CASE klass WHEN 'de' THEN 0.1 ELSE 0.05 END * total)"""


@query("B10_pick_shards", f"WITH {UNITS}, {_PICK} SELECT * FROM picked")
def pick_shards(spark, sf):
    return mixing.pick_shards(class_shards(spark, sf), TARGETS, "en")


@query(
    "B11_mix_report",
    f"""WITH {UNITS}, {_PICK} SELECT coalesce(klass, 'TOTAL') AS klass, count(*) AS shards, sum(n_units)::BIGINT AS n_units,
      round(sum(n_units) / (SELECT sum(n_units) FROM picked), 6) AS share FROM picked GROUP BY ROLLUP (klass)""",
)
def mix_report(spark, sf):
    return rounded(mixing.mix_report(mixing.pick_shards(class_shards(spark, sf), TARGETS, "en")), "share")


@query("B12_require_min", f"WITH {UNITS} SELECT count(*) AS total, 1000.0::DOUBLE AS threshold FROM units")
def require_min(spark, sf):
    return mixing.require_min(class_shards(spark, sf), "n_units", 1000)


@query(
    "B13_pool_peek",
    f"""WITH {UNITS} SELECT lang AS pool, row_number() OVER (PARTITION BY lang ORDER BY shard, doc_id, pos) AS place, unit FROM units QUALIFY place <= 3""",
)
def pool_peek(spark, sf):
    # a pool's first units lie among the first ones of its documents, so only those are expanded
    first = F.slice(seg.unit_array("text", seg.WORD_PREV, 32), 1, 3)
    units = seg.explode_units(documents(spark, sf), first, ["lang", "shard", "doc_id"])
    out = top_per_group(units, ["lang"], ["shard", "doc_id", "pos"], 3, "place")
    return out.select(F.col("lang").alias("pool"), "place", "unit")


@query(
    "B14_common_vocabulary",
    f"""WITH {UNITS} SELECT trim(unit) AS word FROM units WHERE lang = 'en' AND regexp_matches(trim(unit), '^[A-Za-z]')
    INTERSECT SELECT trim(unit) FROM units WHERE lang = 'de' AND regexp_matches(trim(unit), '^[A-Za-z]')""",
)
def common_vocabulary(spark, sf):
    freq = word_freq(spark, sf, ["lang"])
    return mixing.common_vocabulary(freq.filter("lang = 'en'"), freq.filter("lang = 'de'"))


@query(
    "B15_exclude_tasks",
    """WITH t AS (SELECT l_returnflag AS task, avg(l_quantity) AS score FROM lineitem GROUP BY 1)
    SELECT task, task <> 'R' AS valid, round(score, 6) AS score, round((SELECT avg(score) FROM t WHERE task <> 'R'), 6) AS mean_valid FROM t""",
)
def exclude_tasks(spark, sf):
    scores = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("task")).agg(F.avg("l_quantity").alias("score"))
    flagged = mixing.exclude_tasks(scores, ["R"])
    mean = flagged.filter("valid").agg(F.avg("score").alias("mean_valid"))
    return rounded(flagged.transform(one_row, mean), "score", "mean_valid")


@query(
    "A10_union_pools",
    f"""WITH {UNITS}, p AS (SELECT shard, list_position(['en', 'de', 'fr', 'es'], lang) - 1 AS pool FROM units)
    SELECT pool::BIGINT AS pool, shard, dense_rank() OVER (ORDER BY pool, shard) - 1 AS new_shard, count(*) AS n_units FROM p GROUP BY pool, shard""",
)
def union_pools(spark, sf):
    shards = class_shards(spark, sf)
    pools = [shards.filter(F.col("klass") == k).select("shard", "n_units") for k in ("en", "de", "fr", "es")]
    return mixing.union_pools(*pools).select("pool", "shard", "new_shard", "n_units")
