"""Registered queries: sources, unit stores and segmentation."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from ..functions import CORE, RUNS, WORD_NEXT, WORD_PREV, chop_bytes, chunk_chars
from ..operators import segment as seg, stats
from ..session import checkpoint_dir
from ..sources import incremental, logs, positional_store, reports, text as text_source, unit_store, zstd_lines
from .common_sql import FREQ, RAW, UNITS, hash60
from .registry import documents, query, spread, table

SEP = chr(31)


def scratch(spark) -> str:
    """A fresh folder in the session's shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/unitloom-{uuid.uuid4().hex}"


_stores: dict[tuple, str] = {}


def positional_units(spark, sf) -> str:
    """The folder of the corpus' positional store, which is built once a session and again if the documents' files change."""
    files = spark.read.parquet(f"{sf}/documents.parquet").agg(F.count(F.lit(1)), F.max("_metadata.file_modification_time")).first()
    key = (spark.sparkContext.applicationId, sf, *files)
    if key not in _stores:
        path = scratch(spark)
        positional_store.write_positional(documents(spark, sf), path)
        _stores[key] = path
    return _stores[key]


def word_units(spark, sf):
    return seg.segment_word(documents(spark, sf))


def word_freq(spark, sf, by=()):
    docs = documents(spark, sf)
    return stats.count_doc_units(docs, seg.unit_array("text", WORD_PREV, 32), by)


# --- C: segmentation -------------------------------------------------------------


@query("C1_segment_word", f"WITH {UNITS} SELECT shard, doc_id, pos, unit, strlen(unit) AS n_bytes, pos = 0 AS doc_start FROM units")
def segment_word(spark, sf):
    return word_units(spark, sf)


def _stream(docs, pattern):
    """Per document: unit count and fingerprint of the unit stream."""
    units = seg.unit_array("text", pattern, None)
    return docs.select("doc_id", F.size(units).cast("bigint").alias("n_units"), F.md5(F.array_join(units, SEP)).alias("stream"))


@query(
    "C2_segment_word_next",
    rf"""WITH {RAW}, nu AS (
      SELECT doc_id, i, CASE WHEN is_l AND prv = ' ' THEN ' ' || u ELSE u END AS unit FROM cls
      WHERE NOT (u = ' ' AND coalesce(next_l, false)))
    SELECT doc_id, count(*) AS n_units, md5(string_agg(unit, chr(31) ORDER BY i)) AS stream FROM nu GROUP BY doc_id""",
)
def segment_word_next(spark, sf):
    return _stream(documents(spark, sf), WORD_NEXT)


@query(
    "C4_segment_runs",
    r"""SELECT doc_id, len(r) AS n_units, md5(array_to_string(r, chr(31))) AS stream FROM (
      SELECT doc_id, regexp_extract_all(text, '[\x09-\x0D ]+|[0-9A-Za-z\x{80}-\x{10FFFF}]+|[\x00-\x08\x0E-\x1F!-/:-@\[-`{-\x7F]+') AS r
      FROM documents)""",
)
def segment_runs(spark, sf):
    return _stream(documents(spark, sf), RUNS)


@query(
    "C5_segment_core",
    r"""SELECT doc_id, len(r) AS n_units, md5(array_to_string(r, chr(31))) AS stream FROM (
      SELECT doc_id, regexp_extract_all(text, '(?:[0-9A-Za-z]+(?:''[0-9A-Za-z]{1,2})?|[\p{L}\p{M}\p{Nd}\p{Nl}_\p{Pc}])[^\p{L}\p{M}\p{Nd}\p{Nl}_\p{Pc}]*|[^\p{L}\p{M}\p{Nd}\p{Nl}_\p{Pc}]+') AS r
      FROM documents)""",
)
def segment_core(spark, sf):
    return _stream(documents(spark, sf), CORE)


@query(
    "C6_chunk_chars",
    rf"""WITH {FREQ}, long AS (SELECT unit FROM freq WHERE strlen(unit) > 5),
    folded AS (SELECT unit, list_reduce(list_transform(range(1, length(unit) + 1), lambda i: substring(unit, i, 1)),
        lambda acc, x: CASE WHEN strlen(split_part(acc, chr(31), -1)) + strlen(x) > 5 THEN acc || chr(31) || x ELSE acc || x END) AS f FROM long)
    SELECT unit, f AS chunks, len(string_split(f, chr(31))) AS n_chunks FROM folded""",
)
def chunk_units(spark, sf):
    long = word_freq(spark, sf).filter("octet_length(unit) > 5").select("unit", chunk_chars("unit", 5).alias("c"))
    return long.select("unit", F.array_join("c", SEP).alias("chunks"), F.size("c").cast("bigint").alias("n_chunks"))


@query(
    "C7_chop_bytes",
    rf"""WITH {FREQ} SELECT unit, list_aggregate(list_transform(range(0, strlen(unit), 3),
        lambda i: substring(hex(encode(unit)), 2 * i + 1, 6)), 'string_agg', ' ') AS pieces FROM freq WHERE strlen(unit) > 3""",
)
def chop(spark, sf):
    long = word_freq(spark, sf).filter("octet_length(unit) > 3")
    pieces = F.transform(chop_bytes(F.encode("unit", "UTF-8"), 3), lambda b: F.hex(b))
    return long.select("unit", F.array_join(pieces, " ").alias("pieces"))


@query(
    "C8_combine_boundaries",
    rf"""WITH {UNITS}, a AS (
      SELECT shard, doc_id, sum(strlen(unit)) OVER (PARTITION BY doc_id ORDER BY pos) - strlen(unit) AS g FROM units),
    rr AS (SELECT source AS shard, doc_id, unnest(r) AS u, generate_subscripts(r, 1) AS i FROM (
      SELECT *, regexp_extract_all(text, '[\x09-\x0D ]+|[0-9A-Za-z\x{{80}}-\x{{10FFFF}}]+|[\x00-\x08\x0E-\x1F!-/:-@\[-`{{-\x7F]+') AS r FROM documents)),
    b AS (SELECT shard, doc_id, sum(strlen(u)) OVER (PARTITION BY doc_id ORDER BY i) - strlen(u) AS g FROM rr),
    m AS (SELECT coalesce(a.shard, b.shard) AS shard, coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.g, b.g)::BIGINT AS g,
      a.g IS NOT NULL AND b.g IS NOT NULL AS shared
      FROM (SELECT * FROM a WHERE g > 0) a FULL OUTER JOIN (SELECT * FROM b WHERE g > 0) b ON a.doc_id = b.doc_id AND a.g = b.g),
    k AS (SELECT doc_id, g FROM m WHERE shared OR {hash60("'7'", "shard", "doc_id", "g")} < 576460752303423488),
    ends AS (SELECT doc_id, g FROM k UNION ALL SELECT doc_id, 0 FROM documents),
    seg AS (SELECT e.doc_id, g, coalesce(lead(g) OVER (PARTITION BY e.doc_id ORDER BY g), strlen(d.text)) - g AS size
      FROM ends e JOIN documents d USING (doc_id))
    SELECT doc_id, sum((size + 31) // 32)::BIGINT AS n_units, sum(size)::BIGINT AS n_bytes, max(least(size, 32))::BIGINT AS longest FROM (
      SELECT doc_id, g, size FROM seg) GROUP BY doc_id""",
)
def combine_boundaries(spark, sf):
    units = seg.combine_boundaries(documents(spark, sf), WORD_PREV, RUNS, 0.5, 7, 32)
    return units.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_units"), F.sum("n_bytes").alias("n_bytes"), F.max("n_bytes").alias("longest")
    )


@query(
    "C9_byte_offsets",
    rf"""WITH {UNITS}, o AS (SELECT doc_id, pos, sum(strlen(unit)) OVER (PARTITION BY doc_id ORDER BY pos) - strlen(unit) AS g FROM units)
    SELECT doc_id, count(*) AS n_units, sum(g)::BIGINT AS sum_off, max(g)::BIGINT AS last_off,
      sum(g * (pos % 7))::BIGINT AS mixed FROM o GROUP BY doc_id""",
)
def byte_offsets(spark, sf):
    out = seg.byte_offsets(documents(spark, sf))
    return out.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_units"),
        F.sum("byte_off").alias("sum_off"),
        F.max("byte_off").alias("last_off"),
        F.sum(F.col("byte_off") * (F.col("pos") % 7)).alias("mixed"),
    )


@query(
    "C21_check_roundtrip",
    f"""WITH {UNITS}, j AS (SELECT doc_id, string_agg(unit, '' ORDER BY pos) AS t FROM units GROUP BY doc_id)
    SELECT count(*) AS n_docs, sum(strlen(d.text))::BIGINT AS text_bytes, sum(strlen(j.t))::BIGINT AS unit_bytes,
      sum((j.t <> d.text)::INT)::BIGINT AS mismatches FROM documents d JOIN j USING (doc_id)""",
)
def check_roundtrip(spark, sf):
    return seg.roundtrip(documents(spark, sf))


# --- A: sources and sinks --------------------------------------------------------


_TEXT_SUMMARY = "count(*) AS n_docs, sum(strlen(text))::BIGINT AS n_bytes, min(md5(text)) AS first_hash, max(md5(text)) AS last_hash"


def _text_summary(df):
    return df.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(F.octet_length("text").cast("bigint")).alias("n_bytes"),
        F.min(F.md5("text")).alias("first_hash"),
        F.max(F.md5("text")).alias("last_hash"),
    )


@query("A1_read_text", f"SELECT {_TEXT_SUMMARY} FROM documents")
def read_text(spark, sf):
    return _text_summary(text_source.read_text(spark, f"{sf}/documents.parquet"))


@query("A1_read_text_cap", f"SELECT {_TEXT_SUMMARY} FROM (SELECT text FROM documents ORDER BY doc_id LIMIT 100)")
def read_text_cap(spark, sf):
    return _text_summary(text_source.read_text(spark, f"{sf}/documents.parquet", cap_per_file=100))


@query("A2_read_jsonl", f"SELECT {_TEXT_SUMMARY} FROM documents WHERE text <> ''")
def read_jsonl(spark, sf):
    docs, path = documents(spark, sf), scratch(spark)
    half = F.pmod(F.col("doc_id"), F.lit(2)) == 0
    docs.select(
        F.when(half, F.col("text")).alias("text"), F.when(~half, F.col("text")).alias("content")
    ).write.option("compression", "gzip").json(path)
    return _text_summary(text_source.read_jsonl_text(spark, path))


@query("A2_read_jsonl_zstd", f"SELECT {_TEXT_SUMMARY} FROM documents WHERE text <> ''")
def read_jsonl_zstd(spark, sf):
    """Several frames a file and several partitions a file, whose borders fall into lines."""
    path = scratch(spark) + ".zst"
    zstd_lines.register(spark)
    rows = documents(spark, sf).select(F.to_json(F.struct("doc_id", "text")).alias("value"))
    rows.write.format(zstd_lines.FORMAT).mode("append").option("frameBytes", 1 << 16).save(path)
    return _text_summary(text_source.read_jsonl_text(spark, path, split_bytes=1 << 17))


@query("A3_normalize_text_column", f"SELECT {_TEXT_SUMMARY} FROM (SELECT html AS text FROM pages)")
def normalize_text(spark, sf):
    pages = table(spark, sf, "pages").withColumnRenamed("html", "content")
    return _text_summary(text_source.normalize_text_column(pages))


@query("A4_source_inventory", "SELECT 'documents.parquet' AS file, count(*) AS rows FROM documents UNION ALL SELECT 'lineitem.parquet', count(*) FROM lineitem UNION ALL SELECT 'events.parquet', count(*) FROM events")
def source_inventory(spark, sf):
    parts = [text_source.source_inventory(spark, f"{sf}/{n}.parquet") for n in ("documents", "lineitem", "events")]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select(F.regexp_extract("file", r"([^/]+)$", 1).alias("file"), "rows")


def _stored_units(spark, sf):
    path = scratch(spark)
    unit_store.store_documents(documents(spark, sf), path)
    return path


@query(
    "A5_write_read_units",
    f"""WITH {UNITS} SELECT doc_id, count(*) AS n_units, md5(string_agg(unit, chr(31) ORDER BY pos)) AS stream FROM units GROUP BY doc_id""",
)
def write_read_units(spark, sf):
    units = unit_store.read_units(spark, _stored_units(spark, sf))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "unit")))
    return units.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_units"),
        F.md5(F.array_join(F.transform(ordered, lambda x: x["unit"]), SEP)).alias("stream"),
    )


_META = """count(*) AS n_units, sum(strlen(unit))::BIGINT AS n_bytes, sum((pos = 0)::INT)::BIGINT AS n_docs,
    max(strlen(unit))::BIGINT AS max_unit_bytes, 'word-prev' AS segmenter, 0::BIGINT AS baked_seed"""


@query("A6_read_units_only", f"WITH {UNITS} SELECT shard, {_META} FROM units WHERE shard IN ('src1', 'src10') GROUP BY shard")
def read_units_only(spark, sf):
    return unit_store.shard_meta(unit_store.read_units(spark, _stored_units(spark, sf), only=["src1", "src10"]))


@query("A7_shard_meta", f"WITH {UNITS} SELECT shard, {_META} FROM units GROUP BY shard")
def shard_meta(spark, sf):
    return unit_store.shard_meta(word_units(spark, sf))


@query(
    "A9_build_incremental",
    f"""WITH {UNITS} SELECT doc_id % 2 AS part, count(*) AS n_units, count(DISTINCT doc_id) AS n_docs, sum(strlen(unit))::BIGINT AS n_bytes FROM units GROUP BY 1""",
)
def build_incremental(spark, sf):
    """Two deliveries, each built once; a third run finds nothing to do.

    The first has two folders with equal file names, the second lies deeper.
    """
    src, dst = scratch(spark), scratch(spark)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    side = F.when(F.pmod("doc_id", F.lit(4)) == 0, "a").otherwise("b")
    docs.filter("doc_id % 2 = 0").withColumn("side", side).write.partitionBy("side").parquet(f"{src}/early")
    incremental.build_incremental(spark, src, dst)
    docs.filter("doc_id % 2 = 1").write.parquet(f"{src}/late/deeper")
    incremental.build_incremental(spark, src, dst)
    if incremental.build_incremental(spark, src, dst):
        raise RuntimeError("a finished build was repeated")
    units = spark.read.parquet(f"{dst}/units")
    return units.groupBy(F.pmod("doc_id", F.lit(2)).cast("bigint").alias("part")).agg(
        F.count(F.lit(1)).alias("n_units"),
        F.sum(F.col("doc_start").cast("bigint")).alias("n_docs"),
        F.sum("n_bytes").alias("n_bytes"),
    )


@query(
    "A11_read_run_log",
    """SELECT user_id AS run, count(*) AS n, sum(value) AS total, max(event_id) AS last_step FROM events WHERE event_type <> 'error' GROUP BY user_id""",
)
def read_run_log(spark, sf):
    """Events written as a noisy JSON log: prefixes, broken lines and blank lines are skipped."""
    events, path = table(spark, sf, "events"), scratch(spark)
    record = F.to_json(F.struct("user_id", F.col("event_id").alias("step"), F.col("value").alias("loss")))
    line = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("{broken "), record))
        .when(F.col("event_type") == "view", F.concat(F.lit("[rank0] "), record))
        .otherwise(record)
    )
    noisy = F.explode(F.array(line, F.lit("")))
    events.select(noisy.alias("value")).write.text(path)
    lines = logs.read_lines(spark, path)
    log = logs.read_run_log(lines, "user_id BIGINT, step BIGINT, loss DOUBLE")
    return log.groupBy(F.col("user_id").alias("run")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("loss").alias("total"), F.max("step").alias("last_step")
    )


#: Metric name, event type that stands for it, its text in our log.
_METRICS = (
    ("nll", "click", "eval nll="),
    ("top5", "view", "eval recall@5="),
    ("nmi", "error", "eval cluster/type agreement="),
    ("em", "purchase", "eval exact="),
    ("bpb", "signup", "eval bits/byte="),
)


@query(
    "A12_extract_metrics",
    """WITH m AS (SELECT user_id AS file, CASE event_type WHEN 'click' THEN 'nll' WHEN 'view' THEN 'top5' WHEN 'error' THEN 'nmi' WHEN 'purchase' THEN 'em' WHEN 'signup' THEN 'bpb' END AS metric,
      event_id AS line_no, value FROM events)
    SELECT file, metric, arg_min(value, line_no) AS value FROM m WHERE metric IS NOT NULL GROUP BY file, metric""",
)
def extract_metrics(spark, sf):
    events = table(spark, sf, "events")
    head = F.coalesce(*(F.when(F.col("event_type") == kind, F.lit(text)) for _, kind, text in _METRICS), F.lit("step "))
    line = F.concat(F.lit("12:00 | "), head, F.col("value").cast("string"))
    lines = events.select(F.col("user_id").alias("file"), F.col("event_id").alias("line_no"), line.alias("line"))
    return logs.extract_metrics(lines, {name: re.escape(text) + r"(-?[0-9.]+(?:E-?[0-9]+)?)" for name, _, text in _METRICS})


def section_lines(spark, sf):
    """Conversations as a generation log: a prompt header, then a readout per turn."""
    conv = table(spark, sf, "conversations")
    conv = conv.join(conv.groupBy("conv_id").agg(F.min("turn").alias("first_turn")), "conv_id")
    number = F.col("conv_id").cast("string")
    title = F.concat(F.lit("==================== prompt "), number, F.lit(": t"), number, F.lit(" =========="))
    name = F.concat(F.lit("--- "), F.col("role"), F.lit("-"), F.col("turn").cast("string"), F.lit(" ---"))
    head = F.when(F.col("turn") == F.col("first_turn"), F.array(title)).otherwise(F.array().cast("array<string>"))
    body = F.concat(head, F.array(name, F.lit("[snap] marker"), F.lit("")), F.split("text", "\n"))
    file = F.concat(F.lit("log"), F.pmod("conv_id", F.lit(3)).cast("string"))
    return conv.select(file.alias("file"), "conv_id", "turn", F.posexplode(body).alias("k", "line"))


_SECTIONS = r"""sections AS (SELECT 'log' || (conv_id % 3) AS file, conv_id AS prompt_id, 't' || conv_id AS title, role || '-' || turn AS readout,
      trim(array_to_string(list_filter(string_split(text, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(10) || chr(13)) <> '' AND NOT regexp_matches(l, '^\s*\[')), chr(10))) AS text
      FROM conversations)"""


@query("A13_parse_sections", f"WITH {_SECTIONS} SELECT * FROM sections WHERE text <> ''")
def parse_sections(spark, sf):
    return logs.parse_sections(section_lines(spark, sf), "file", ("conv_id", "turn", "k")).filter("text <> ''")


@query(
    "A14_write_report",
    f"""WITH {UNITS} SELECT '| ' || shard || ' | ' || count(*) || ' | ' || sum(strlen(unit)) || ' |' AS value FROM units GROUP BY shard""",
)
def write_report(spark, sf):
    meta = unit_store.shard_meta(word_units(spark, sf)).select("shard", "n_units", "n_bytes")
    path = scratch(spark)
    reports.write_report(meta, path)
    return spark.read.text(f"{path}/markdown/body")
