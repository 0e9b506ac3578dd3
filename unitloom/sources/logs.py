"""Text logs: run records, metric lines and prompt/readout sections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ordered import prefix_scan

RUN_SCHEMA = "step BIGINT, loss DOUBLE, gn DOUBLE, lr DOUBLE, skips BIGINT, sec DOUBLE, event STRING"

# Section headers of a generation log.
PROMPT_HEADER = r"^==================== prompt (\d+): (.*?) =========="
READOUT_HEADER = r"^--- (.+?) ---$"
MARKER_LINES = r"^\s*\["


def read_lines(spark: SparkSession, path) -> DataFrame:
    """Lines with an order key that holds inside each file however it is split."""
    rows = spark.read.text([path] if isinstance(path, str) else list(path))
    return rows.select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
        ).alias("line_no"),
        F.col("value").alias("line"),
    )


def read_run_log(lines: DataFrame, schema: str = RUN_SCHEMA, required: str = "loss", line: str = "line") -> DataFrame:
    """JSON records from log lines; text before the first brace, blank and broken lines are ignored."""
    body = F.regexp_replace(F.col(line), r"^[^{]*", "")
    kept = [c for c in lines.columns if c != line]
    parsed = lines.select(*kept, F.from_json(body, schema).alias("r"))
    return parsed.filter(F.col(f"r.{required}").isNotNull()).select(*kept, "r.*")


def extract_metrics(
    lines: DataFrame, patterns: Mapping[str, str], file: str = "file", line_no: str = "line_no", line: str = "line"
) -> DataFrame:
    """First match of every named pattern per log file, one row per (file, metric)."""
    found = F.array(
        *[
            F.struct(F.lit(name).alias("metric"), F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")).alias("value"))
            for name, pattern in patterns.items()
        ]
    )
    hits = lines.select(file, line_no, F.explode(F.filter(found, lambda m: m["value"].isNotNull())).alias("m"))
    return hits.groupBy(file, F.col("m.metric").alias("metric")).agg(
        F.min_by(F.col("m.value").cast("double"), F.col(line_no)).alias("value")
    )


def label_sections(lines: DataFrame, file: str = "file", line_no: Sequence[str] = ("line_no",)) -> DataFrame:
    """Every line with the prompt and readout header it falls under.

    The state machine of a line-by-line reader becomes two fill-forwards: a prompt
    header clears the readout, a readout header sets it.
    """
    prompt = F.regexp_extract("line", PROMPT_HEADER, 1)
    readout = F.regexp_extract("line", READOUT_HEADER, 1)
    marked = lines.withColumn(
        "_prompt", F.when(prompt != "", F.struct(prompt.cast("bigint").alias("id"), F.regexp_extract("line", PROMPT_HEADER, 2).alias("title")))
    ).withColumn("_readout", F.when(prompt != "", F.lit("")).when(readout != "", F.trim(readout)))
    filled = prefix_scan(
        marked, [file], list(line_no), {"prompt": ("last", F.col("_prompt")), "readout": ("last", F.col("_readout"))}
    )
    body = F.col("_prompt").isNull() & F.col("_readout").isNull() & F.col("prompt").isNotNull() & (F.col("readout") != "")
    return filled.filter(body).select(
        file, *line_no, F.col("prompt.id").alias("prompt_id"), F.col("prompt.title").alias("title"), "readout", "line"
    )


def parse_sections(lines: DataFrame, file: str = "file", line_no: Sequence[str] = ("line_no",)) -> DataFrame:
    """One row per (file, prompt, readout) with its text; blank and marker lines are dropped."""
    body = label_sections(lines, file, line_no).filter(
        (F.btrim("line") != "") & ~F.col("line").rlike(MARKER_LINES)
    )
    ordered = F.sort_array(F.collect_list(F.struct(*line_no, "line")))
    return body.groupBy(file, "prompt_id", "title", "readout").agg(
        F.btrim(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")).alias("text")
    )
