"""Text sources, all reduced to one ``text`` column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import zstd_lines

# The column names a text table may use, in order of preference.
TEXT_COLUMNS = ("text", "content", "whole_func_string", "func_code_string")


def read_text(spark: SparkSession, path, cap_per_file: int = 0) -> DataFrame:
    """The ``text`` column of parquet files, optionally the first rows of each file only."""
    rows = spark.read.parquet(*([path] if isinstance(path, str) else path))
    if not cap_per_file:
        return rows.select("text")
    return rows.filter(F.col("_metadata.row_index") < cap_per_file).select("text")


def read_jsonl_text(spark: SparkSession, path: str, fields: Sequence[str] = ("text", "content"), split_bytes: int = 64 << 20) -> DataFrame:
    """JSON lines (plain, gzip, bzip2 or Zstandard): first non-empty field wins, blank and empty rows drop out.

    Only the named fields are read from a line.  Bytes that aren't UTF-8 become U+FFFD.  A path that ends in ``.zst`` or ``.zstd`` (a
    file, or a folder named so of such files) is read by the ``zstdlines`` source in ranges of ``split_bytes``.
    """
    schema = ", ".join(f"{f} STRING" for f in fields)
    if path.rstrip("/").endswith(zstd_lines.ENDINGS):
        zstd_lines.register(spark)
        lines = spark.read.format(zstd_lines.FORMAT).option("splitBytes", split_bytes).load(path)
        rows = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    else:
        rows = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    first = F.coalesce(*[F.nullif(F.col(f), F.lit("")) for f in fields])
    return rows.select(F.make_valid_utf8(first).alias("text")).filter("text IS NOT NULL")


def normalize_text_column(df: DataFrame, candidates: Sequence[str] = TEXT_COLUMNS, keep: Sequence[str] = ()) -> DataFrame:
    """Rename the first existing candidate to ``text``; fail when there is none."""
    for name in candidates:
        if name in df.columns:
            return df.select(*keep, F.col(name).alias("text"))
    raise ValueError(f"no text column among {list(candidates)} in {df.columns}")


def source_inventory(spark: SparkSession, path) -> DataFrame:
    """Rows and size of every file."""
    paths = [path] if isinstance(path, str) else list(path)
    return (
        spark.read.parquet(*paths)
        .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
        .groupBy("file")
        .agg(F.count(F.lit(1)).alias("rows"), F.max("size").alias("file_bytes"))
    )


def estimated_text_bytes(file_bytes, ratio: float = 1.54):
    """Text bytes expected from a compressed file of the given size."""
    col = F.col(file_bytes) if isinstance(file_bytes, str) else file_bytes
    return (col * F.lit(ratio)).cast("bigint")
