"""Resumable builds: a ledger of finished files decides what is still to do."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from ..operators.segment import segment_word
from ..session import durable
from .unit_store import checked_units

LEDGER = "file STRING, size BIGINT, changed TIMESTAMP, rows BIGINT, text_bytes BIGINT"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def read_ledger(spark: SparkSession, dst: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(f"{dst}/ledger")
    except AnalysisException:
        return spark.createDataFrame([], LEDGER)


def _relative_path(src: str):
    """A file's path below ``src``, or its whole path where ``src`` was written in another way."""
    path = F.regexp_replace(F.try_url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), _SCHEME, "")
    root = re.sub(_SCHEME, "", src).rstrip("/") + "/"
    return F.when(path.startswith(root), F.substring(path, len(root) + 1, F.length(path))).otherwise(path)


def _drop_emptied(finished: DataFrame, dst: str) -> None:
    """Remove the partitions of built files that have no text: no rows of theirs replace what a former state of the file left."""
    spark = finished.sparkSession
    empty = finished.filter(F.coalesce("text_bytes", F.lit(0)) == 0).select(F.md5(F.col("file").cast("binary")).alias("shard"))
    for r in empty.toLocalIterator():  # names of files, as many as were built
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{dst}/units/shard={r['shard']}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def build_incremental(spark: SparkSession, src: str, dst: str, l_max: int = 32) -> int:
    """Segment every source file not yet in the ledger; returns how many were built.

    Files are known by their path below ``src``, nested folders included, with size and
    modification time, so equal names in two folders are two files and a changed file is built
    again.  Units go to a partition named after the path's digest and replace it as a
    whole, so a partition left half-written by a lost job is rebuilt; that of a file without any text left is
    removed.  The ledger row is written last.  A source that has gone away is fine when nothing is left to do.
    """
    done = read_ledger(spark, dst)
    try:
        source = spark.read.option("recursiveFileLookup", "true").parquet(src)
    except AnalysisException:
        if done.isEmpty():
            raise
        return 0
    docs = source.select(
        _relative_path(src).alias("file"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_modification_time").alias("changed"),
        "doc_id",
        "text",
    )
    todo = docs.join(done.select("file", "size", "changed"), ["file", "size", "changed"], "left_anti")
    summary = todo.groupBy("file", "size", "changed").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text").cast("bigint")).alias("text_bytes")
    )
    finished = durable(summary)
    built = finished.count()
    if built:
        named = todo.filter("text <> ''").select(F.md5(F.col("file").cast("binary")).alias("shard"), "doc_id", "text")
        (
            checked_units(segment_word(named, l_max=l_max), l_max)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("shard")
            .parquet(f"{dst}/units")
        )
        _drop_emptied(finished, dst)
        finished.write.mode("append").parquet(f"{dst}/ledger")

    return built
