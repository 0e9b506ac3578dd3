"""Unit and token stores: parquet partitioned by shard, sorted by document and position."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.segment import segment_word

#: Text of a range about, so that a task's rows stay small however large the table is.
RANGE_BYTES = 32 << 20


def text_ranges(docs: DataFrame, range_bytes: int) -> int:
    """Ranges of about ``range_bytes`` of text each, as many as the session shuffles to at least."""
    text_bytes = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes // range_bytes))


def checked_units(units: DataFrame, l_max: int) -> DataFrame:
    """Fail the job on a unit outside 1..l_max bytes."""
    bad = F.raise_error(F.concat(F.lit("unit length out of range: "), F.col("n_bytes").cast("string")))
    ok = (F.col("n_bytes") >= 1) & (F.col("n_bytes") <= l_max)
    return units.withColumn("n_bytes", F.when(ok, F.col("n_bytes")).otherwise(bad.cast("bigint")))


def write_units(units: DataFrame, path: str, l_max: int = 32, mode: str = "overwrite") -> None:
    """Write units shard by shard.

    Rows are range-arranged by (shard, document, position): a big shard spreads over
    many files, a small shard stays in one, and row-group statistics allow skipping.
    """
    keys = ["shard", "doc_id", "pos"]
    (
        checked_units(units, l_max)
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("shard")
        .parquet(path)
    )


def store_documents(docs: DataFrame, path: str, merge: str = "prev", l_max: int = 32, mode: str = "overwrite") -> None:
    """Segment (shard, doc_id, text) straight into a unit store.

    The documents are range-arranged before they are split: the text is moved once
    instead of its many unit rows, and sampling the key range does not run the splitter.
    There are more ranges for more text, so that the units a task sorts don't grow with the table.
    """
    arranged = docs.select("shard", "doc_id", "text")
    arranged = arranged.repartitionByRange(text_ranges(arranged, RANGE_BYTES), "shard", "doc_id")
    _write_shards(checked_units(segment_word(arranged, merge, l_max), l_max), path, mode)


def read_units(spark: SparkSession, path: str, only=None) -> DataFrame:
    """Open all shards or the named ones; an empty selection is an error."""
    units = spark.read.option("basePath", path).parquet(path).withColumn("shard", F.col("shard").cast("string"))
    if only is not None:
        units = units.filter(F.col("shard").isin(list(only)))
    if units.isEmpty():
        raise FileNotFoundError(f"no shards under {path}")
    return units


def shard_meta(units: DataFrame, segmenter: str = "word-prev", seed: int = 0) -> DataFrame:
    """Per shard: units, bytes, documents, longest unit and how it was built."""
    return units.groupBy("shard").agg(
        F.count(F.lit(1)).alias("n_units"),
        F.sum("n_bytes").alias("n_bytes"),
        F.sum(F.col("doc_start").cast("bigint")).alias("n_docs"),
        F.max("n_bytes").alias("max_unit_bytes"),
        F.lit(segmenter).alias("segmenter"),
        F.lit(seed).cast("bigint").alias("baked_seed"),
    )


def write_tokens(tokens: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Token ids per document (EOS rows included), arranged like the unit store."""
    _write_shards(tokens.repartitionByRange("shard", "doc_id", "pos"), path, mode)


def _write_shards(rows: DataFrame, path: str, mode: str) -> None:
    """Rows that are in ranges of (shard, document, position) already, in order and by shard."""
    (
        rows.sortWithinPartitions("shard", "doc_id", "pos")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("shard")
        .parquet(path)
    )


def store_tokens(docs: DataFrame, path: str, encode: Callable[[DataFrame], DataFrame], mode: str = "overwrite") -> None:
    """Encode (shard, doc_id, text) with ``encode``, which makes token rows of documents, straight into a token store.

    As in ``store_documents`` the documents are arranged before they are split, by ranges of about ``RANGE_BYTES`` of text.
    """
    arranged = docs.select("shard", "doc_id", "text")
    arranged = arranged.repartitionByRange(text_ranges(arranged, RANGE_BYTES), "shard", "doc_id")
    _write_shards(encode(arranged), path, mode)


def read_tokens(spark: SparkSession, path: str, only=None) -> DataFrame:
    return read_units(spark, path, only)


def token_meta(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("shard").agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.sum(F.col("doc_start").cast("bigint")).alias("n_docs"),
        F.max("token_id").alias("max_id"),
    )
