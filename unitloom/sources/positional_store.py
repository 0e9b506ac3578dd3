"""A unit store that keeps positions: every row has its place ``seq`` in its shard and its byte offset there.

Layout of a store folder: ``units``, files in the order of (shard, seq) with small row groups, so that a range of units is found by the
files' statistics; ``index``, every ``EVERY``-th unit of a shard with its byte offset; ``shards``, units and bytes of each shard.

Building it splits each text once.  Documents are range-arranged before they are split; their texts and units' lengths are written with the units and
bytes ahead of them in their range.  The sums of each range then give every range its first position, and a second pass turns each document into
rows where it is read, with no further exchange.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.ordered import join_checked, one_row
from ..operators.segment import PATTERNS, unit_array
from ..session import ship
from .unit_store import text_ranges

EVERY = 4_096
ROW_GROUP_BYTES, PAGE_ROWS = 4 << 20, 20_000
#: Text of a range about, so that a task's rows stay small however large the table is.
RANGE_BYTES = 32 << 20
#: Documents whose rows are made at a time.
TOGETHER = 256
#: What is written of a split document: ``u0`` and ``b0`` are the units and bytes ahead of it in its range and shard.
SPLIT = "part int, shard string, doc_id long, text string, sizes array<int>, n_units long, n_bytes long, u0 long, b0 long"
CODEC = "zstd"
UNITS = "shard string, seq long, doc_id long, pos long, unit string, n_bytes long, byte_off long, doc_start boolean"


def write_positional(docs: DataFrame, path: str, merge: str = "prev", l_max: int = 32) -> None:
    """Segment (shard, doc_id, text) into a new store at ``path``.

    Stream order is (shard, doc_id); doc_id must be unique in its shard.  Null and empty texts have no units, a null shard is a shard like
    any other, and an empty table gives an empty store.
    """
    spark = docs.sparkSession
    ship(spark)
    # Arranged before they are split, so that sampling the key range does not run the splitter.
    arranged = docs.select(F.col("shard").cast("string").alias("shard"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    # As many ranges as the session shuffles to at least: the work is the splitting, not the bytes by which ranges would be joined again.
    ranges = text_ranges(arranged, RANGE_BYTES)
    arranged = arranged.repartitionByRange(ranges, "shard", "doc_id").sortWithinPartitions("shard", "doc_id")
    units = F.coalesce(unit_array("text", PATTERNS[merge], l_max), F.array().cast("array<string>"))
    # The splitter runs in the generator alone (one array per row); a plain column would be evaluated once per use.
    split = arranged.select(F.spark_partition_id().alias("part"), "shard", "doc_id", F.explode(F.array(units)).alias("units"))
    staged = f"{path}/_split-{uuid.uuid4().hex}"
    # A text and its units' lengths: an array of short strings takes several times the room in every exchange and sort.
    text, sizes = F.array_join("units", "").alias("text"), F.transform("units", lambda u: F.octet_length(u)).alias("sizes")
    split = split.select("part", "shard", "doc_id", text, sizes, F.size("units").cast("long").alias("n_units")).mapInArrow(_summed, SPLIT)
    split.write.option("compression", CODEC).parquet(staged)
    split = spark.read.parquet(staged)

    # Shards of every range: no more rows than ranges and shards together.
    sums = split.groupBy("part", "shard").agg(F.sum("n_units").alias("u"), F.sum("n_bytes").alias("b"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = sums.select("part", "shard", F.coalesce(F.sum("u").over(before), F.lit(0)).alias("u"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b"))
    starts = spark.sparkContext.broadcast({(r["part"], r["shard"]): (r["u"], r["b"]) for r in first.collect()})

    rows = split.select("part", "shard", "doc_id", "text", "sizes", "u0", "b0").mapInArrow(_rows(starts), UNITS)
    # Version 2 writes places and offsets, which grow, as differences, if it is not made to look for a dictionary of them first.
    writer = rows.write.option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.row.count.limit", PAGE_ROWS)
    for column in ("seq", "doc_id", "pos", "byte_off"):
        writer = writer.option(f"parquet.enable.dictionary#{column}", "false")
    writer.option("parquet.writer.version", "v2").option("compression", CODEC).parquet(f"{path}/units")
    stored = spark.read.parquet(f"{path}/units")
    stored.filter(F.col("seq") % EVERY == 0).select("shard", "seq", "doc_id", "byte_off").write.parquet(f"{path}/index")
    totals = sums.groupBy("shard").agg(F.sum("u").alias("shard_units"), F.sum("b").alias("shard_bytes"))
    totals.write.parquet(f"{path}/shards")


def _cut(text: pa.Array, sizes: np.ndarray) -> pa.Array:
    """The pieces of these byte lengths of all texts one after the other."""
    text = text.cast(pa.string())
    _, offsets, data = text.buffers()
    first = np.frombuffer(offsets, np.int32)[text.offset] if len(text) else 0
    ends = np.r_[0, np.cumsum(sizes)] + first
    return pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), data or pa.py_buffer(b"")])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a range in stream order, with the units and bytes ahead of each in its shard."""
    shard, at_unit, at_byte = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        units = batch.column("n_units").to_numpy()
        size = pc.binary_length(batch.column("text")).to_numpy().astype(np.int64)
        u0, b0 = np.cumsum(units) - units, np.cumsum(size) - size
        ends = pc.run_end_encode(batch.column("shard")).run_ends.to_numpy()
        first = 0
        for end in ends.tolist():
            name = batch.column("shard")[first].as_py()
            if name != shard:
                shard, at_unit, at_byte = name, 0, 0
            u0[first:end] += at_unit - u0[first]
            b0[first:end] += at_byte - b0[first]
            at_unit, at_byte = int(u0[end - 1] + units[end - 1]), int(b0[end - 1] + size[end - 1])
            first = end
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size), pa.array(u0), pa.array(b0)], names=[*batch.schema.names, "n_bytes", "u0", "b0"])


def _rows(starts):
    """Unit rows of split documents, each by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(low, TOGETHER)
                count = pc.list_value_length(some.column("sizes")).to_numpy(zero_copy_only=False).astype(np.int64)
                size = some.column("sizes").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                unit = _cut(some.column("text"), size)
                first = np.r_[0, np.cumsum(count)]
                total = np.r_[0, np.cumsum(size)]
                begin = [starts.value[key] for key in zip(some.column("part").to_pylist(), some.column("shard").to_pylist())]
                ahead = np.array(begin, np.int64).reshape(-1, 2)
                start, offset = ahead[:, 0] + some.column("u0").to_numpy(), ahead[:, 1] + some.column("b0").to_numpy()
                doc = np.repeat(np.arange(len(count)), count)
                pos = np.arange(len(unit)) - first[doc]
                doc_rows = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("shard").take(doc_rows),
                        pa.array(start[doc] + pos),
                        some.column("doc_id").take(doc_rows),
                        pa.array(pos),
                        unit,
                        pa.array(size),
                        pa.array(offset[doc] + total[:-1] - total[first[doc]]),
                        pa.array(pos == 0),
                    ],
                    names=[c.split()[0] for c in UNITS.split(", ")],
                )

    return run


def stored_units(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(UNITS).parquet(f"{path}/units")


def geometry(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(shard, shard_units, first_window): windows of ``size`` are numbered through the shards in name order; a row per shard."""
    shards = spark.read.parquet(f"{path}/shards")
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.floor(F.col("shard_units") / size).cast("bigint")
    return shards.select("shard", "shard_units", F.coalesce(F.sum(whole).over(earlier), F.lit(0)).alias("first_window"))


def placed_units(spark: SparkSession, path: str, size: int, where=None) -> DataFrame:
    """Units with ``seq`` and the geometry of their shard, as ``windows.sequence_units`` gives them, without any splitting.

    ``where`` is a condition on shard and seq, which reaches the files.
    """
    units = stored_units(spark, path)
    units = units if where is None else units.filter(where)
    shards = geometry(spark, path, size)
    named = shards.select(F.col("shard").alias("_name"), "shard_units", "first_window")
    return join_checked(units, named, F.col("shard").eqNullSafe(F.col("_name")), "inner").drop("_name", "byte_off")


def read_range(spark: SparkSession, path: str, shard: str, first: int, n: int) -> DataFrame:
    """Units [first, first + n) of one shard with byte offsets from the start of the range; other row groups stay unread."""
    wanted = (F.col("shard") == shard) & (F.col("seq") >= first) & (F.col("seq") < first + n)
    rows = stored_units(spark, path).filter(wanted).select("shard", "seq", "doc_id", "unit", "n_bytes", "byte_off")
    begin = rows.agg(F.min("byte_off").alias("_begin"))
    at = F.col("byte_off") - F.col("_begin")
    placed = rows.transform(one_row, begin)
    return placed.select("shard", "seq", "doc_id", "unit", "n_bytes", (at + F.col("n_bytes")).alias("byte_end"), at.alias("byte_off"))


def unit_at_byte(spark: SparkSession, path: str, shard: str, byte: int) -> DataFrame:
    """The unit that holds a byte of a shard: the index names the stretch of EVERY units to look in."""
    index = spark.read.parquet(f"{path}/index").filter((F.col("shard") == shard) & (F.col("byte_off") <= byte))
    near = index.agg(F.max("seq")).first()[0]
    if near is None or byte < 0:
        return stored_units(spark, path).limit(0)
    inside = (F.col("shard") == shard) & (F.col("seq") >= near) & (F.col("seq") < near + EVERY)
    return stored_units(spark, path).filter(inside & (F.col("byte_off") <= byte) & (F.col("byte_off") + F.col("n_bytes") > byte))


def last_windows(spark: SparkSession, path: str, size: int, n: int):
    """A condition on shard and seq that holds for the units of the last ``n`` windows; it names at most n shards."""
    shards = geometry(spark, path, size).withColumn("windows", F.floor(F.col("shard_units") / size).cast("bigint")).filter("windows > 0")
    total = shards.agg(F.coalesce(F.sum("windows"), F.lit(0))).first()[0]
    held = shards.filter(F.col("first_window") + F.col("windows") > total - n).collect()
    found = F.lit(False)
    for r in held:
        begin = max(total - n - r["first_window"], 0) * size
        found = found | (F.col("shard").eqNullSafe(r["shard"]) & (F.col("seq") >= begin) & (F.col("seq") < r["windows"] * size))
    return found
