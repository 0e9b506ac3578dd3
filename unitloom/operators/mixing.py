"""Seen-id filters, byte budgets and mixtures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import id_hash, ratio
from .ordered import one_row, prefix_scan, ranked


#: Words of the filter of seen ids (about 20 MB when broadcast).
WORDS = 1 << 18


def build_seen_ids(df: DataFrame, key: str) -> DataFrame:
    return df.select(id_hash(key).alias("id_hash")).distinct()


def seen_words(hits: DataFrame) -> DataFrame:
    """A Bloom filter of the ids in ``hits`` (id_hash) as rows (word, bits): WORDS words of 64 bits at most, three bits of one word for an id."""
    return hits.groupBy(_word("id_hash").alias("_word")).agg(F.bit_or(_bits("id_hash")).alias("_bits"))


def _word(column: str):
    return F.pmod(F.col(column), F.lit(WORDS))


def _bits(column: str):
    one = "shiftleft(1L, cast(shiftright(xxhash64({}), {}) & 63 as int))"
    return F.expr(" | ".join(one.format(column, at) for at in (0, 6, 12)))


def drop_seen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose id hash is not in ``seen``; rows of a null key stay.

    The hashes alone are moved to find those that occur in both; a Bloom filter of these, WORDS rows at most, is
    broadcast, and only rows that may be in it are moved for the exact anti join.  So the wide rows that are shuffled follow the share
    of rows that are dropped, not the table.  Too many hits for the filter cost more moved rows, never a wrong one.
    """
    hashed = df.withColumn("id_hash", id_hash(key))
    hits = hashed.select("id_hash").join(seen, "id_hash", "left_semi")
    words = F.broadcast(seen_words(hits))
    marked = hashed.withColumn("_word", _word("id_hash")).join(words, "_word", "left")
    own = _bits("id_hash")
    maybe = F.coalesce(F.col("_bits").bitwiseAND(own) == own, F.lit(False))
    away = marked.filter(~maybe).drop("_word", "_bits", "id_hash")
    met = marked.filter(maybe).drop("_word", "_bits").join(seen, "id_hash", "left_anti").drop("id_hash")
    return away.unionByName(met)


def retention(df: DataFrame, seen: DataFrame, key: str, file: str, size: str) -> DataFrame:
    """Rows in, rows and bytes kept and kept ratio per file, plus one overall row (file = NULL)."""
    flagged = df.select(file, F.col(size).alias("_size"), id_hash(key).alias("id_hash")).join(
        seen.withColumn("_seen", F.lit(1)), "id_hash", "left"
    )
    kept = F.col("_seen").isNull()
    return (
        flagged.rollup(file)
        .agg(
            F.count(F.lit(1)).alias("rows_in"),
            F.sum(kept.cast("bigint")).alias("rows_kept"),
            F.sum(F.when(kept, F.col("_size")).otherwise(0)).alias("bytes_kept"),
        )
        .withColumn("kept_ratio", ratio("rows_kept", "rows_in"))
    )


def budget_by_file(files: DataFrame, target_bytes: int, file: str = "file", size: str = "bytes_kept") -> DataFrame:
    """Files in name order until the running size reaches the target; the crossing file stays."""
    run = prefix_scan(files, [], [file], {"cum": ("sum", F.col(size))})
    return run.filter(F.col("cum") - F.col(size) < target_bytes)


def budget_by_doc(docs: DataFrame, target_bytes: int, order: Sequence[str] = ("shard", "doc_id"), size: str = "size") -> DataFrame:
    """The same rule over documents; input and output are narrow (keys and size)."""
    run = prefix_scan(docs, [], list(order), {"cum": ("sum", F.col(size))})
    return run.filter(F.col("cum") - F.col(size) < target_bytes)


def distinct_units(units: DataFrame) -> DataFrame:
    """Distinct units with the place they first occur."""
    first = F.min(F.struct("shard", "doc_id", "pos"))
    return units.groupBy("unit").agg(first.alias("_f")).select("unit", "_f.*")


def split_train_val(distinct: DataFrame, val_frac: float, seed: int) -> DataFrame:
    """Hash-shuffled split; at least one validation row."""
    size = distinct.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * F.lit(val_frac))).cast("bigint").alias("n_val"))
    placed = ranked(distinct.withColumn("_h", id_hash(F.lit(str(seed)), "unit")), [], ["_h", "unit"], "place")
    return placed.transform(one_row, size).select(
        *distinct.columns, F.when(F.col("place") <= F.col("n_val"), "val").otherwise("train").alias("split")
    )


def pick_shards(shards: DataFrame, targets: Mapping[str, float], anchor: str, source_order: Sequence[str] = ()) -> DataFrame:
    """Choose shards per class: the anchor class entirely, the others up to their share.

    ``shards`` holds (klass, source, shard, n_units).  The anchor's units divided by its
    target share give the mixture total; every other class takes its shards, source by
    source, until its part of that total is reached, the crossing shard included.
    """
    rank = F.coalesce(F.array_position(F.lit(list(source_order)).cast("array<string>"), F.col("source")), F.lit(0))
    total = shards.filter(F.col("klass") == anchor).agg((F.sum("n_units") / F.lit(targets[anchor])).alias("_total"))
    share = F.create_map(*[F.lit(x) for pair in targets.items() for x in pair])
    run = prefix_scan(
        shards.filter(F.col("klass").isin(list(targets))).withColumn("_rank", rank),
        ["klass"],
        ["_rank", "source", "shard"],
        {"cum": ("sum", F.col("n_units"))},
    )
    keep = (F.col("klass") == anchor) | (F.col("cum") - F.col("n_units") < share[F.col("klass")] * F.col("_total"))
    return run.transform(one_row, total).filter(keep).drop("_rank", "_total")


def mix_report(chosen: DataFrame, by: str = "klass") -> DataFrame:
    """Shards, units and share per class, with a TOTAL row."""
    rows = chosen.rollup(by).agg(
        F.count(F.lit(1)).alias("shards"), F.sum("n_units").alias("n_units"), F.grouping_id().alias("_level")
    )
    total = chosen.agg(F.sum("n_units").alias("_all"))
    return rows.transform(one_row, total).select(
        F.when(F.col("_level") == 1, "TOTAL").otherwise(F.col(by)).alias(by), "shards", "n_units", ratio("n_units", "_all").alias("share")
    )


def require_min(df: DataFrame, metric: str, threshold: float) -> DataFrame:
    """One row with the total; the job fails when it is below the threshold."""
    total = df.agg(F.sum(metric).alias("total"))
    message = F.concat(F.lit(f"{metric} total "), F.col("total").cast("string"), F.lit(f" is below {threshold}"))
    return total.select(
        F.when(F.col("total") >= threshold, F.col("total")).otherwise(F.raise_error(message).cast("bigint")).alias("total"),
        F.lit(float(threshold)).alias("threshold"),
    )


def union_pools(*pools: DataFrame) -> DataFrame:
    """Stack shard tables in pool order and renumber all shards from 0."""
    stacked = None
    for i, pool in enumerate(pools):
        part = pool.withColumn("pool", F.lit(i).cast("bigint"))
        stacked = part if stacked is None else stacked.unionByName(part)
    shards = ranked(stacked.select("pool", "shard").distinct(), [], ["pool", "shard"], "_place")
    return stacked.join(shards, ["pool", "shard"]).withColumn("new_shard", F.col("_place") - 1).drop("_place")


def common_vocabulary(a: DataFrame, b: DataFrame) -> DataFrame:
    """Trimmed units that start with an ASCII letter and occur on both sides."""

    def words(df: DataFrame) -> DataFrame:
        return df.select(F.trim("unit").alias("word")).filter(F.col("word").rlike("^[A-Za-z]"))

    return words(a).intersect(words(b))


def exclude_tasks(df: DataFrame, invalid: Sequence[str], task: str = "task") -> DataFrame:
    """Flag invalid tasks; averages use only rows with ``valid``."""
    return df.withColumn("valid", ~F.col(task).isin(list(invalid)))
