"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import durable, ship

__all__ = ["durable", "fresh", "held_out", "keeps", "row_key", "ship", "table", "turn_to"]

#: How to drop what a worker keeps from task to task, by operator.
_kept: dict[str, Callable[[], None]] = {}


def keeps(operator: str, drop: Callable[[], None]) -> None:
    """``operator`` keeps tables in its workers, and ``drop`` empties them."""
    _kept[operator] = drop


def turn_to(operator: str) -> None:
    """Called where a task's Python work begins: a worker serves many stages, but keeps the tables of one operator only."""
    for other, drop in _kept.items():
        if other != operator:
            drop()
    pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def held_out(doc_id="doc_id"):
    """True for the rows whose labels no model may see: crc32 of the id's digits leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def row_key(id_column="doc_id", text="text"):
    """Identity of a document row: its id and its text, both of which may be null."""
    return F.md5(
        F.concat_ws(
            "\x1f",
            F.coalesce(F.col(id_column).cast("string"), F.lit("-")),
            F.when(F.col(text).isNull(), "0").otherwise("1"),
            F.coalesce(F.col(text), F.lit("")),
        ).cast("binary")
    )
