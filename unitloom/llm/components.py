"""Connected components of an edge table, entirely as joins and groupings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..session import checkpoint_dir
from .common import ship


#: Rows of a partition of the small tables that the rounds pass on.
ROWS = 100_000


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in as many partitions as its ``rows`` fill, without moving anything, so that a small table is not dealt to hundreds of tasks and files."""
    return df.coalesce(max(1, -(-rows // ROWS)))


def sized(df: DataFrame) -> DataFrame:
    """``df`` kept as Parquet in a folder of its own under ``spark.checkpoint.dir``.

    A checkpoint takes over the planner's estimate of its size, for a join the product of both sides'.  Rounds of joins square that
    each time, to numbers of millions of digits that fill the driver; files have the size that they have.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{checkpoint_dir(spark)}/rounds-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _flat(parent: DataFrame, rows: int) -> DataFrame:
    """Follow (node, parent) pointers to their ends, doubling the step each time."""
    while True:
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        jumped = sized(few(parent.join(up, "parent").select("node", "parent", "next"), rows))
        moved = jumped.filter("next <> parent").limit(1).count()
        parent = jumped.select("node", F.col("next").alias("parent"))
        if not moved:
            return parent


def connected(edges: DataFrame) -> DataFrame:
    """(u, v) long edges -> (node, root), root being the smallest node that can be reached.

    Every round points each node to its smallest neighbour, flattens the pointers and
    contracts the edges, so rounds grow with the logarithm of a component's width.  A
    node of very many edges costs one partial aggregate per task; joins run on the
    node with its unique parent on the other side, which Spark can split.  Null ends
    and loops are ignored; an empty table gives an empty result.
    """
    ends = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    left = sized(ends.filter("u <> v").distinct())
    total = None
    while rows := left.count():
        left = few(left, rows)
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = few(few(both, 2 * rows).groupBy("u").agg(F.min("v").alias("low")), 2 * rows)
        parent = _flat(sized(nearest.select(F.col("u").alias("node"), F.least("u", "low").alias("parent"))), 2 * rows)
        if total is None:
            total, nodes = parent.select("node", F.col("parent").alias("root")), 2 * rows
        else:
            step = parent.select(F.col("node").alias("root"), F.col("parent").alias("top"))
            joined = total.join(step, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
            total = sized(few(joined, nodes))
        pu = parent.select(F.col("node").alias("u"), F.col("parent").alias("pu"))
        pv = parent.select(F.col("node").alias("v"), F.col("parent").alias("pv"))
        moved = few(few(left.join(pu, "u"), rows).join(pv, "v"), rows).filter("pu <> pv")
        left = sized(few(moved.select(F.greatest("pu", "pv").alias("u"), F.least("pu", "pv").alias("v")).distinct(), rows))
    return total if total is not None else left.select(F.col("u").alias("node"), F.col("v").alias("root"))
