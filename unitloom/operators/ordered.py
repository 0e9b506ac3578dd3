"""Order-dependent results without putting a whole group into one task.

A plain ``Window.partitionBy(group).orderBy(key)`` sorts every group in one task,
which fails when one shard or run holds a third of the table.  ``prefix_scan`` cuts
the ordered rows into range slices, scans every slice by itself, and adds the
carry of the slices before it.  A carry exists only where a group crosses a slice
border, so the broadcast carry table has fewer rows than there are slices.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import durable

_KINDS: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "count": F.count,
    "min": F.min,
    "max": F.max,
    "last": lambda c: F.last(c, ignorenulls=True),
}


#: Rows of a table that ``join_checked`` broadcasts at most.
BROADCAST_ROWS = 500_000


def _carry(kind: str, base: Column, local: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(base, F.lit(0)) + F.coalesce(local, F.lit(0))
    if kind == "min":
        return F.least(base, local)
    if kind == "max":
        return F.greatest(base, local)
    return F.coalesce(local, base)


def prefix_scan(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence,
    scans: dict[str, tuple[str, Column]],
) -> DataFrame:
    """Add inclusive running results per group.

    ``scans`` maps an output name to (kind, expression), kind being sum, count, min,
    max or last (last non-null value); ``<kind>_before`` leaves out the current row.  ``order`` must be unique within a group; it
    may hold descending columns.  Pass narrow rows: they are written once to the
    checkpoint folder, which also pins the slice borders.
    """
    one = not group
    rows = df.withColumn("_all", F.lit(0)) if one else df
    keys = ["_all"] if one else list(group)
    orders = [F.col(o) if isinstance(o, str) else o for o in order]
    rows = rows.repartitionByRange(*[F.col(k) for k in keys], *orders).withColumn("_slice", F.spark_partition_id())

    ordered = Window.partitionBy(*keys, "_slice").orderBy(*orders)
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    kinds = {name: kind.removesuffix("_before") for name, (kind, _) in scans.items()}
    local = durable(
        rows.select(
            "*",
            *[
                _KINDS[kinds[name]](expr).over(earlier if kind.endswith("_before") else running).alias(name)
                for name, (kind, expr) in scans.items()
            ],
            *[
                _KINDS[kinds[name]](expr).over(running).alias(f"_through_{name}")
                for name, (kind, expr) in scans.items()
                if kind.endswith("_before")
            ],
            F.lead(F.lit(1)).over(ordered).isNull().alias("_tail"),
        )
    )

    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        local.filter("_tail")
        .select(
            *[F.col(k).alias(f"_key_{k}") for k in keys],
            F.col("_slice").alias("_key_slice"),
            F.count(F.lit(1)).over(before).alias("_earlier"),
            *[
                _KINDS["sum" if kinds[name] == "count" else kinds[name]](
                    F.col(f"_through_{name}" if kind.endswith("_before") else name)
                )
                .over(before)
                .alias(f"_base_{name}")
                for name, (kind, _) in scans.items()
            ],
        )
        .filter("_earlier > 0")
        .drop("_earlier")
    )
    same = F.col("_slice") == F.col("_key_slice")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))  # a NULL group is a group like any other
    joined = local.join(F.broadcast(carry), same, "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[_carry(kind, F.col(f"_base_{name}"), F.col(name)).alias(name) for name, kind in kinds.items()],
    )


def join_checked(big: DataFrame, small: DataFrame, keys, how: str = "left", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join against a table whose size is measured first.

    Up to ``max_rows`` rows it is broadcast and the big side is not moved; above that
    the join is shuffled, and adaptive execution splits the partitions of hot keys.
    ``small`` should be cheap to count (a checkpoint or a stored table).
    """
    rows = small.limit(max_rows + 1).count()
    return big.join(F.broadcast(small) if rows <= max_rows else small, keys, how)


def one_row(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Attach the columns of a table that is one row by construction (an ungrouped aggregate).

    Use as ``df.transform(one_row, totals)``.
    """
    return df.crossJoin(F.broadcast(scalars))


def ranked(df: DataFrame, group: Sequence[str], order: Sequence, name: str = "rn") -> DataFrame:
    """1-based position of every row inside its group."""
    return prefix_scan(df, group, order, {name: ("count", F.lit(1))})


def sliding(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence,
    exprs: Callable[[Window], dict[str, Column]],
    back: int = 0,
    ahead: int = 0,
    span: int = 1 << 16,
    rank: str = "rn",
) -> DataFrame:
    """Window expressions that look at most ``back`` rows back and ``ahead`` rows forward.

    Groups are cut into blocks of ``span`` ranked rows; each block also receives the
    few neighbouring rows its frame reaches, so blocks are independent tasks.
    """
    if span < max(back, ahead, 1):
        raise ValueError("span must cover the frame")
    block = F.floor((F.col(rank) - 1) / span).cast("bigint")
    offset = F.pmod(F.col(rank) - 1, F.lit(span))
    copies = F.array_compact(
        F.array(
            block,
            F.when(offset >= span - back, block + 1),
            F.when((offset < ahead) & (block > 0), block - 1),
        )
    )
    numbered = ranked(df, group, order, rank)
    halo = numbered.withColumn("_home", block).withColumn("_block", F.explode(copies))
    window = Window.partitionBy(*group, "_block").orderBy(rank)
    out = halo.select("*", *[e.alias(n) for n, e in exprs(window).items()])
    return out.filter("_home = _block").drop("_home", "_block")


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence, n: int, rank: str = "rn") -> DataFrame:
    """First ``n`` rows of each group.

    The rank filter is turned into a per-partition group limit before the shuffle,
    so a hot group sends at most ``n`` rows per input partition.
    """
    if n > 1000:
        return ranked(df, group, order, rank).filter(F.col(rank) <= n)
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window).cast("bigint")).filter(F.col(rank) <= n)


def smallest(df: DataFrame, order: Sequence, n: int, most: int = 10000) -> DataFrame:
    """The ``n`` first rows of the whole table; large ``n`` stays distributed."""
    if n <= most:
        return df.orderBy(*order).limit(n)
    return ranked(df, [], order, "_place").filter(F.col("_place") <= n).drop("_place")
