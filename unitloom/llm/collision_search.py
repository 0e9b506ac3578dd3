"""Approximate nearest neighbours by collision counting over single projections.

Vectors are dealt to shards.  A shard keeps ``PROJECTIONS`` sorted arrays, one per random direction.  A query opens on every
array a window centred on its own projection, WIDTH / 2 x radius to either side; a larger radius (virtual
rehashing) only extends the windows, so each array entry is counted once per query.  Vectors that fall into
``THRESHOLD`` of the windows are verified by their true distance.  The radius grows until the k-th
nearest verified vector is no farther than the radius: a nearer one lies in a given window with probability 0.83 or
more, so it misses the threshold with probability under 0.001.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.ordered import top_per_group
from .common import durable, ship

PROJECTIONS = 64
#: Full width of a window for a radius of one.
WIDTH = 2.719
#: Windows that a vector must fall into.
THRESHOLD = 42
#: Growth of the radius from one round to the next.
GROWTH = 1.3
#: Bytes of vectors in a shard and of queries in a block; every block of queries visits every shard.
SHARD_BYTES, BLOCK_BYTES = 16 << 20, 16 << 20
#: Shards at least, so that small tables use several tasks.
LEAST_SHARDS = 6
SEED = 20_240_601


class SortedProjections:
    """The sorted arrays of one shard."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.axes = np.random.default_rng([SEED, x.shape[1]]).standard_normal((x.shape[1], PROJECTIONS))
        placed = x @ self.axes
        self.order = np.argsort(placed, axis=0, kind="stable").T.astype(np.int32)
        self.values = np.sort(placed, axis=0).T.copy()

    def nearest(self, q: np.ndarray, tie: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances of the k nearest found, ties by ``tie``; all rows if there are no more than k."""
        n = len(self.x)
        centre = q @ self.axes
        middle = [int(np.searchsorted(v, c)) for v, c in zip(self.values, centre)]
        # The first radius: about k rows lie in the middle one of the windows.
        reach = sorted(self._reach(v, c, m, min(k, n)) for v, c, m in zip(self.values, centre, middle))
        radius = max(reach[len(reach) // 2] * 2 / WIDTH, 1e-12)
        low, high = list(middle), list(middle)
        count = np.zeros(n, dtype=np.int64)
        seen = np.zeros(n, dtype=bool)
        rows, distances = np.empty(0, np.int64), np.empty(0)
        while True:
            half = WIDTH / 2 * radius
            fresh = []
            for i, (values, order) in enumerate(zip(self.values, self.order)):
                lo, hi = (int(e) for e in np.searchsorted(values, (centre[i] - half, np.nextafter(centre[i] + half, np.inf))))
                lo, hi = min(lo, low[i]), max(hi, high[i])
                fresh += (order[lo : low[i]], order[high[i] : hi])
                low[i], high[i] = lo, hi
            count += np.bincount(np.concatenate(fresh), minlength=n)
            new = np.flatnonzero((count >= THRESHOLD) & ~seen)
            if len(new):
                seen[new] = True
                rows = np.concatenate([rows, new])
                distances = np.concatenate([distances, distance(self.x[new], q)])
                best = np.lexsort((tie[rows], distances))[:k]
                rows, distances = rows[best], distances[best]
            if all(a == 0 for a in low) and all(b == n for b in high):
                return rows, distances
            if len(rows) == k:
                if distances[-1] <= radius:
                    return rows, distances
                radius = min(radius * GROWTH, max(distances[-1], np.nextafter(radius, np.inf)))
            else:
                radius *= GROWTH

    @staticmethod
    def _reach(values: np.ndarray, centre: float, middle: int, k: int) -> float:
        around = values[max(middle - k, 0) : middle + k]
        return float(np.partition(np.abs(around - centre), min(k, len(around)) - 1)[min(k, len(around)) - 1])


def distance(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances, squares added from the first component to the last."""
    return np.sqrt(np.cumsum((x - q) ** 2, axis=1)[:, -1]) if len(x) else np.empty(0)


def _search(k: int):
    def run(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(held) and len(asked):
            index = SortedProjections(np.stack(held["v"].to_numpy()).astype(np.float64))
            least = np.array([ids[0] for ids in held["ids"]], dtype=np.int64)
            ids = held["ids"].to_numpy()
            for h1, h2, v in zip(asked["h1"], asked["h2"], asked["v"]):
                rows, distances = index.nearest(np.asarray(v, dtype=np.float64), least, k)
                # The k first ids lie on the k first vectors, each of which has at least one.
                entries = sorted((d, int(i)) for r, d in zip(rows, distances.tolist()) for i in ids[r])[:k]
                found += [(h1, h2, i, d) for d, i in entries]
        return pd.DataFrame(found, columns=["h1", "h2", "vec_id", "score"])

    return run


def sound(v):
    """Vectors that take part: not null, not all zero, every component finite."""
    return F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0), F.lit(False))


def search(vectors: DataFrame, is_query, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k nearest found of every row that ``is_query`` (a condition on ``vec_id``) holds for: query_id, rank, vec_id, score.

    ``score`` is the Euclidean distance in double precision; equal distances go by the smaller id.  A query's own id is never its
    candidate.  Null, zero, null-holding and non-finite vectors, and null ids, take no part; vectors of different length
    never meet.  Rows that repeat id and vector count once.  Equal vectors are searched once and stand for their k + 1 smallest ids, which
    are all that any query can need, so a vector of very many copies costs no more than another.
    Every block of queries visits every shard: work is queries x shards, less what the windows leave out.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    # Adding zero makes -0.0 and 0.0 one value.
    rows = rows.filter(F.col("vec_id").isNotNull() & sound("v")).withColumn("v", F.transform("v", lambda c: c + F.lit(0.0)))
    rows = durable(rows.select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")).dropDuplicates(["vec_id", "h1", "h2"]))
    kept = top_per_group(rows, ["h1", "h2"], ["vec_id"], k + 1)
    nodes = durable(kept.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("vec_id")).alias("ids")))
    nodes = nodes.withColumn("dim", F.size("v"))
    queries = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), "h1", "h2")
    asked = nodes.join(queries.select("h1", "h2").distinct(), ["h1", "h2"]).select("h1", "h2", "v", "dim")
    total = nodes.agg(F.coalesce(F.sum(F.col("dim") * 8), F.lit(0))).first()[0]
    many = asked.agg(F.coalesce(F.sum(F.col("dim") * 8), F.lit(0))).first()[0]
    shards, blocks = max(LEAST_SHARDS, -(-total // SHARD_BYTES)), max(1, -(-many // BLOCK_BYTES))
    shard, block = F.pmod("h1", F.lit(shards)).cast("int"), F.pmod("h2", F.lit(blocks)).cast("int")
    held = nodes.select("dim", "v", "ids", shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    sent = asked.select("dim", "h1", "h2", "v", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), block.alias("block"))
    on = ["dim", "shard", "block"]
    # Renamed, so that the two sides of one table aren't taken for each other.
    sent = sent.toDF("dim", "h1", "h2", "v", "shard", "block")
    found = held.toDF("dim", "v", "ids", "shard", "block").groupBy(*on).cogroup(sent.groupBy(*on)).applyInPandas(_search(k + 1), "h1 long, h2 long, vec_id long, score double")
    best = top_per_group(found, ["h1", "h2"], ["score", "vec_id"], k + 1, "place")
    pairs = queries.join(best, ["h1", "h2"]).filter("vec_id <> query_id")
    ranked = top_per_group(pairs.drop("place"), ["query_id", "h1", "h2"], ["score", "vec_id"], k, "rank")
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
