"""Near-duplicate vectors through navigable small-world graphs, one hierarchical graph per shard.

Every vector queries every shard's graph.  A query whose beam is full of links widens it, and when that no longer
pays is answered by a scan of the shard, so no link is capped.  Each task also audits
queries against a scan, until these have enough links to others or all are audited, and widens all beams until the audit passes.  Cosines of
found pairs are computed in double precision.  A task hands on only counts and a spanning
forest of its links, never the pairs of a group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import durable, ship
from .components import connected

COSINE = 0.95
#: Vectors of a shard (16 MB at 64 dimensions) and queries of a task.
SHARD_ROWS = 32_768
#: Small tables still get so many shards, so that their work is divided.
LEAST_SHARDS = 6
NEIGHBOURS, LAYER_FACTOR = 16, 16
BUILD_BEAM, FIRST_BEAM, WIDEST_BEAM = 48, 24, 96
#: Queries of a task are audited, so many at a time, until they have so many links to other vectors or all are audited, and this share must be found.
AUDITED, AUDITED_LINKS, AUDIT_RECALL = 128, 200, 0.99
BATCH = 256


def _top(ids: np.ndarray, sims: np.ndarray, done: np.ndarray, width: int):
    """The ``width`` best columns of each row, best first."""
    if sims.shape[1] > width:
        keep = np.argpartition(-sims, width - 1, axis=1)[:, :width]
        ids, sims, done = (np.take_along_axis(x, keep, 1) for x in (ids, sims, done))
    order = np.argsort(-sims, axis=1, kind="stable")
    return tuple(np.take_along_axis(x, order, 1) for x in (ids, sims, done))


class Graph:
    """A hierarchical small-world graph over unit vectors, built and searched in batches of rows."""

    def __init__(self, vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]] | None = None):
        self.x = vectors.astype(np.float32)
        #: From the lowest layer up: (rows of the layer, neighbour rows or -1 by place in the layer).
        self.layers = layers if layers is not None else self._build()

    def _build(self):
        n = len(self.x)
        # Heights follow a geometric law; rows are already in random order, so the first rows are the tall ones.
        sizes = [n]
        while sizes[-1] > 2 * LAYER_FACTOR:
            sizes.append(sizes[-1] // LAYER_FACTOR)
        self.layers = []
        tables = [np.full((size, 2 * NEIGHBOURS), -1, dtype=np.int32) for size in sizes]
        filled = 0
        while filled < n:
            upto = min(n, filled + max(1, min(BATCH, filled)))
            rows = np.arange(filled, upto)
            for level, size in enumerate(sizes):
                inside = rows[rows < size]
                if len(inside):
                    self._insert(tables, level, inside, filled)
            filled = upto
        return [(np.arange(size), table) for size, table in zip(sizes, tables)]

    def _insert(self, tables, level: int, rows: np.ndarray, filled: int) -> None:
        x, table = self.x, tables[level]
        own = x[rows] @ x[rows].T
        np.fill_diagonal(own, -2)
        ids, sims = np.broadcast_to(rows, own.shape), own
        if filled:
            entry = self._descend(tables, x[rows], level, min(filled, len(tables[-1])))
            found, near = self._beam(table, x[rows], entry, BUILD_BEAM)
            ids, sims = np.concatenate([found, ids], 1), np.concatenate([near, sims], 1)
        sims = np.where(ids < 0, -2, sims)
        table[rows] = self._diverse(rows, ids, sims, 2 * NEIGHBOURS)[:, : 2 * NEIGHBOURS]
        picked = table[rows, :NEIGHBOURS]
        source, place = np.nonzero(picked >= 0)
        targets, sources = picked[source, place], rows[source]
        order = np.argsort(targets, kind="stable")
        targets, sources = targets[order], sources[order]
        unique, start, count = np.unique(targets, return_index=True, return_counts=True)
        extra = np.full((len(unique), count.max() if len(count) else 0), -1, dtype=np.int32)
        for k in range(extra.shape[1]):
            more = count > k
            extra[more, k] = sources[start[more] + k]
        for at in range(0, len(unique), BATCH):
            part = unique[at : at + BATCH]
            ids = np.concatenate([table[part], extra[at : at + BATCH]], 1)
            near = np.einsum("bmd,bd->bm", x[ids], x[part])
            near = np.where((ids < 0) | (ids == part[:, None]), -2, near)
            table[part] = self._diverse(part, ids, near, 2 * NEIGHBOURS)

    def _diverse(self, rows: np.ndarray, ids: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
        """Up to ``width`` neighbours of each row; one that is nearer to a chosen neighbour than to the row comes last.

        So a crowd of near copies leaves places for ways out of it.
        """
        ids, sims, _ = _top(ids, sims, np.zeros(ids.shape, bool), min(ids.shape[1], 3 * width))
        between = np.matmul(self.x[ids], self.x[ids].transpose(0, 2, 1))
        chosen = np.zeros(ids.shape, bool)
        for k in range(ids.shape[1]):
            repeated = (ids[:, :k] == ids[:, k : k + 1]).any(1) if k else np.zeros(len(ids), bool)
            shadowed = (chosen[:, :k] & (between[:, :k, k] > sims[:, k : k + 1])).any(1) if k else np.zeros(len(ids), bool)
            chosen[:, k] = (sims[:, k] > -2) & ~repeated & ~shadowed & (chosen[:, :k].sum(1) < width // 2 + width // 4)
            sims[repeated, k] = -2
        rank = np.where(sims <= -2, -4.0, sims + np.where(chosen, 4, 0))
        order = np.argsort(-rank, axis=1, kind="stable")[:, :width]
        out = np.where(np.take_along_axis(rank, order, 1) > -4, np.take_along_axis(ids, order, 1), -1).astype(np.int32)
        if out.shape[1] < width:
            out = np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=-1)
        return out

    def _descend(self, tables, queries: np.ndarray, level: int, tops: int) -> np.ndarray:
        """The nearest row on each layer above ``level``, starting from the rows of the highest."""
        entry = np.argmax(queries @ self.x[:tops].T, axis=1)
        for table in tables[-2:level:-1] if level < len(tables) - 1 else ():
            entry = self._beam(table, queries, entry, 4)[0][:, 0]
        return entry

    def _beam(self, table: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int):
        """(rows, cosines) of the ``width`` nearest rows that a best-first search reaches, -1 where there are fewer."""
        count, seen = len(queries), np.zeros((len(queries), len(self.x)), bool)
        ids = np.full((count, width), -1, dtype=np.int32)
        sims = np.full((count, width), -2, dtype=np.float32)
        done = np.ones((count, width), bool)
        ids[:, 0], done[:, 0] = entry, False
        sims[:, 0] = np.einsum("bd,bd->b", queries, self.x[entry])
        seen[np.arange(count), entry] = True
        active = np.arange(count)
        while len(active):
            open_sims = np.where(done[active], -3, sims[active])
            best = np.argpartition(-open_sims, 1, axis=1)[:, :2] if width > 2 else np.argmax(open_sims, 1)[:, None]
            valid = np.take_along_axis(open_sims, best, 1) > -3
            going = valid.any(1)
            active, best, valid = active[going], best[going], valid[going]
            if not len(active):
                break
            nodes = ids[active[:, None], best]
            done[active[:, None], best] = True
            near = np.where(valid[:, :, None], table[nodes], -1).reshape(len(active), -1)
            fresh = (near >= 0) & ~seen[active[:, None], near]
            seen[np.broadcast_to(active[:, None], near.shape)[fresh], near[fresh]] = True
            who, where = np.nonzero(fresh)
            new = np.full(near.shape, -2, dtype=np.float32)
            new[who, where] = np.einsum("nd,nd->n", self.x[near[who, where]], queries[active[who]])
            if near.shape[1] > NEIGHBOURS * 2:  # two lists may name the same row
                order = np.argsort(near, axis=1, kind="stable")
                ordered = np.take_along_axis(near, order, 1)
                twice = np.zeros(near.shape, bool)
                np.put_along_axis(twice, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
                new[twice] = -2
            merged = _top(
                np.concatenate([ids[active], near], 1),
                np.concatenate([sims[active], new], 1),
                np.concatenate([done[active], new <= -2], 1),
                width,
            )
            ids[active], sims[active], done[active] = merged
        ids[sims <= -2] = -1
        return ids, sims

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        tables = [table for _, table in self.layers]
        found = [
            self._beam(tables[0], part, self._descend(tables, part, 0, len(tables[-1])), width)
            for part in (queries[k : k + BATCH] for k in range(0, len(queries), BATCH))
        ]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _scan(x: np.ndarray, queries: np.ndarray, places: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """All (query place, row) pairs of at least ``cosine``, by blocks."""
    pairs = []
    for part in np.array_split(places, max(1, -(-len(places) // BATCH))):
        q, row = np.nonzero(queries[part] @ x.T >= cosine)
        pairs.append((part[q], row))
    return np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])


def audit(x: np.ndarray, queries: np.ndarray, own: np.ndarray, cosine: float) -> tuple[np.ndarray, set[tuple[int, int]]]:
    """Places of the audited queries, and all their (place, row) links to vectors other than themselves."""
    order = np.random.default_rng(len(queries)).permutation(len(queries))
    expected: set[tuple[int, int]] = set()
    at = 0
    while at < len(order) and len(expected) < AUDITED_LINKS:
        place, row = _scan(x, queries, order[at : at + AUDITED], cosine)
        other = own[place] != row
        expected.update(zip(place[other].tolist(), row[other].tolist()))
        at += AUDITED
    return order[:at], expected


def links(graph: Graph, x: np.ndarray, queries: np.ndarray, cosine: float = COSINE, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query place, row) pairs of at least ``cosine`` in double precision; ``own`` is each query's own row, -1 if it has none here.

    A query finds itself whatever the graph is like, so the audit counts links to others only.
    """
    own = np.full(len(queries), -1) if own is None else own
    sample, expected = audit(x, queries, own, cosine)
    single, width = queries.astype(np.float32), FIRST_BEAM
    waiting = np.arange(len(queries))
    while True:
        places, rows = [], []
        beam = width
        while len(waiting) and beam <= max(width, WIDEST_BEAM):
            ids, sims = graph.search(single[waiting], beam)
            crowded = (sims >= cosine - 1e-4).all(1)
            q, k = np.nonzero((ids >= 0) & (sims >= cosine - 1e-4) & ~crowded[:, None])
            places.append(waiting[q])
            rows.append(ids[q, k])
            waiting = waiting[crowded]
            beam *= 2
        if len(waiting):  # more links than the widest beam: the exact way
            q, row = _scan(x, queries, waiting, cosine)
            places.append(q)
            rows.append(row)
        place, row = np.concatenate(places).astype(np.int64), np.concatenate(rows).astype(np.int64)
        sure = np.zeros(len(place), bool)
        for at in range(0, len(place), 65_536):
            part = slice(at, at + 65_536)
            sure[part] = np.einsum("nd,nd->n", queries[place[part]], x[row[part]]) >= cosine
        place, row = place[sure], row[sure]
        inside = np.isin(place, sample)
        found = len(expected & set(zip(place[inside].tolist(), row[inside].tolist())))
        if found >= AUDIT_RECALL * len(expected):
            return place, row
        width, waiting = width * 2, np.arange(len(queries))
        if width >= len(x):
            return _scan(x, queries, waiting, cosine)


def _roots(place: np.ndarray, row: np.ndarray, queries: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A component number for each query and row, spreading the smallest along links until nothing changes."""
    at_query, at_row = np.arange(queries), np.arange(queries, queries + rows)
    while len(place):
        before = at_query.copy(), at_row.copy()
        np.minimum.at(at_row, row, at_query[place])
        np.minimum.at(at_query, place, at_row[row])
        if (before[0] == at_query).all() and (before[1] == at_row).all():
            break
    return at_query, at_row


def _unit(vectors) -> np.ndarray:
    x = np.array(vectors.tolist(), dtype=np.float64)
    # Scaled first, so that neither very large nor very small components lose the norm.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _index(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("node")
    x = _unit(group["v"])
    tables = [table for _, table in Graph(x).layers]
    return pd.DataFrame(
        {
            "dim": group["dim"].iloc[:1],
            "shard": group["shard"].iloc[:1],
            "nodes": [group["node"].to_numpy(np.int64).tobytes()],
            "copies": [group["copies"].to_numpy(np.int64).tobytes()],
            "vectors": [x.tobytes()],
            "graph": [b"".join(t.tobytes() for t in tables)],
            "sizes": [[len(t) for t in tables]],
        }
    )


def _query(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    if not len(index) or not len(asked):
        return pd.DataFrame({"node": np.array([], np.int64), "n": np.array([], np.int64), "root": np.array([], np.int64)})
    held = index.iloc[0]
    nodes, copies = np.frombuffer(held["nodes"], np.int64), np.frombuffer(held["copies"], np.int64)
    x = np.frombuffer(held["vectors"], np.float64).reshape(len(nodes), -1)
    flat, layers, at = np.frombuffer(held["graph"], np.int32), [], 0
    for size in held["sizes"]:
        layers.append((np.arange(size), flat[at : at + size * 2 * NEIGHBOURS].reshape(size, -1)))
        at += size * 2 * NEIGHBOURS
    asked = asked.sort_values("node")
    queries, own = _unit(asked["v"]), asked["node"].to_numpy(np.int64)
    at_own = np.minimum(np.searchsorted(nodes, own), len(nodes) - 1)
    place, row = links(Graph(x, layers), x, queries, own=np.where(nodes[at_own] == own, at_own, -1))
    other = own[place] != nodes[row]
    place, row = place[other], row[other]
    count = np.zeros(len(own), dtype=np.int64)
    np.add.at(count, place, copies[row])
    at_query, at_row = _roots(place, row, len(own), len(nodes))
    q, r = np.unique(place), np.unique(row)
    name = np.concatenate([own, nodes])
    return pd.DataFrame(
        {
            "node": np.concatenate([own[q], nodes[r]]),
            "n": np.concatenate([count[q], np.zeros(len(r), dtype=np.int64)]),
            "root": np.concatenate([name[at_query[q]], name[at_row[r]]]),
        }
    )


def report(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per vector row: vec_id, n_links, component_id, kept.

    Null, empty and zero vectors, and those with null or non-finite components, link with nothing, as do vectors of
    different length with each other.  Equal vectors are one node with a number of copies, and are linked.
    A null vec_id is its own component if unlinked; in a component the smallest other id counts.
    Other columns, labels too, are ignored.  Work: every vector against every shard, SHARD_ROWS vectors
    each, so beyond LEAST_SHARDS shards it grows faster than the table (rows x shards x log).
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    sound = F.coalesce(sound, F.lit(False))
    reps = durable(rows.filter(sound).groupBy("v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least")))
    reps = durable(reps.select("v", "copies", "least", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("node")))
    shards = max(LEAST_SHARDS, -(-reps.count() // SHARD_ROWS))
    dealt = reps.select("node", "copies", "v", "dim", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("shard"))
    index = durable(
        dealt.groupBy("dim", "shard").applyInPandas(
            _index, "dim int, shard int, nodes binary, copies binary, vectors binary, graph binary, sizes array<int>"
        )
    )
    every = F.sequence(F.lit(0), F.lit(shards - 1))
    asked = dealt.select("dim", "node", "v", F.col("shard").alias("block"), F.explode(every).alias("shard"))
    held = index.select("*", F.explode(every).alias("block"))
    found = durable(
        held.groupBy("dim", "shard", "block").cogroup(asked.groupBy("dim", "shard", "block")).applyInPandas(_query, "node long, n long, root long")
    )
    roots = connected(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    degree = found.groupBy("node").agg(F.sum("n").alias("n"))
    nodes = reps.join(roots, "node", "left").join(degree, "node", "left")
    nodes = nodes.select("v", "least", F.coalesce("root", "node").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    smallest = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = nodes.join(smallest, "root").select("v", "n_links", "component_id")
    linked = rows.filter(sound).join(named, "v").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select(
        "vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    )
