"""The trie of conversation prefixes, by union-find over the common prefixes of sorted neighbours.

Conversations become rows of turn digests; equal ones are one sequence.  Sequences are sorted over range partitions and cut into
blocks.  In a block every pair of neighbours is an edge whose weight is the number of turns they share; edges are taken in
descending weight, and each merge of two components makes a branching node at that depth (or extends the node that is there).  The turns
between a node and its parent are the trie's unbranched nodes.

A node can reach into neighbouring blocks only along the paths of a block's first and last sequence, and only as deep as these share turns with
the sequence beyond the border.  So a block's forest contracts to those nodes, which are merged over all blocks by the digest of
their prefix; figures are kept so that parts add up (a node counts as new only in the first block that has it).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import durable, ship

#: Bytes of a turn's digest.
DIGEST = 16
#: Sequences and turns of a block at most (a longer sequence is a block of its own).
BLOCK, BLOCK_TURNS = 5_000, 200_000
#: Ids joined into one row on the way to a group's digest.
IDS_TOGETHER = 4_096
#: A conversation begins with up to MOST_SHARED turns of the first of its FAMILY.
FAMILY, MOST_SHARED = 20, 3
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
FINAL, AWAITS_PARENT, PART = 0, 1, 2


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as (digest, words) structs; rows of a null conv_id are left out.

    Turns go by ``turn``, null first, equal ones by the digest of role and text; null roles and texts are empty.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn", digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("words"))
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return ordered.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Every conversation behind the first turns of its family's first one: (conv_id, turns)."""
    shared = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(MOST_SHARED + 1)).cast("int")
    base = conversations.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, MOST_SHARED).alias("first"))
    own = conversations.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn("h", shared)
    none = F.slice("turns", 1, 0)
    first = F.coalesce(F.slice("first", F.lit(1), F.col("h")), none)
    rest = F.slice("turns", F.col("h") + 1, F.size("turns") + 1)
    return own.join(base, "base", "left").select("conv_id", F.concat(first, rest).alias("turns"))


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces of the id lists of equal sequences, in order."""
    for batch in batches:
        rows = []
        for group, part in groupby(zip(batch["gid"], batch["conv_id"].tolist()), key=lambda r: r[0]):
            ids = [i for _, i in part]
            for at in range(0, len(ids), IDS_TOGETHER):
                some = ids[at : at + IDS_TOGETHER]
                rows.append((group, some[0], len(some), ",".join(map(str, some))))
        yield pd.DataFrame(rows, columns=["gid", "low", "n", "ids"])


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One digest per sequence from its pieces, which follow each other; only the running digest is held."""
    group = low = n = sha = None
    for batch in batches:
        rows = []
        for gid, first, count, ids in zip(batch["gid"], batch["low"].tolist(), batch["n"].tolist(), batch["ids"]):
            if gid == group:
                n += count
                sha.update(b"," + ids.encode())
                continue
            if group is not None:
                rows.append((low, n, sha.hexdigest()))
            group, low, n, sha = gid, first, count, hashlib.sha256(ids.encode())
        yield pd.DataFrame(rows, columns=["conv_id", "n", "ends"])
    if group is not None:
        yield pd.DataFrame([(low, n, sha.hexdigest())], columns=["conv_id", "n", "ends"])


def sequences(conversations: DataFrame) -> DataFrame:
    """Distinct sequences: key (digests of the turns), words per turn, n conversations, the smallest id, and the digest of all their ids."""
    keyed = durable(
        conversations.select(
            "conv_id", F.unhex(F.array_join(F.col("turns.digest"), "")).alias("key"), F.col("turns.words").cast("array<int>").alias("words")
        ).withColumn("gid", F.md5("key"))
    )
    members = keyed.select("gid", "conv_id").repartitionByRange("gid", "conv_id").sortWithinPartitions("gid", "conv_id")
    pieces = members.mapInPandas(_runs, "gid string, low long, n long, ids string")
    ends = pieces.repartition("gid").sortWithinPartitions("gid", "low").mapInPandas(_digests, "conv_id long, n long, ends string")
    return keyed.select("conv_id", "key", "words").join(ends, "conv_id").select("key", "words", "n", F.col("conv_id").alias("low"), "ends")


def shared_turns(a: bytes, b: bytes) -> int:
    """Turns that two keys begin with alike."""
    size = min(len(a), len(b)) // 8 * 8
    same = np.frombuffer(a, np.uint64, size // 8) == np.frombuffer(b, np.uint64, size // 8)
    return (int(np.argmin(same)) if not same.all() else len(same)) * 8 // DIGEST


class Forest:
    """The trie of one sorted block, built by merging neighbours from the deepest common prefix up.

    ``before`` and ``after`` are the turns that the first and the last sequence share with the ones beyond the block, -1 if there are none.
    """

    def __init__(self, keys, words, n, low, ends, before: int, after: int):
        self.keys, self.words, self.before, self.after = keys, words, before, after
        size = len(keys)
        shared = [shared_turns(a, b) for a, b in zip(keys, keys[1:])]
        self.depth = [len(k) // DIGEST for k in keys]
        self.sequence = list(range(size))  # one sequence below each node
        self.n, self.low, self.ends = list(n), list(low), list(ends)
        self.leaves = [int(shared_after < d) for shared_after, d in zip([*shared, after], self.depth)]
        self.saved, self.children = [0] * size, [0] * size
        self.first, self.last = [i == 0 for i in range(size)], [i == size - 1 for i in range(size)]
        self.same = list(range(size))  # a node that was merged into another one of its depth
        self.rows: list[tuple] = []
        leader, top = list(range(size)), list(range(size))

        def find(i):
            while leader[i] != i:
                leader[i] = leader[leader[i]]
                i = leader[i]
            return i

        for edge in sorted(range(size - 1), key=lambda e: -shared[e]):
            left, right = find(edge), find(edge + 1)
            leader[right] = left
            top[left] = self._merge(top[left], top[right], shared[edge])
        if size:
            self._close(top[find(0)], None, -1)

    def _merge(self, x: int, y: int, depth: int) -> int:
        """The node at ``depth`` over the components of x and y."""
        if self.depth[x] > depth:
            branch = self._branch(self.sequence[x], depth)
            self._close(x, branch, depth)
        else:
            branch = x
        if self.depth[y] > depth:
            self._close(y, branch, depth)
        else:
            self._add(branch, y, self.saved[y], self.children[y])
            self.same[y] = branch
        return branch

    def _branch(self, sequence: int, depth: int) -> int:
        for values, value in (
            (self.depth, depth), (self.sequence, sequence), (self.n, 0), (self.low, None), (self.ends, ""), (self.leaves, 0),
            (self.saved, 0), (self.children, 0), (self.first, False), (self.last, False), (self.same, len(self.same)),
        ):
            values.append(value)
        return len(self.depth) - 1

    def _add(self, node: int, part: int, saved: int, children: int) -> None:
        self.n[node] += self.n[part]
        self.low[node] = self.low[part] if self.low[node] is None else min(self.low[node], self.low[part])
        self.leaves[node] += self.leaves[part]
        self.saved[node] += saved
        self.children[node] += children
        self.first[node] |= self.first[part]
        self.last[node] |= self.last[part]

    def _close(self, x: int, parent: int | None, above: int) -> None:
        """List x and the unbranched nodes between it and its parent, which gets x's figures."""
        words, n, low = self.words[self.sequence[x]], self.n[x], self.low[x]
        saved, children, ends = self.saved[x], self.children[x], self.ends[x]
        for depth in range(self.depth[x], above, -1):
            known = self.first[x] and depth <= self.before  # begun in an earlier block
            part = known or (self.last[x] and depth <= self.after)
            w = int(words[depth - 1]) if depth else 0
            saved += n * w - (0 if known else w)
            # The parent of the topmost is looked up at the end.
            self.rows.append((x if depth > above + 1 else parent, part, x, depth, low, n, children, self.leaves[x], saved, ends))
            children, ends = int(not known), ""
        if parent is not None:
            self._add(parent, x, saved, children)

    def nodes(self, block: int) -> list[tuple]:
        """The rows of the block's nodes, with the digests of prefixes where a neighbouring block may know more."""
        out, prefixes = [], {}

        def prefix(sequence: int, depth: int) -> str:
            # Nodes of one path ask for few depths: those next to the borders' paths.
            name = (sequence, depth) if depth else (0, 0)
            if name not in prefixes:
                prefixes[name] = hashlib.md5(self.keys[sequence][: DIGEST * depth]).hexdigest()
            return prefixes[name]

        for parent, part, x, depth, low, n, children, leaves, saved, ends in self.rows:
            upper, upper_low, open_parent = None, None, False
            if parent is not None:
                while self.same[parent] != parent:
                    parent = self.same[parent]
                upper_low = self.low[parent]
                open_parent = (self.first[parent] and depth - 1 <= self.before) or (self.last[parent] and depth - 1 <= self.after)
                upper = prefix(self.sequence[x], depth - 1) if open_parent else None
            kind = PART if part else AWAITS_PARENT if open_parent else FINAL
            own = prefix(self.sequence[x], depth) if part else None
            out.append((kind, block, own, upper, low, depth, upper_low if not open_parent else None, n, children, leaves, saved, ends))
        return out


_SCHEMA = f"kind int, block long, own string, upper string, {NODE}"
_NODE_COLUMNS = [c.split()[0] for c in NODE.split(", ")]
_COLUMNS = ["kind", "block", "own", "upper", *_NODE_COLUMNS]


def _borders(ordered: DataFrame) -> dict[int, tuple[int, int]]:
    """For each range partition the turns shared with the sequences before and behind it; as many entries as partitions."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, rows = None, []
        for batch in batches:
            for pid, low, high in zip(batch["pid"].tolist(), batch["low"], batch["high"]):
                common = -1 if last is None else shared_turns(last, low)
                if rows:
                    rows[-1] = (*rows[-1][:2], common)
                rows.append((pid, common, -1))
                last = high
        yield pd.DataFrame(rows, columns=["pid", "before", "after"])

    ends = ordered.groupBy("pid").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    found = ends.coalesce(1).sortWithinPartitions("pid").mapInPandas(compare, "pid int, before int, after int").collect()
    return {r["pid"]: (r["before"], r["after"]) for r in found}


def _blocks(borders: dict[int, tuple[int, int]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        turns, before, pid, number = 0, -1, None, 0

        def built(after: int) -> pd.DataFrame:
            keys, words, n, low, ends = zip(*held)
            rows = Forest(keys, words, n, low, ends, before, after).nodes((pid << 32) + number)
            out = pd.DataFrame(rows, columns=_COLUMNS)
            return out.astype({"parent_conv_id": "Int64"})

        for batch in batches:
            for place, key, words, n, low, ends in zip(
                batch["pid"].tolist(), batch["key"], batch["words"], batch["n"].tolist(), batch["low"].tolist(), batch["ends"]
            ):
                if pid is None:
                    pid, before = place, borders[place][0]
                if len(held) >= BLOCK or (held and turns + len(words) > BLOCK_TURNS):
                    common = shared_turns(held[-1][0], key)
                    yield built(common)
                    held, turns, before, number = [], 0, common, number + 1
                held.append((bytes(key), words, n, low, ends))
                turns += len(words)
        if held:
            yield built(borders[pid][1])

    return run


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of ``conversations`` (conv_id, turns as of ``conversations_of``): one row per distinct prefix.

    conv_id: smallest member; depth; parent_conv_id: its parent's conv_id (root: null); n_convs: members; n_children; n_leaves: childless nodes of
    its subtree, itself included; saved_tokens: the subtree's sum of (n_convs - 1) x words of a node's last turn; ends_sha256: digest of the
    ids of the members that end there.  Equal conversations are one path however many they are; a conversation without turns ends at the root; no
    conversations, no rows.  conv_id must be unique.  A conversation travels as digests, 16 bytes a turn in one row.
    """
    ship(conversations.sparkSession)
    found = sequences(conversations)
    ordered = found.repartitionByRange("key").sortWithinPartitions("key").withColumn("pid", F.spark_partition_id())
    ordered = durable(ordered)
    nodes = durable(ordered.select("pid", "key", "words", "n", "low", "ends").mapInPandas(_blocks(_borders(ordered)), _SCHEMA))
    final = nodes.filter(F.col("kind") == FINAL).select(*_NODE_COLUMNS)
    parts = nodes.filter(F.col("kind") == PART)
    # A few rows per block: the nodes on its two border paths.
    merged = durable(
        parts.groupBy("own").agg(
            F.max("upper").alias("upper"),
            F.min("conv_id").alias("conv_id"),
            F.max("depth").alias("depth"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
            F.max("ends_sha256").alias("ends_sha256"),
        )
    )
    lows = merged.select(F.col("own").alias("upper"), F.col("conv_id").alias("parent_conv_id"))
    spine = merged.join(lows, "upper", "left").select(*_NODE_COLUMNS)
    # Children meet their parent by block, so that a parent of very many children is no hot key.
    known = parts.select("block", F.col("own").alias("upper")).join(lows, "upper")
    rest = nodes.filter(F.col("kind") == AWAITS_PARENT).drop("parent_conv_id").join(known, ["block", "upper"]).select(*_NODE_COLUMNS)
    ends = F.when(F.col("ends_sha256") == "", EMPTY_SHA256).otherwise(F.col("ends_sha256"))
    return final.unionByName(spine).unionByName(rest).withColumn("ends_sha256", ends)


def rebuilt_trie(turns: DataFrame) -> DataFrame:
    """The trie of ``turns`` (conv_id, turn, role, text), each conversation begun with turns of its family's first one."""
    ship(turns.sparkSession)
    return trie(rebuilt(durable(conversations_of(turns))))
