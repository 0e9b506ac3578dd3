"""Near-duplicate texts by order MinHash, verified by banded alignment.

A text is its lower-cased words; a k-mer is five words together with the number of its
occurrence.  Each of ``SEEDS`` hash functions picks a text's smallest k-mers, and the sketch keeps them
in the order of the text, so it is equal for texts of small edit distance and differs when
passages are moved.  Sketches of 2, 4 and 8 k-mers are made: the short ones catch distant
copies, the long ones still divide texts that share a passage with very many others.

Copies are one node from the start.  Inside a bucket of equal sketches every node is compared with the
bucket's smallest node, and in buckets of up to ``SMALL`` nodes all pairs are.  A pair links if the alignment of
its words keeps a similarity of 0.8 or more; classes are the links' components.

Crowds are larger buckets whose nodes fell in several classes.  Their nodes are compared with ``STARS`` more
nodes of the crowd, and get further sketches, of ``CROWD_SEEDS`` seeds, over the k-mers that a crowd does not share.  All
that is linear in the nodes.  In crowds that are still divided all pairs of nodes of different classes are compared: by bits
for the words and word pairs they hold, blocks of nodes against blocks.  Nodes that these leave a partner bring their words
to the block, where the pairs are compared by all their words and the rest of them aligned, so what moves are nodes and links,
never a row for each pair.  No two texts of one bucket that align stay in different classes.  The comparing is
quadratic in a divided crowd, a few numbers for each two nodes, and so are the alignments of pairs near the threshold.  With ``exact`` crowds are resolved by a prefix filter
instead, which also finds pairs of different buckets: texts that align have so many word pairs in common that their rarest
ones must meet, so all texts of different classes that share one are aligned; that costs a comparison for each two of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import durable, fresh, keeps, row_key, ship, turn_to
from .components import connected, few, sized

K = 5
SEEDS = 16
TAKES = (2, 4, 8)
SIMILARITY = 0.8
SMALL = 8
#: Further nodes of a crowd that all its others are compared with; seeds and k-mers taken of the further sketches.
STARS, CROWD_SEEDS, CROWD_TAKES = 2, 32, (1, 2)
#: Counters for the k-mers of texts in crowds (4 MB as bits, 16 MB in a task that counts); one of more than SMALL texts, over what chance puts there, is shared.
COUNTERS = 1 << 22
#: Nodes of a crowd in a block, about; blocks are compared two at a time, some rows of one with all of the other.
BLOCK, ROWS_TOGETHER = 2_048, 256
#: Bits for the words of a text, and as many for its word pairs; numbers for the words where they are compared in full.
BITS, NUMBERS = 1_024, 1 << 16
#: Texts of crowds in a partition at least.
TEXTS_TOGETHER = 2_000
#: Texts from whose word pairs the rarity is judged, and frequent pairs kept of them; they set the order only, not what is found.
RARITY_TEXTS, RARITY_PAIRS = 20_000, 500_000
#: Parts of a class in the list of texts that share a word pair.
LIST_PARTS = 16
#: Rows that a worker turns into results at a time, so that its memory doesn't follow the batch.
SLICE = 500
#: Words whose hash a worker remembers before it starts anew.
KNOWN_WORDS = 150_000

WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_known: dict[str, int] = {}
keeps("minhash", _known.clear)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with good avalanche."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_codes(text: str | None) -> np.ndarray:
    """64-bit codes of the text's words; equal words, equal codes."""
    import xxhash

    words = WORD.findall(text.lower()) if text else []
    if len(_known) > KNOWN_WORDS:
        _known.clear()
    for word in set(words).difference(_known):
        _known[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
    return np.fromiter(map(_known.__getitem__, words), dtype=np.uint64, count=len(words))


def node_of(codes: np.ndarray) -> int:
    """A signed 64-bit name for a sequence of words (equal names for different texts: 1 in 10^9 at 10^5 million texts)."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(codes.tobytes())).astype(np.int64))


def kmers(codes: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the k-mers with their occurrence numbers, in the order of the text; short texts are one k-mer."""
    width = min(k, len(codes))
    hashed = np.zeros(len(codes) - width + 1, dtype=np.uint64)
    for i in range(width):
        hashed = _mix(hashed * _MIX + codes[i : len(codes) - width + 1 + i])
    order = np.argsort(hashed, kind="stable")
    ordered = hashed[order]
    first = np.r_[True, ordered[1:] != ordered[:-1]]
    if first.all():
        return hashed
    run_start = np.maximum.accumulate(np.where(first, np.arange(len(ordered)), 0))
    occurrence = np.empty(len(ordered), dtype=np.uint64)
    occurrence[order] = (np.arange(len(ordered)) - run_start).astype(np.uint64)
    # A first occurrence keeps its hash, whether or not the text repeats anything.
    return np.where(occurrence == 0, hashed, _mix(hashed + occurrence * _MIX))


def sketches(codes: np.ndarray) -> np.ndarray:
    """One key for each seed and number of k-mers taken; equal keys mean the same k-mers in the same order."""
    return _keys(kmers(codes), SEEDS, TAKES) if len(codes) else np.empty(0, dtype=np.int64)


def _keys(found: np.ndarray, seeds: int, takes: tuple[int, ...]) -> np.ndarray:
    """Sketches of a text's k-mers, which are hashes already: a seed orders them by one odd multiplier."""
    most = max(takes)
    salts = _mix(np.arange(1, seeds + 1, dtype=np.uint64) * _MIX)[:, None]
    ranks = (found[None, :] ^ salts) * (salts | np.uint64(1))
    if ranks.shape[1] > most:
        near = np.argpartition(ranks, most - 1, axis=1)[:, :most]
    else:
        near = np.tile(np.arange(ranks.shape[1]), (seeds, 1))
    near = np.take_along_axis(near, np.argsort(np.take_along_axis(ranks, near, 1), axis=1), 1)
    keys = []
    for take in takes:
        placed = np.sort(near[:, :take], axis=1)
        key = salts[:, 0] + np.uint64(take)
        for column in placed.T:
            key = _mix(key * _MIX + found[column])
        keys.append(key)
    return np.concatenate(keys).view(np.int64)


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Word edits between ``a`` and ``b``, or None if there are more than ``most``.

    Only cells within a band around the diagonal are computed, as bits of one integer per row of
    the band; the band is widened from a few words, or as many as must be edits, to ``most`` until the distance lies inside.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return None
    same = a == b[: len(a)]
    head = len(a) if same.all() else int(np.argmin(same))
    a, b = a[head:], b[head:]
    if len(a):
        same = a[::-1] == b[::-1][: len(a)]
        tail = len(a) if same.all() else int(np.argmin(same))
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a):
        return len(b) if len(b) <= most else None
    # Words that one text has more often than the other are edits at least, so narrower bands find nothing.
    number = np.unique(np.concatenate([a, b]), return_inverse=True)[1]
    more = np.bincount(number[: len(a)], minlength=len(a) + len(b)) - np.bincount(number[len(a) :], minlength=len(a) + len(b))
    least = int(max(more[more > 0].sum(), -more[more < 0].sum()))
    if least > most:
        return None
    codes: dict[int, int] = {}
    for place, code in enumerate(a.tolist()):
        codes[code] = codes.get(code, 0) | 1 << place
    b = b.tolist()
    band = max(8, len(b) - len(a), least)
    while True:
        band = most if 2 * band > most else band
        found = _banded(codes, len(a), b, band)
        if found <= band:
            return found
        if band == most:
            return None
        band *= 4


def _banded(codes: dict[int, int], rows: int, b: list[int], band: int) -> int:
    """The distance if it is at most ``band``, else some number above it.

    Column j covers rows j - band to j + band.  ``up`` and ``down`` hold, for each of those rows,
    whether the cell is one more or one less than the cell above; stepping to the next column
    shifts the window by a row.  The value is followed along the window's lowest diagonal to the last
    row, then along the last row.
    """
    width = 2 * band + 1
    full = (1 << width) - 1
    # Rows above the first are taken as growing upwards, so that no path gains by leaving the table.
    up, down = full & ~((1 << band) - 1), 0
    value = min(band, rows)
    for j, code in enumerate(b):
        low = j - band  # the row of bit 0
        match = codes.get(code, 0)
        match = (match >> low if low >= 0 else match << -low) & full
        diagonal = ((((match & up) + up) ^ up) | match | down) & full
        more = (down | ~(diagonal | up)) & full
        less = diagonal & up
        last = rows - 1 - low
        if last >= width - 1:
            value += not diagonal >> (width - 1) & 1
        else:
            value += (more >> last & 1) - (less >> last & 1)
        shifted = diagonal >> 1
        up = (less | ~(shifted | more)) & full
        down = shifted & more
    return value


def similar(a: bytes, b: bytes, similarity: float = SIMILARITY) -> bool:
    x, y = np.frombuffer(a, dtype=np.uint32), np.frombuffer(b, dtype=np.uint32)
    longest = max(len(x), len(y))
    return edit_distance(x, y, int(longest * (1 - similarity) + 1e-9)) is not None


def prefix_length(n_words: int) -> int:
    """Word pairs of a text, the first in a common order, one of which every similar text has among its own first ones.

    An edit changes at most two word pairs, so texts of at most m words keep m - 1 - 2 * edits of them in common.
    """
    kept = min(m - 1 - 2 * int(m * (1 - SIMILARITY) + 1e-9) for m in range(n_words, n_words + K))
    return n_words - kept


def _sketched(docs: DataFrame) -> DataFrame:
    """(key, node, n_words, keys, codes) of each row; codes are the low halves of the words' codes, enough to align two texts that share a sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("minhash")
        types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                some, rows = batch.slice(at, SLICE), []
                for text in some["text"].to_pylist():
                    codes = word_codes(text)
                    rows.append((node_of(codes), len(codes), sketches(codes), codes.astype(np.uint32).tobytes()))
                columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([some["key"], *columns], names=["key", "node", "n_words", "keys", "codes"])

    return docs.select("key", "text").mapInArrow(run, "key string, node long, n_words int, keys array<long>, codes binary")


def _slices(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    return (batch.iloc[at : at + SLICE] for at in range(0, len(batch), SLICE))


def candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, v) pairs of ``nodes`` (node, n, keys) that share a sketch, in numbers that grow with the nodes alone, and (bucket, node, n) of crowds."""
    member = durable(nodes.select("node", "n", F.explode("keys").alias("bucket")))
    crowd = member.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("low"), F.max(F.struct("node", "n")).alias("high"), F.count("*").alias("size"))
    crowd = durable(crowd.filter("size > 1"))
    crowd = few(crowd, crowd.count())
    two = crowd.filter("size = 2").select(
        F.col("low.node").alias("u"), F.col("high.node").alias("v"), F.col("low.n").alias("nu"), F.col("high.n").alias("nv")
    )
    more = durable(member.join(crowd.filter("size > 2"), "bucket"))
    more_rows = more.count()
    more = few(more, more_rows)
    star = more.filter("node <> low.node").select(
        F.col("low.node").alias("u"), F.col("node").alias("v"), F.col("low.n").alias("nu"), F.col("n").alias("nv")
    )
    # At most SMALL members each.
    small = more.filter(F.col("size") <= SMALL).groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("node", "n"))).alias("m"))
    first = small.select("m", F.posexplode("m").alias("i", "a"))
    pairs = first.select("a", F.explode(F.slice("m", F.col("i") + 2, F.lit(SMALL))).alias("b")).select(
        F.col("a.node").alias("u"), F.col("b.node").alias("v"), F.col("a.n").alias("nu"), F.col("b.n").alias("nv")
    )
    both = two.unionByName(star).unionByName(pairs)
    return few(both.filter(_near()).select("u", "v"), more_rows).distinct(), more.filter(F.col("size") > SMALL).select("bucket", "node", "n")


def _near():
    """Lengths nu and nv that similar texts can have."""
    return F.least("nu", "nv") >= SIMILARITY * F.greatest("nu", "nv") - 1e-9


def unresolved(crowds: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, node, n, root) of the nodes in crowds whose nodes aren't all of one class."""
    rooted = crowds.join(roots, "node", "left").select("bucket", "node", "n", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    return durable(rooted.join(mixed, "bucket", "left_semi"))


def star_pairs(open_nodes: DataFrame, number: int) -> DataFrame:
    """(u, v): of every crowd one node, another one for each ``number``, with all nodes of other classes."""
    drawn = F.min(F.struct(F.xxhash64("node", F.lit(number)), F.col("node").alias("node"), F.col("n").alias("n"), F.col("root").alias("root")))
    met = open_nodes.join(open_nodes.groupBy("bucket").agg(drawn.alias("low")), "bucket").filter("root <> low.root")
    u, v = F.least("node", "low.node"), F.greatest("node", "low.node")
    pairs = met.select(u.alias("u"), v.alias("v"), F.col("n").alias("nu"), F.col("low.n").alias("nv"))
    return pairs.filter(_near()).select("u", "v").distinct()


def own_sketches(texts: DataFrame) -> DataFrame:
    """(node, n, keys) of ``texts`` (node, codes) from the k-mers that are in few of them."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        times = np.zeros(COUNTERS, dtype=np.int32)
        for batch in batches:
            for codes in batch["codes"]:
                times[_counter(kmers(np.frombuffer(codes, np.uint32).astype(np.uint64)))] += 1
        for at in range(0, COUNTERS, COUNTERS // 64):
            some = times[at : at + COUNTERS // 64]
            held = np.flatnonzero(some)
            yield pd.DataFrame({"counter": (at + held).astype(np.int32), "n": some[held].astype(np.int64)})

    counts = durable(texts.select("codes").mapInPandas(counted, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = counts.filter(F.col("n") > SMALL + 4 * total // COUNTERS).select("counter").toPandas()["counter"].to_numpy()
    shared = np.zeros(COUNTERS, dtype=bool)
    shared[often] = True
    table = texts.sparkSession.sparkContext.broadcast(np.packbits(shared))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = np.unpackbits(table.value).astype(bool)
        for batch in batches:
            for some in _slices(batch):
                rows = []
                for node, codes in zip(some["node"], some["codes"]):
                    found = kmers(np.frombuffer(codes, np.uint32).astype(np.uint64))
                    own = found[~known[_counter(found)]]
                    if len(own):
                        rows.append((node, len(codes) // 4, _keys(own, CROWD_SEEDS, CROWD_TAKES)))
                yield pd.DataFrame(rows, columns=["node", "n", "keys"])

    return texts.select("node", "codes").mapInPandas(run, "node long, n int, keys array<long>")


def _counter(found: np.ndarray) -> np.ndarray:
    return (_mix(found ^ _MIX) % np.uint64(COUNTERS)).astype(np.int64)


def _bits(codes: np.ndarray) -> bytes:
    """Which of BITS numbers the words of a text have, and which its word pairs; repeats count as others."""
    held = np.zeros(2 * BITS, dtype=bool)
    for half, k in enumerate((1, 2)):
        held[half * BITS + (_mix(kmers(codes, k) ^ _MIX) % np.uint64(BITS)).astype(np.int64)] = True
    return np.packbits(held).tobytes()


def not_ruled_out(left: np.ndarray, right: np.ndarray, nl: np.ndarray, nr: np.ndarray) -> np.ndarray:
    """Whether texts with these bits and lengths may align, for each row of ``left`` with each of ``right``.

    An edit takes one word and at most two word pairs out of a text, so of the numbers that a similar text lacks there are no
    more than its edits, or twice as many.
    """
    longest = np.maximum(nl[:, None], nr[None, :])
    most = (longest * (1 - SIMILARITY) + 1e-9).astype(np.int64)
    fine = np.minimum(nl[:, None], nr[None, :]) >= SIMILARITY * longest - 1e-9
    for half in (0, 1):
        a, b = (x[:, half * BITS : (half + 1) * BITS].astype(np.float32) for x in (left, right))
        both = a @ b.T
        lacking = np.maximum(a.sum(axis=1)[:, None], b.sum(axis=1)[None, :]) - both
        fine &= lacking <= most * (half + 1)
    return fine


def _members(bucket: int, node: pa.Array, n: pa.Array, root: pa.Array, bits: pa.Array, buckets: pa.Array) -> tuple:
    """Members of a crowd as arrays: node, n, root, bits, and of each the crowds before this one."""
    held = np.unpackbits(np.frombuffer(b"".join(bits.to_pylist()), np.uint8).reshape(len(node), -1), axis=1)
    before = [{other for other in some if other < bucket} for some in buckets.to_pylist()]
    return node.to_numpy(), n.to_numpy(), root.to_numpy(), held, before


def _met(members: tuple, left: np.ndarray, right: np.ndarray, one_block: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the members of ``left`` and ``right`` that are to be aligned: of different classes, not ruled out, in no crowd before this one together."""
    node, n, root, held, before = members
    fine = not_ruled_out(held[left], held[right], n[left], n[right]) & (root[left][:, None] != root[right][None, :])
    if one_block:
        fine &= node[left][:, None] < node[right][None, :]
    a, b = np.nonzero(fine)
    a, b = left[a], right[b]
    first = np.fromiter((before[x].isdisjoint(before[y]) for x, y in zip(a.tolist(), b.tolist())), bool, len(a))
    return a[first], b[first]


def words_allow(codes: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the words of the texts at places ``a`` (ascending) and ``b`` of ``codes`` let them align; repeats count as other words.

    As with the bits, but with so many numbers that hardly any two words have the same.
    """
    if not len(a):
        return np.zeros(0, dtype=bool)
    numbers = {x: np.unique(_mix(kmers(codes[x].astype(np.uint64), 1) ^ _MIX) % np.uint64(NUMBERS)).astype(np.int64) for x in {*a.tolist(), *b.tolist()}}
    right, at = np.unique(b, return_inverse=True)
    sizes = np.array([len(numbers[x]) for x in right.tolist()])
    listed, starts = np.concatenate([numbers[x] for x in right.tolist()]), np.cumsum(sizes) - sizes
    lengths = np.array([len(c) for c in codes])
    marked = np.zeros(NUMBERS, dtype=np.int32)
    left, begins = np.unique(a, return_index=True)
    fine = []
    for x, begin, end in zip(left.tolist(), begins, [*begins[1:], len(a)]):
        marked[numbers[x]] = 1
        both = np.add.reduceat(marked[listed], starts)
        marked[numbers[x]] = 0
        lacking = np.maximum(len(numbers[x]), sizes) - both
        most = (np.maximum(len(codes[x]), lengths[right]) * (1 - SIMILARITY) + 1e-9).astype(np.int64)
        fine.append((lacking <= most)[at[begin:end]])
    return np.concatenate(fine)


def rest_links(open_nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v): all pairs of one crowd and different classes in ``open_nodes`` (bucket, node, n, root) that align; ``texts`` has (node, codes).

    Blocks are compared by bits first, some rows of one with all of the other.  Of each such unit only the members that have a
    partner left come again with their words, and are aligned there.
    """

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for some in _slices(batch):
                bits = [_bits(np.frombuffer(c, np.uint32).astype(np.uint64)) for c in some["codes"]]
                yield pd.DataFrame({"node": some["node"], "bits": bits})

    told = open_nodes.groupBy("node").agg(F.first("n").alias("n"), F.first("root").alias("root"), F.collect_set("bucket").alias("buckets"))
    told = durable(told.join(texts.select("node", "codes").mapInPandas(described, "node long, bits binary"), "node"))
    # A node of a crowd meets every block of it, its own too.
    sizes = open_nodes.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = open_nodes.select("bucket", "node").join(sizes, "bucket").withColumn("own", own).join(told, "node")
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    groups = met.groupBy("bucket", "i", "j").agg(F.collect_list(F.struct("own", "node", "n", "root", "bits", "buckets")).alias("m"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, i, j, listed in zip(batch["bucket"].to_pylist(), batch["i"].to_pylist(), batch["j"].to_pylist(), batch["m"]):
                own, *columns = listed.values.flatten()
                own, members = own.to_numpy(), _members(bucket, *columns)
                low, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
                for at in range(0, len(low), ROWS_TOGETHER):
                    a, b = _met(members, low[at : at + ROWS_TOGETHER], right, i == j)
                    if len(a):
                        some = np.union1d(a, b)
                        sides = pa.array(members[0][some]), pa.array(np.isin(some, a)), pa.array(np.isin(some, b))
                        unit = [pa.array([x] * len(some), t) for x, t in ((bucket, pa.int64()), (i, pa.int32()), (j, pa.int32()), (at, pa.int32()))]
                        yield pa.RecordBatch.from_arrays([*unit, *sides], names=["bucket", "i", "j", "at", "node", "is_left", "is_right"])

    name = ["bucket", "i", "j", "at"]
    units = durable(groups.mapInArrow(compared, "bucket long, i int, j int, at int, node long, is_left boolean, is_right boolean"))
    # Aligning takes long for few bytes, so units are dealt by their number.
    parts = min(units.select(name).distinct().count(), int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def aligned(unit: pa.Table) -> pa.Table:
        unit = unit.combine_chunks()
        column = {c: unit[c].combine_chunks() for c in unit.column_names}
        bucket, i, j = (column[c][0].as_py() for c in ("bucket", "i", "j"))
        members = _members(bucket, *(column[c] for c in ("node", "n", "root", "bits", "buckets")))
        codes = [np.frombuffer(c, np.uint32) for c in column["codes"].to_pylist()]
        left, right = (np.flatnonzero(column[c].to_numpy(zero_copy_only=False)) for c in ("is_left", "is_right"))
        a, b = _met(members, left, right, i == j)
        fine = words_allow(codes, a, b)
        a, b = a[fine], b[fine]
        links = np.fromiter((similar(codes[x], codes[y]) for x, y in zip(a.tolist(), b.tolist())), bool, len(a))
        u, v = members[0][a[links]], members[0][b[links]]
        return pa.table({"u": np.minimum(u, v), "v": np.maximum(u, v)})

    whole = units.join(told, "node").join(texts.select("node", "codes"), "node").repartition(max(1, parts), *name)
    return whole.groupBy(*name).applyInArrow(aligned, "u long, v long")


def crowd_pairs(nodes: DataFrame, codes: DataFrame) -> DataFrame:
    """(u, v) pairs of ``nodes`` (node, root) of different roots that may be similar; no similar pair of them is left out."""
    texts = durable(nodes.join(codes, "node"))
    held = texts.count()

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for some in _slices(batch):
                found = [kmers(np.frombuffer(c, dtype=np.uint32).astype(np.uint64), 2) for c in some["codes"] if len(c) >= 4 * K]
                if found:
                    tokens, counts = np.unique(np.concatenate(found), return_counts=True)
                    yield pd.DataFrame({"token": tokens.view(np.int64), "n": counts})

    share = F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, RARITY_TEXTS / max(held, 1)))
    often = texts.filter(share).select("codes").mapInPandas(counted, "token long, n long")
    often = often.groupBy("token").agg(F.sum("n").alias("n")).filter("n > 1").orderBy(F.desc("n"), "token").limit(RARITY_PAIRS).toPandas()
    often = often.sort_values("token")
    tokens, counts = often["token"].to_numpy(np.int64), often["n"].to_numpy(np.int64)
    table = nodes.sparkSession.sparkContext.broadcast((tokens, counts))

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, times = table.value
        for batch in batches:
            for some in _slices(batch):
                out = []
                for node, root, code in zip(some["node"], some["root"], some["codes"]):
                    words = np.frombuffer(code, dtype=np.uint32).astype(np.uint64)
                    if len(words) < K:
                        continue  # too short for any edit
                    found = kmers(words, 2).view(np.int64)
                    rank = np.zeros(len(found), dtype=np.int64)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                        rank = np.where(known[at] == found, times[at], 0)
                    first = found[np.lexsort((found, rank))[: prefix_length(len(words))]]
                    out.append(pd.DataFrame({"token": first, "node": node, "root": root, "n": len(words)}))
                if out:
                    yield pd.concat(out, ignore_index=True)

    listed = texts.mapInPandas(prefixes, "token long, node long, root long, n int")
    # Texts of one class are never paired, so its part of a list is one value.
    part = F.pmod("node", F.lit(LIST_PARTS)).alias("part")
    lists = listed.repartition("token").groupBy("token", "root", part).agg(F.collect_list(F.struct("node", "n")).alias("m"))
    left = lists.select("token", F.col("root").alias("ru"), F.col("m").alias("mu"))
    right = lists.select("token", F.col("root").alias("rv"), F.col("m").alias("mv"))
    met = left.join(right.hint("shuffle_merge"), "token").filter("ru < rv").select(F.explode("mu").alias("a"), "mv").select("a", F.explode("mv").alias("b"))
    u, v = F.least("a.node", "b.node"), F.greatest("a.node", "b.node")
    pairs = met.select(u.alias("u"), v.alias("v"), F.col("a.n").alias("nu"), F.col("b.n").alias("nv"))
    return pairs.filter(_near()).select("u", "v").distinct()


def verified(pairs: DataFrame, codes: DataFrame) -> DataFrame:
    """The pairs (u, v) whose words align with SIMILARITY or more; ``codes`` has (node, codes)."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = [similar(a.as_py(), b.as_py()) for a, b in zip(batch["cu"], batch["cv"])]
            yield batch.select(["u", "v"]).filter(pa.array(links, pa.bool_()))

    left = codes.select(F.col("node").alias("u"), F.col("codes").alias("cu"))
    right = codes.select(F.col("node").alias("v"), F.col("codes").alias("cv"))
    return pairs.join(right, "v").join(left, "u").select("u", "v", "cu", "cv").mapInArrow(check, "u long, v long")


def joined_classes(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) after further links, which may name nodes that have no root yet."""
    ru = roots.select(F.col("node").alias("u"), F.col("root").alias("ru"))
    rv = roots.select(F.col("node").alias("v"), F.col("root").alias("rv"))
    edges = links.join(ru, "u", "left").join(rv, "v", "left").select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))
    step = connected(sized(edges)).select(F.col("node").alias("root"), F.col("root").alias("top"))
    old = roots.join(step, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    new = links.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(roots, "node", "left_anti")
    new = new.join(step.withColumnRenamed("root", "node"), "node").select("node", F.col("top").alias("root"))
    return sized(old.unionByName(new))


def resolve_crowds(crowds: DataFrame, roots: DataFrame, links: DataFrame, codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and roots after comparing the nodes of crowds that are divided: with more stars, by sketches of what is a text's own, and then all."""
    open_nodes = unresolved(crowds, roots)
    if not (held := open_nodes.count()):
        return links, roots
    open_nodes = few(open_nodes, held)
    rooted = durable(few(open_nodes.select("node", "root").distinct(), held))
    n_texts = rooted.count()
    texts = durable(rooted.select("node").join(codes, "node").coalesce(max(1, -(-n_texts // TEXTS_TOGETHER))))
    pairs, _ = candidates(own_sketches(texts))
    ru, rv = rooted.toDF("u", "ru"), rooted.toDF("v", "rv")
    pairs = few(few(pairs.join(ru, "u"), held).join(rv, "v").filter("ru <> rv").select("u", "v"), held)
    for number in range(1, STARS + 1):
        pairs = pairs.unionByName(star_pairs(open_nodes, number))
    found = durable(verified(few(pairs, held).distinct(), texts))
    links, roots = links.unionByName(found), joined_classes(roots, found)
    # What is divided even then: all pairs.
    open_nodes = unresolved(crowds, roots)
    if not (held := open_nodes.count()):
        return links, roots
    found = durable(rest_links(few(open_nodes, held), texts))
    return links.unionByName(found), joined_classes(roots, found)


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", exact: bool = False) -> DataFrame:
    """(key, doc_id, node, root, n_words, n_links) per row; rows of equal ``root`` are one class."""
    ship(docs.sparkSession)
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    keyed = plain.select(row_key().alias("key"), "doc_id", "text")
    sketched = durable(_sketched(keyed))
    full = sketched.filter("n_words > 0")
    pairs, crowds = candidates(full.groupBy("node").agg(F.first("n_words").alias("n"), F.first("keys").alias("keys")))
    pairs = durable(pairs)
    pairs = few(pairs, pairs.count())
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).unionByName(crowds.select("node")).distinct()
    # One row stands for all copies of a node, so that no node's words are moved twice.
    chosen = full.groupBy("node").agg(F.min("key").alias("key")).join(wanted, "node")
    codes = durable(sketched.select("key", "codes").join(chosen, "key").dropDuplicates(["node"]).select("node", "codes"))
    links = durable(verified(pairs, codes))
    links = few(links, links.count())
    roots = connected(links)
    if exact:
        open_nodes = unresolved(crowds, roots).select("node", "root").distinct()
        if not open_nodes.isEmpty():
            more = durable(crowd_pairs(open_nodes, codes).join(pairs, ["u", "v"], "left_anti"))
            links = durable(links.unionByName(verified(more, codes)))
            roots = connected(links)
    else:
        links, roots = resolve_crowds(crowds, roots, links, codes)
    links = links.distinct()
    degree = links.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    found = roots.join(degree, "node", "left")
    ids = durable(sketched.select("key", "node", "n_words")).join(found, "node", "left")
    ids = ids.select("key", "node", F.coalesce("root", "node").alias("root"), "n_words", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return keyed.select("doc_id", "key").join(ids.dropDuplicates(["key"]), "key")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", exact: bool = False) -> DataFrame:
    """One row per document row: doc_id, class_id (the smallest id of its class), kept, n_links.

    Texts of one bucket that align are in one class.  ``exact`` resolves crowds by the prefix filter, which leaves no similar pair of them out,
    whatever their buckets, but compares all that share a rare word pair.  ``n_links`` counts verified links of the row's text to other texts;
    in a crowd texts that are of one class already aren't compared again.  A row is kept if it has the smallest id of its
    class.  Texts without words, null ones too, resemble nothing and are classes of their own row.
    Null ids sort last, so a class of null ids only has a null class_id.  Repeated rows fall in one class.
    """
    found = classes(docs, doc_id, text, exact)
    group = F.when(F.col("n_words") > 0, F.col("root").cast("string")).otherwise(F.col("key"))
    rows = found.select("doc_id", "n_links", group.alias("group"))
    least = rows.groupBy("group").agg(F.min("doc_id").alias("class_id"))
    return rows.join(least, "group").select(
        "doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), F.col("n_links").cast("long").alias("n_links")
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class of ``docs``, all its columns: that of the smallest id, then of the smallest text digest.

    Rows without words stay; of rows that repeat id and text, one stays.
    """
    found = classes(docs, doc_id, text)
    # A class is a handful of narrow rows per task after partial sums, whatever its size.
    best = found.filter("n_words > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("best"))
    chosen = best.select(F.col("best.key").alias("key"), F.lit(True).alias("stays"))
    names = [fresh(docs, f"decision_{n}") for n in ("key", "words", "stays", "row")]
    key, n_words, stays, row = names
    decided = found.select("key", "n_words").dropDuplicates(["key"]).join(chosen, "key", "left")
    decided = decided.filter("n_words = 0 or stays").select(F.col("key").alias(key), F.col("n_words").alias(n_words), F.col("stays").alias(stays))
    digest = row_key(doc_id, text)
    rows = docs.withColumn(key, digest).join(decided, key)
    # Rows without words are never copies of each other, so each counts as different.
    rows = rows.withColumn(row, F.when(F.col(n_words) == 0, F.monotonically_increasing_id()))
    return rows.dropDuplicates([key, row]).select(*docs.columns)
