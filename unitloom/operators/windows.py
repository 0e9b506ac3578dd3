"""Fixed-length windows over the unit stream of each shard.

The stream order is (shard, document, position).  Positions come from document-level
counts: the running sum over documents is a narrow table, so the wide unit rows are
never sorted by shard and a shard holding a third of the corpus is no special case.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import coin, id_hash
from ..session import durable, ship
from .ordered import join_checked, one_row, prefix_scan, ranked, smallest
from .runs import TOGETHER, Group, dealt_lists, gathered, kinds, lists_of, named_columns, text_of, units_of, whole_bytes
from .segment import PATTERNS, explode_units, unit_array


#: Document rows of a layout that are broadcast at most (about 30 MB).
LAYOUT_ROWS = 300_000


def document_layout(counts: DataFrame, size: int) -> DataFrame:
    """(shard, doc_id, n_units, start, shard_units, first_window) from units per document.

    ``start`` is the document's first position in its shard; ``first_window`` numbers
    windows through all shards in name order.
    """
    counts = durable(counts)
    scanned = prefix_scan(counts, ["shard"], ["doc_id"], {"_end": ("sum", F.col("n_units"))})
    totals = counts_by_shard(counts).withColumn("_windows", F.floor(F.col("shard_units") / size).cast("bigint"))
    shards = prefix_scan(totals, [], ["shard"], {"_last": ("sum", F.col("_windows"))}).select(
        "shard", "shard_units", (F.col("_last") - F.col("_windows")).alias("first_window")
    )
    return scanned.join(shards, "shard").select(
        "shard", "doc_id", "n_units", (F.col("_end") - F.col("n_units")).alias("start"), "shard_units", "first_window"
    )


def counts_by_shard(counts: DataFrame) -> DataFrame:
    return counts.groupBy("shard").agg(F.sum("n_units").alias("shard_units"))


def sequence_units(
    docs: DataFrame,
    size: int,
    merge: str = "prev",
    l_max: int = 32,
    text: str = "text",
    pick: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Units with ``seq``, the position in their shard, and the shard geometry.

    ``pick`` narrows the layout to the documents whose units are wanted, so that only these are split.  A layout of
    measured size is broadcast and texts stay where they are; a larger one is joined by a shuffle.
    """
    units = unit_array(text, PATTERNS[merge], l_max)
    counts = docs.select("shard", "doc_id", F.size(units).cast("bigint").alias("n_units"))
    layout = document_layout(counts, size)
    layout = durable(pick(layout) if pick else layout)
    placed = join_checked(docs.select("shard", "doc_id", text), layout, ["shard", "doc_id"], "inner", LAYOUT_ROWS)
    rows = explode_units(placed, units, ["shard", "doc_id", "start", "shard_units", "first_window"])
    return rows.withColumn("seq", F.col("start") + F.col("pos")).drop("start")


def make_windows(seq_units: DataFrame, size: int, tail: bool = False) -> DataFrame:
    """Window number and index inside it; the incomplete window of a shard is dropped unless ``tail``."""
    windows = F.floor(F.col("shard_units") / size).cast("bigint")
    local = F.floor(F.col("seq") / size).cast("bigint")
    out = seq_units.withColumn("idx", F.pmod("seq", F.lit(size)))
    if tail:
        return out.withColumn("local_window", local)
    kept = out.filter(F.col("seq") < windows * size)
    return kept.withColumn("window_id", F.col("first_window") + local)


def gather_windows(windowed: DataFrame, keys: Sequence[str] = ("window_id",), dealt: bool = False) -> DataFrame:
    """One row per window: units and document-start flags in order (at most ``size`` each).

    Units that arrive in their order, as from a store, are moved as one row for each window.  ``dealt`` gives the keys and units
    alone, and leaves the windows where their keys were dealt, so that a join by these moves them no more.
    """
    if dealt:
        return dealt_lists(windowed, keys, "seq")

    def finish(group: Group) -> Iterator[list[pa.Array]]:
        yield [*group.keys, group.named, group.low, group.lists(group.unit), group.lists(group.flag)]

    schema = f"{kinds(windowed, keys)}, shard string, seq0 bigint, units array<string>, doc_start array<boolean>"
    return gathered(windowed, keys, "seq", finish, schema, "doc_start", "shard")


def covers(first: int, n: int) -> Column:
    """Documents of a layout that hold units of [first, first+n) of their shard."""
    return (F.col("start") < first + n) & (F.col("start") + F.col("n_units") > first)


def tail_documents(layout: DataFrame, size: int, n: int) -> DataFrame:
    """The documents that hold units of the last ``n`` windows."""
    last = F.col("first_window") + F.floor((F.col("start") + F.col("n_units") - 1) / size)
    return layout.transform(one_row, window_count(layout, size)).filter(last >= F.col("n_windows") - n).drop("n_windows")


def read_unit_range(seq_units: DataFrame, shard: str, first: int, n: int) -> DataFrame:
    """Units [first, first+n) of one shard with byte offsets from the start of the range."""
    part = seq_units.filter((F.col("shard") == shard) & (F.col("seq") >= first) & (F.col("seq") < first + n))
    out = prefix_scan(
        part.select("shard", "seq", "doc_id", "unit", "n_bytes"), ["shard"], ["seq"], {"byte_end": ("sum", F.col("n_bytes"))}
    )
    return out.withColumn("byte_off", F.col("byte_end") - F.col("n_bytes"))


def holdout_tail(windowed: DataFrame, n: int) -> DataFrame:
    """The last ``n`` windows."""
    last = windowed.agg(F.max("window_id").alias("_last"))
    return windowed.transform(one_row, last).filter(F.col("window_id") > F.col("_last") - n).drop("_last")


def window_count(layout: DataFrame, size: int) -> DataFrame:
    """One row: how many whole windows there are."""
    shards = layout.groupBy("shard").agg(F.max("shard_units").alias("u"))
    return shards.agg(F.sum(F.floor(F.col("u") / size)).cast("bigint").alias("n_windows"))


def window_ids(layout: DataFrame, size: int) -> DataFrame:
    """All window ids, generated from the shard geometry without touching units."""
    shards = layout.groupBy("shard").agg(F.max("shard_units").alias("u"), F.max("first_window").alias("f"))
    whole = F.floor(F.col("u") / size).cast("bigint")
    return shards.filter(whole > 0).select(F.explode(F.sequence(F.col("f"), F.col("f") + whole - 1)).alias("window_id"))


def sample_windows(ids: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` windows without replacement, with their place in the draw."""
    hashed = ids.withColumn("_h", id_hash(F.lit(str(seed)), "window_id"))
    drawn = smallest(hashed, ["_h", "window_id"], n)
    place = Window.partitionBy(F.lit(0)).orderBy("_h", "window_id")
    if n > 10000:
        return ranked(drawn, [], ["_h", "window_id"], "place").drop("_h")
    return drawn.select("window_id", F.row_number().over(place).cast("bigint").alias("place"))


def draw_windows(total: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` draws with replacement: draw i takes window hash(seed, i) mod N."""
    draws = total.sparkSession.range(n).select(F.col("id").alias("draw"))
    return draws.transform(one_row, total).select(
        "draw", F.pmod(id_hash(F.lit(str(seed)), "draw"), F.col("n_windows")).alias("window_id")
    )


def sample_units(seq_units: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` units drawn uniformly from the union of all shards, no replacement."""
    hashed = seq_units.select("shard", "doc_id", "pos", "unit").withColumn("_h", id_hash(F.lit(str(seed)), "doc_id", "pos"))
    return smallest(hashed, ["_h", "doc_id", "pos"], n).drop("_h")


def rotation_plan(shards: DataFrame, resident: int, every: int, steps: int, seed: int) -> DataFrame:
    """Which shards are resident in every block of ``every`` steps.

    Block b holds ``resident`` consecutive shards of a hashed permutation, one
    further along than block b-1, wrapping round.
    """
    place = ranked(shards.select("shard").distinct().withColumn("_h", id_hash(F.lit(str(seed)), "shard")), [], ["_h", "shard"], "place")
    total = place.agg(F.max("place").alias("n"))
    blocks = (steps + every - 1) // every
    # block b needs places b .. b+resident-1 modulo n, so a shard at place p serves b = p - j
    wanted = (
        total.sparkSession.range(blocks)
        .select(F.col("id").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(resident - 1))).alias("slot"))
        .transform(one_row, total)
        .withColumn("place", F.pmod(F.col("block") + F.col("slot"), F.col("n")) + 1)
    )
    return wanted.join(place.drop("_h"), "place").select("block", F.col("slot").cast("bigint").alias("slot"), "shard")


def merge_pass(windows: DataFrame, p: float, l_max: int, seed: int, key: str = "window_id") -> DataFrame:
    """Left to right, join a unit with its neighbour with probability ``p`` if both fit in ``l_max``.

    A joined pair is skipped as a whole.  Joins are marked in one string per window, so the
    work grows with the units and no list is copied per unit.
    """
    following = lambda i: F.get("units", i + 1)
    fits = lambda u, i: coin(p, seed, F.col(key), i) & (F.octet_length(u) + F.octet_length(following(i)) <= l_max)
    marks = F.array_join(F.transform("units", lambda u, i: F.when(fits(u, i), "1").otherwise("0")), "")
    # A mark takes the unit behind it, whatever that one's own mark; the last unit has none.
    rows = windows.withColumn("_marks", F.regexp_replace(marks, "1(.)", "tg"))
    joined = F.transform(
        F.split("_marks", ""),
        lambda m, i: F.when(m == "t", F.concat(F.get("units", i), following(i))).when(m != "g", F.get("units", i)),
    )
    return rows.withColumn("units", F.filter(joined, lambda u: u.isNotNull())).drop("_marks")


def split_unit(unit: Column, p: float, seed, *keys) -> Column:
    """One or two pieces: a unit of two or more characters is cut at a hashed character with probability ``p``."""
    size = F.length(unit)
    cut = F.pmod(id_hash(F.lit(f"{seed}cut"), *keys), size - 1).cast("int") + 1
    return F.when(
        (size >= 2) & coin(p, seed, *keys), F.array(F.substring(unit, F.lit(1), cut), F.substring(unit, cut + 1, size))
    ).otherwise(F.array(unit))


def split_pass(windows: DataFrame, p: float, seed: int, key: str = "window_id") -> DataFrame:
    pieces = F.flatten(F.transform("units", lambda u, i: split_unit(u, p, seed, F.col(key), i)))
    return windows.withColumn("units", pieces)


def refit_windows(augmented: DataFrame, raw: DataFrame, size: int) -> DataFrame:
    """Bring augmented windows back to ``size`` units.

    Longer windows are trimmed, shorter ones continue with the following raw units of
    the shard, and where the shard has too few left the raw window is used.  ``raw``
    holds every window of a shard including its tail, keyed (shard, local_window).
    """
    keys = ["shard", "local_window"]
    listed = lambda c: F.when(F.col(f"{c}_n") > 0, units_of(F.col(c))).when(F.col(f"{c}_n") == 0, F.array().cast("array<string>"))

    def packed(df: DataFrame, c: str, window: Column) -> DataFrame:
        # Null keys meet nothing; left out alike on all sides, windows of one plan are brought together once.
        met = df.filter(F.col("shard").isNotNull() & F.col("local_window").isNotNull())
        return met.select("shard", window.alias("local_window"), text_of(F.col("units")).alias(c), F.size("units").alias(f"{c}_n"))

    # Windows are joined as texts: lists of short strings take three times the room in an exchange or a sort.
    rows = packed(augmented, "_units", F.col("local_window")).join(packed(raw, "_raw", F.col("local_window")), keys)
    # Never null as it stands, or the planner would filter this side by it and bring its windows together again.
    before = F.coalesce(F.col("local_window") - 1, F.lit(-1).cast("bigint"))
    rows = rows.join(packed(raw, "_next", before), keys, "left")
    missing = F.lit(size) - F.col("_units_n")
    ahead = F.coalesce(F.col("_next_n"), F.lit(0))
    fitted = (
        F.when(missing <= 0, F.slice(listed("_units"), 1, size))
        .when(ahead >= missing, F.concat(listed("_units"), F.slice(listed("_next"), F.lit(1), F.greatest(missing, F.lit(1)))))
        .otherwise(listed("_raw"))
    )
    how = F.when(missing < 0, "trim").when(missing == 0, "same").when(ahead >= missing, "pad").otherwise("raw")
    return rows.select(*keys, fitted.alias("units"), how.alias("how"))


def tensorize(windows: DataFrame, l_max: int, pad: int = 256) -> DataFrame:
    """Padded byte rows, flat bytes, exclusive ends and the byte-to-unit map of every window.

    Units over ``l_max`` bytes keep them all; null units count as empty.  The bytes of some windows are laid out together.
    """
    ship(windows.sparkSession)
    kept = [c for c in windows.columns if c != "units"]
    schema = (
        f"{kinds(windows, kept)}, byte_ids array<array<smallint>>, pad_mask array<array<boolean>>, flat array<smallint>, "
        "flat_len bigint, ends array<bigint>, patch_pos array<int>"
    )
    return windows.select(*kept, "units").mapInArrow(_tensors(len(kept), l_max, pad, schema), schema)


def _tensors(n_kept: int, l_max: int, pad: int, schema: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(low, TOGETHER)
                units = some.column(n_kept)
                held = np.r_[0, np.cumsum(pc.list_value_length(units).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))]
                text, size = whole_bytes(units.flatten())
                total = np.r_[0, np.cumsum(size)]
                width = np.maximum(size, l_max)
                cells = np.r_[0, np.cumsum(width)]
                # A byte's cell: the first of its unit's row and its place in the unit.
                unit = np.repeat(np.arange(len(size)), size)
                canvas = np.full(cells[-1], pad, np.int16)
                canvas[np.arange(len(text)) - total[unit] + cells[unit]] = text
                rows = lists_of(cells, pa.array(canvas))
                padded = np.arange(l_max) >= size[:, None]
                masks = lists_of(np.arange(len(size) + 1) * l_max, pa.array(padded.ravel()))
                first = np.repeat(held[:-1], np.diff(held))
                flat = total[held]
                columns = [
                    *some.columns[:n_kept],
                    lists_of(held, rows),
                    lists_of(held, masks),
                    lists_of(flat, pa.array(text.astype(np.int16))),
                    pa.array(np.diff(flat)),
                    lists_of(held, pa.array(total[1:] - total[first])),
                    lists_of(flat, pa.array((unit - first[unit]).astype(np.int32))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=named_columns(schema))

    return run


#: Targets of a window's units, counted: which of its following units, place there, byte.
TARGET_COUNTS = "delta long, k long, r long, byte long, n long"


def future_targets(windowed: DataFrame, n: int, lam: float, k_max: int, key: str = "window_id", counted: bool = False) -> DataFrame:
    """For every unit, the bytes of the next ``n`` units of its window.

    Columns: ``idx`` the unit asked, ``delta`` 1-based byte distance, ``k`` which
    following unit, ``r`` place inside that unit, ``byte`` and ``weight`` lam^(k-1).
    Units are moved as one row for each window and targets are made behind that.  ``counted`` gives equal targets
    (delta, k, r, byte) of some windows once, with their number ``n``, instead of a row for each.
    """
    if counted:
        return gathered(windowed, [key], "idx", _counted_targets(n, k_max), TARGET_COUNTS)
    # A window's bytes and where its units end: no row for a unit comes back, the generators make them.
    schema = f"{kinds(windowed, [key])}, _at array<bigint>, _text array<tinyint>, _stops array<int>"
    rows = gathered(windowed, [key], "idx", _window_bytes, schema)
    asked = rows.select(key, "_at", "_text", "_stops", F.posexplode("_stops").alias("_i", "_stop"))
    ends = [F.lit(0)]
    for j in range(1, n + 1):
        ends.append(F.coalesce(F.get("_stops", F.col("_i") + j) - F.col("_stop"), ends[-1]))
    asked = asked.select(key, "_at", "_text", "_i", "_stop", *[e.alias(f"_e{j}") for j, e in enumerate(ends[1:], 1)])
    size = F.least(F.col(f"_e{n}"), F.lit(k_max))
    out = asked.select("*", F.explode(F.when(size > 0, F.sequence(F.lit(0), size - 1))).alias("_d"))
    # Powers of a literal are folded, so no target computes one.
    k, begin, weight = F.lit(1), F.lit(0), F.pow(F.lit(float(lam)), F.lit(0))
    for j in range(1, n):
        passed = F.col("_d") >= F.col(f"_e{j}")
        k = F.when(passed, F.lit(j + 1)).otherwise(k)
        begin = F.when(passed, F.col(f"_e{j}")).otherwise(begin)
        weight = F.when(passed, F.pow(F.lit(float(lam)), F.lit(j))).otherwise(weight)
    return out.select(
        key,
        F.get("_at", F.col("_i")).cast(windowed.schema["idx"].dataType).alias("idx"),
        (F.col("_d") + 1).cast("bigint").alias("delta"),
        k.cast("bigint").alias("k"),
        (F.col("_d") - begin).cast("bigint").alias("r"),
        F.get("_text", F.col("_stop") + F.col("_d")).cast("bigint").bitwiseAND(F.lit(255).cast("bigint")).alias("byte"),
        weight.alias("weight"),
    )


def _ahead(group: Group, n: int, k_max: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the groups' units, where each unit ends, the ends of the n following ones from there, and its targets."""
    text, size = whole_bytes(group.unit)
    stop = np.cumsum(size)
    last = group.offsets[1:][group.owner] - 1  # a unit's last unit of its window
    at = np.arange(len(stop))
    ends = np.stack([stop[np.minimum(at + j, last)] - stop for j in range(1, n + 1)]) if len(stop) else np.zeros((n, 0), np.int64)
    return text, stop, ends, np.minimum(ends[-1], k_max)


def _window_bytes(group: Group) -> Iterator[list[pa.Array]]:
    """Places, bytes and ends of the units of each group."""
    text, size = whole_bytes(group.unit)
    total = np.r_[0, np.cumsum(size)]
    begin = total[group.offsets]
    stops = total[1:] - begin[:-1][group.owner]
    yield [*group.keys, group.lists(group.at), lists_of(begin, pa.array(text.view(np.int8))), group.lists(pa.array(stops.astype(np.int32)))]


def _counted_targets(n: int, k_max: int):
    def finish(group: Group) -> Iterator[list[pa.Array]]:
        text, stop, ends, size = _ahead(group, n, k_max)
        for delta in range(1, int(size.max(initial=0)) + 1):
            asked = np.flatnonzero(size >= delta)
            passed = ends[:, asked] < delta
            k = passed.sum(axis=0)
            begin = np.where(k > 0, np.take_along_axis(ends[:, asked], np.maximum(k - 1, 0)[None], 0)[0], 0)
            r = delta - 1 - begin
            times = np.bincount((k * k_max + r) * 256 + text[stop[asked] + delta - 1])
            kinds_ = np.flatnonzero(times)
            rest, byte = np.divmod(kinds_, 256)
            k, r = np.divmod(rest, k_max)
            yield [pa.array(c) for c in (np.full(len(kinds_), delta), k + 1, r, byte, times[kinds_])]

    return finish


def doc_segments(windowed: DataFrame, key: str = "window_id") -> DataFrame:
    """Lengths of the document pieces inside every window; windows are bounded groups."""
    order = Window.partitionBy(key).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    marked = windowed.select(key, "idx", F.sum(F.col("doc_start").cast("bigint")).over(order).alias("_piece"))
    return marked.groupBy(key, "_piece").agg(F.min("idx").alias("first_idx"), F.count(F.lit(1)).alias("length")).drop("_piece")


def attention_pairs(segments: DataFrame, key: str = "window_id") -> DataFrame:
    """Allowed (i, j) pairs per window, j <= i in the same document, by count and never by listing."""
    return segments.groupBy(key).agg(F.sum(F.col("length") * (F.col("length") + 1) / 2).cast("bigint").alias("allowed"))


def packing_waste(windowed: DataFrame, size: int, l_max: int, key: str = "window_id") -> DataFrame:
    """Unit lengths, padding share and row byte spread of the padded (size, l_max) canvas."""
    rows = windowed.groupBy(key).agg(F.sum("n_bytes").alias("row_bytes"))
    per_size = windowed.groupBy("n_bytes").agg(F.count(F.lit(1)).alias("cnt"))
    lengths = per_size.agg(
        (F.sum(F.col("n_bytes") * F.col("cnt")) / F.sum("cnt")).alias("mean"),
        F.percentile("n_bytes", F.lit(0.5), F.col("cnt")).alias("p50"),
        F.percentile("n_bytes", F.lit(0.9), F.col("cnt")).alias("p90"),
        F.percentile("n_bytes", F.lit(0.99), F.col("cnt")).alias("p99"),
        F.max("n_bytes").alias("max"),
    )
    spread = rows.agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.avg("row_bytes").alias("row_mean"),
        F.min("row_bytes").alias("row_min"),
        F.max("row_bytes").alias("row_max"),
        (1 - F.sum("row_bytes") / (F.count(F.lit(1)) * size * l_max)).alias("pad_ratio"),
        (F.lit(float(size * l_max)) / F.avg("row_bytes")).alias("waste"),
    )
    return lengths.transform(one_row, spread)


def rolling_eval_plan(units: DataFrame, size: int, keys: Sequence[str] = ("shard", "doc_id")) -> DataFrame:
    """Scoring blocks of a long text: every unit is scored once.

    Block 0 scores ``size`` units; each later block scores size/2 new units after
    size/2 units of context.  Pure arithmetic on the position.
    """
    half = size - size // 2
    context = size // 2
    block = F.when(F.col("pos") < size, F.lit(0).cast("bigint")).otherwise(F.floor((F.col("pos") - size) / half).cast("bigint") + 1)
    first = F.when(F.col("block") == 0, F.lit(0).cast("bigint")).otherwise(size + (F.col("block") - 1) * half)
    out = units.withColumn("block", block).withColumn("block_start", first)
    start = F.when(F.col("block") == 0, F.col("block_start")).otherwise(F.col("block_start") - context)
    return out.withColumn("context_start", start)


def rolling_eval_blocks(units: DataFrame, size: int, keys: Sequence[str] = ("shard", "doc_id")) -> DataFrame:
    """The blocks of ``rolling_eval_plan`` with their units: ``context`` (read only) and ``scored``, in order.

    A unit goes to the block that scores it and to the one block at most that reads it as context, both known from
    its position.  A document's units are moved as one row, and its blocks are cut behind that.
    """
    schema = f"{kinds(units, keys)}, block bigint, context array<string>, scored array<string>"
    return gathered(units, keys, "pos", _blocks(size), schema)


def _blocks(size: int):
    half, context = size - size // 2, size // 2

    def finish(group: Group) -> Iterator[list[pa.Array]]:
        pos = group.at.fill_null(0).to_numpy(zero_copy_only=False)
        block = np.where(pos < size, 0, (pos - size) // half + 1)
        block[group.at.is_null().to_numpy(zero_copy_only=False)] = -1  # a unit without a position is in no block
        # The block whose context would hold this position; between two contexts of an odd size lies one unit of neither.
        later = (pos - (size - context)) // half + 1
        read = np.flatnonzero((block >= 0) & (pos >= size - context) & (pos < size + (later - 1) * half))
        owner, span = group.owner, max(int(block.max(initial=0)), int(later.max(initial=0))) + 2
        code = owner * span + block + 1
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
        # The last units would be context of a block that has nothing to score.
        reads = owner[read] * span + later[read] + 1
        held = np.isin(reads, code[first])
        read, reads = read[held], reads[held]
        contexts = np.r_[0, np.searchsorted(reads, code[first], side="right")]
        own = pa.array(owner[first])
        number = pa.array(block[first], mask=block[first] < 0)
        scored = lists_of(np.r_[first, len(code)], group.unit)
        yield [*[k.take(own) for k in group.keys], number, lists_of(contexts, group.unit.take(pa.array(read))), scored]

    return finish


def pair_arrays(units: Column) -> Column:
    """(previous, next) pairs of one document's units, built in the row without a shuffle.

    The first unit follows a begin marker (NULL) and is the pair a loss would mask.
    """
    shifted = F.concat(F.array(F.lit(None).cast("string")), F.slice(units, F.lit(1), F.greatest(F.size(units) - 1, F.lit(0))))
    return F.arrays_zip(shifted.alias("prev"), units.alias("next"))


def context_arrays(units: Column, k: int = 6) -> Column:
    """For every unit of an array, the text of the ``k`` units before it; built in the row."""
    before = lambda i: F.slice(units, F.greatest(i - k + 1, F.lit(1)), F.least(i, F.lit(k)))
    return F.transform(units, lambda u, i: F.array_join(before(i), ""))
