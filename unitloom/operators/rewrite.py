"""Unit rewriting: quality scores on distinct units, re-splitting, encoding, typos.

A unit repeats about a hundred times in real text, so every expensive step runs on
distinct units and is joined back by the mapping of the few units that changed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import char_units, chunk_chars, hash01, id_hash
from ..session import durable
from .ordered import BROADCAST_ROWS, join_checked, one_row
from .runs import in_order

BEGIN = "^"
def _byte_pairs(unit: Column) -> Column:
    """(previous byte, byte) pairs of a unit as hex, the first one after the begin marker."""
    own = F.regexp_extract_all(F.hex(unit), F.lit(".."), F.lit(0))
    return F.arrays_zip(F.concat(F.array(F.lit(BEGIN)), own).alias("prev"), own.alias("byte"))


def _pairs(df: DataFrame) -> DataFrame:
    rows = df.select(*df.columns, F.explode(_byte_pairs(F.col("unit"))).alias("_p"))
    return rows.select(*df.columns, F.col("_p.prev").alias("prev"), F.col("_p.byte").alias("byte")).filter("byte IS NOT NULL")


def bigram_model(freq: DataFrame) -> DataFrame:
    """Bits of every byte after every byte; at most 257 x 256 rows whatever the corpus."""
    counts = _pairs(freq.select("unit", "cnt")).groupBy("prev", "byte").agg(F.sum("cnt").alias("c"))
    total = F.sum("c").over(Window.partitionBy("prev"))
    return counts.select("prev", "byte", (-F.log2(F.col("c") / total)).alias("bits"))


def bigram_scorer(freq: DataFrame, min_count: int) -> Callable[[DataFrame], DataFrame]:
    """Scorer for distinct units: mean bits per byte, ok when seen often enough.

    A byte pair the model never saw costs 16 bits.
    """
    model = durable(bigram_model(freq))

    def score(units: DataFrame) -> DataFrame:
        bits = _pairs(units.select("unit")).join(F.broadcast(model), ["prev", "byte"], "left")
        mean = bits.groupBy("unit").agg(F.avg(F.coalesce("bits", F.lit(16.0))).alias("entropy"))
        seen = mean.join(freq.select("unit", "cnt"), "unit", "left")
        return seen.select("unit", (F.coalesce("cnt", F.lit(0)) >= min_count).alias("ok"), "entropy")

    return score


def pandas_scorer(fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[DataFrame], DataFrame]:
    """Hook for a model of one's own: batches of ``unit`` in, (unit, ok, entropy) out."""

    def score(units: DataFrame) -> DataFrame:
        return units.select("unit").mapInPandas(fn, "unit string, ok boolean, entropy double")

    return score


def _cut_rest(text: str, cap: int) -> list[str]:
    """Pieces of at most ``cap`` bytes between characters; a wider character stays whole."""
    out, start, size = [], 0, 0
    for i, ch in enumerate(text):
        wide = len(ch.encode())
        if size and size + wide > cap:
            out.append(text[start:i])
            start, size = i, 0
        size += wide
    return [*out, text[start:]]


def _greedy(unit: str, words: frozenset, longest: int, l_max: int) -> list[str]:
    """Longest match from the left; characters without a match run together."""
    out: list[str] = []
    at = rest = 0
    while at < len(unit):
        top = min(longest, len(unit) - at)
        n = next((n for n in range(top, 0, -1) if unit[at : at + n] in words), 0)
        if n:
            if rest < at:
                out.extend(_cut_rest(unit[rest:at], l_max))
            out.append(unit[at : at + n])
            rest = at + n
        at += n or 1
    if rest < len(unit):
        out.extend(_cut_rest(unit[rest:], l_max))
    return out


def vocabulary_pieces(units: DataFrame, vocab: DataFrame, l_max: int, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Cut distinct units by greedy longest match against a vocabulary table.

    Characters no entry covers run together and are cut at ``l_max`` bytes.  The
    vocabulary is counted first: up to ``max_rows`` entries of at most ``l_max`` bytes
    go to every task as a set and each unit is cut in one pass, without a shuffle; a
    larger one is joined.
    """
    fitting = vocab.filter((F.octet_length("unit") <= l_max) & (F.octet_length("unit") > 0)).select("unit").distinct()
    entries = [r.unit for r in fitting.limit(max_rows + 1).collect()] if max_rows else [""]
    if len(entries) > max_rows:
        return _pieces_by_join(units, fitting, l_max)
    words = units.sparkSession.sparkContext.broadcast(frozenset(entries))
    longest = max(map(len, entries), default=0)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = words.value
        for pdf in batches:
            yield pd.DataFrame({"unit": pdf["unit"], "pieces": [_greedy(u, known, longest, l_max) for u in pdf["unit"]]})

    return units.select("unit").mapInPandas(cut, "unit string, pieces array<string>")


def _pieces_by_join(units: DataFrame, vocab: DataFrame, l_max: int) -> DataFrame:
    """The same cut with a vocabulary of any size.

    All substrings of the units are joined with the vocabulary, the longest match per
    start is kept, and a fold over the starts walks the unit.
    """
    at = units.select("unit", F.explode(F.sequence(F.lit(1), F.length("unit"))).alias("at"))
    sub = at.select(
        "unit", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(l_max), F.length("unit") - F.col("at") + 1))).alias("n")
    ).withColumn("piece", F.substring(F.col("unit"), F.col("at"), F.col("n")))
    entries = vocab.select(F.col("unit").alias("piece"))
    longest = sub.join(entries, "piece", "left_semi").groupBy("unit", "at").agg(F.max("n").alias("n"))
    steps = longest.groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("_steps"))
    rows = units.select("unit").join(steps, "unit", "left")

    none = F.lit("")
    zero = F.struct(
        F.array().cast("array<string>").alias("done"), none.alias("rest"), F.lit(1).alias("next")
    )

    def flush(acc):
        return F.when(acc["rest"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["rest"])))

    def step(acc, i):
        n = F.col("_steps")[i]
        return (
            F.when(i < acc["next"], acc)
            .when(
                n.isNotNull(),
                F.struct(
                    F.concat(flush(acc), F.array(F.substring(F.col("unit"), i, n))).alias("done"),
                    none.alias("rest"),
                    (i + n).alias("next"),
                ),
            )
            .otherwise(
                F.struct(
                    acc["done"].alias("done"),
                    F.concat(acc["rest"], F.substring(F.col("unit"), i, F.lit(1))).alias("rest"),
                    (i + 1).alias("next"),
                )
            )
        )

    walked = F.aggregate(F.sequence(F.lit(1), F.length("unit")), zero, step, flush)
    return rows.select("unit", F.flatten(F.transform(walked, lambda p: chunk_chars(p, l_max))).alias("pieces"))


def split_oversized(freq: DataFrame, vocab: DataFrame, l_max: int) -> DataFrame:
    """Pieces of every distinct unit over ``l_max`` bytes."""
    return vocabulary_pieces(freq.filter(F.octet_length("unit") > l_max).select("unit"), vocab, l_max)


def failing(scored: DataFrame, thresh: float, l_max: int) -> DataFrame:
    bad = ~F.col("ok") | (F.col("entropy") > thresh) | (F.octet_length("unit") > l_max)
    return scored.filter(bad).select("unit")


def resplit_cascade(
    scored: DataFrame,
    vocab: DataFrame,
    scorer: Callable[[DataFrame], DataFrame],
    thresh: float = 0.2,
    floor_bytes: int = 3,
    l_max: int = 32,
) -> tuple[DataFrame, DataFrame]:
    """(mapping unit -> pieces, floor scores) for units that fail.

    Round one splits by vocabulary, round two scores the distinct pieces, and a piece
    that fails again becomes character chunks of at most ``floor_bytes`` bytes, which
    are accepted but scored once more for the residual count.
    """
    split = durable(vocabulary_pieces(failing(scored, thresh, l_max), vocab, l_max))
    placed = split.select("unit", F.posexplode("pieces").alias("at", "piece"))
    distinct = placed.select(F.col("piece").alias("unit")).distinct()
    again = durable(failing(scorer(distinct), thresh, l_max).select(F.col("unit").alias("piece"), F.lit(True).alias("bad")))
    final = placed.join(again, "piece", "left").select(
        "unit", "at", F.when(F.col("bad"), chunk_chars("piece", floor_bytes)).otherwise(F.array("piece")).alias("c")
    )
    mapping = final.groupBy("unit").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "c"))), lambda x: x["c"])).alias("pieces")
    )
    floor = again.select(F.explode(chunk_chars("piece", floor_bytes)).alias("unit")).distinct()
    return mapping, scorer(floor)


def apply_mapping(units: DataFrame, mapping: DataFrame, max_rows: int = BROADCAST_ROWS, freq: DataFrame | None = None) -> DataFrame:
    """Replace units by their pieces; the first piece keeps the document-start flag.

    Order is (pos, piece); units without a mapping pass through.  A mapping of more than ``max_rows`` rows is joined by a
    shuffle; with ``freq``, counts (unit, cnt) of these units, the most frequent ones are looked up where they are, and only the
    rows of rarer units are moved.
    """
    joined = _looked_up(units, mapping, max_rows, freq)
    keep = [c for c in units.columns if c not in ("unit", "n_bytes", "doc_start")]
    rows = joined.select(*keep, "doc_start", F.posexplode(F.coalesce("pieces", F.array("unit"))).alias("piece", "unit"))
    return rows.select(
        *keep,
        F.col("piece").cast("bigint").alias("piece"),
        "unit",
        F.octet_length("unit").cast("bigint").alias("n_bytes"),
        (F.col("doc_start") & (F.col("piece") == 0)).alias("doc_start"),
    )


def _looked_up(units: DataFrame, mapping: DataFrame, max_rows: int, freq: DataFrame | None) -> DataFrame:
    if freq is None or mapping.limit(max_rows + 1).count() <= max_rows:
        return join_checked(units, mapping, "unit", "left", max_rows)
    common = _most_frequent(freq, max_rows)
    if common is None:
        return units.join(mapping, "unit", "left")
    common = durable(common)
    known = durable(common.join(mapping.join(F.broadcast(common), "unit", "left_semi"), "unit", "left"))
    near = units.join(F.broadcast(known), "unit")
    rest = units.join(F.broadcast(known.select("unit")), "unit", "left_anti").join(mapping, "unit", "left")
    return near.unionByName(rest)


def _most_frequent(freq: DataFrame, n: int) -> DataFrame | None:
    """The units of the highest counts, all of a count or none, ``n`` at most; there are far fewer counts than units."""
    levels = freq.groupBy("cnt").agg(F.count(F.lit(1)).alias("units"))
    running = levels.select("cnt", F.sum("units").over(Window.orderBy(F.col("cnt").desc())).alias("units"))
    least = running.filter(F.col("units") <= n).agg(F.min("cnt")).first()[0]
    return None if least is None else freq.filter(F.col("cnt") >= least).select("unit").distinct()


def renumber(units: DataFrame, keys=("shard", "doc_id")) -> DataFrame:
    """Dense positions inside every document after a rewrite (a document is one bounded group).

    A document's units are moved as runs, dealt by the last key, and numbered behind that.
    """
    return in_order(units, keys, "pos", "piece")


def fit_windows(windows: DataFrame, size: int) -> DataFrame:
    """Trim rewritten windows to ``size`` units."""
    return windows.withColumn("units", F.slice("units", 1, size))


def verify_stats(freq: DataFrame, mapping: DataFrame, floor: DataFrame, thresh: float, l_max: int = 32) -> DataFrame:
    """Units in and out, flagged share and floor residue, from counts instead of the stream."""
    joined = freq.join(mapping, "unit", "left")
    flagged = F.col("pieces").isNotNull()
    main = joined.agg(
        F.sum("cnt").alias("n_in"),
        F.sum(F.when(flagged, F.col("cnt")).otherwise(0)).alias("n_flag"),
        F.sum(F.col("cnt") * F.coalesce(F.size("pieces"), F.lit(1))).alias("n_out"),
        F.sum(flagged.cast("bigint")).alias("n_flag_distinct"),
    )
    bad = ~F.col("ok") | (F.col("entropy") > thresh) | (F.octet_length("unit") > l_max)
    rest = floor.agg(F.count(F.lit(1)).alias("n_floor"), F.coalesce(F.sum(bad.cast("bigint")), F.lit(0)).alias("n_floor_fail"))
    return main.transform(one_row, rest).withColumn("factor", F.col("n_out") / F.greatest(F.col("n_in"), F.lit(1)))


def encode_with_vocab(docs: DataFrame, units: Column, vocab: DataFrame, topn: int, keep=("shard", "doc_id")) -> DataFrame:
    """Units to ids: vocabulary rank from 0, ``topn`` for unknown, ``topn + 1`` ends a document.

    The vocabulary has at most ``topn`` rows; ``join_checked`` broadcasts it only when
    that is small.  Empty documents give no rows, not even an end.
    """
    ids = vocab.filter(F.col("rnk") <= topn).select("unit", (F.col("rnk") - 1).alias("token_id"))
    ended = F.when(F.size(units) > 0, F.concat(units, F.array(F.lit(None).cast("string"))))
    rows = docs.select(*keep, F.posexplode(ended).alias("pos", "unit"))
    joined = join_checked(rows, ids, "unit", "left")
    return joined.select(
        *keep,
        F.col("pos").cast("bigint").alias("pos"),
        F.when(F.col("unit").isNull(), F.lit(topn + 1)).otherwise(F.coalesce("token_id", F.lit(topn))).cast("bigint").alias("token_id"),
        (F.col("pos") == 0).alias("doc_start"),
    )


# --- typos -------------------------------------------------------------------

OPS = ("sub", "del", "dup", "trans", "case")
# Weight of every edit operation, in the order of OPS.
OP_WEIGHTS = (0.40, 0.20, 0.15, 0.15, 0.10)


def _code_in(ch: Column, *ranges: tuple[int, int]) -> Column:
    code, hit = F.ascii(ch), None
    for low, high in ranges:
        one = code.between(low, high)
        hit = one if hit is None else hit | one
    return hit


_LOWER, _UPPER, _DIGIT = (97, 122), (65, 90), (48, 57)


def _places(chars: Column, op: str) -> Column:
    """0-based character positions an operation may touch."""
    spots = F.sequence(F.lit(0), F.size(chars) - 1)
    if op == "sub":
        return F.filter(spots, lambda i: _code_in(F.get(chars, i), _LOWER, _UPPER, _DIGIT))
    if op == "case":
        return F.filter(spots, lambda i: _code_in(F.get(chars, i), _LOWER, _UPPER))
    if op == "trans":
        here, there = (lambda i: F.get(chars, i)), (lambda i: F.get(chars, i + 1))
        return F.filter(
            spots,
            lambda i: F.coalesce(
                _code_in(here(i), (32, 126)) & _code_in(there(i), (32, 126)) & (here(i) != there(i)), F.lit(False)
            ),
        )
    return F.filter(spots, lambda i: F.size(chars) >= 2)


def _replacement(ch: Column, h: Column) -> Column:
    """Another character of the same class (lower, upper, digit)."""
    code = F.ascii(ch)

    def turn(base: int, n: int) -> Column:
        return F.char(F.lit(base) + F.pmod(code - base + 1 + F.pmod(h, F.lit(n - 1)), F.lit(n)))

    return F.when(_code_in(ch, _LOWER), turn(97, 26)).when(_code_in(ch, _UPPER), turn(65, 26)).otherwise(turn(48, 10))


def _edited(text: Column, chars: Column, at: Column, op: str, h: Column) -> Column:
    """``text`` with one edit at the 0-based character ``at``; NULL when ``at`` is NULL."""
    before = F.substring(text, F.lit(1), at)
    after = F.substring(text, at + 2, F.length(text))
    ch = F.get(chars, at)
    if op == "sub":
        return F.concat(before, _replacement(ch, h), after)
    if op == "del":
        return F.concat(before, after)
    if op == "dup":
        return F.concat(before, ch, ch, after)
    if op == "trans":
        return F.concat(before, F.get(chars, at + 1), ch, F.substring(text, at + 3, F.length(text)))
    return F.concat(before, F.when(_code_in(ch, _LOWER), F.upper(ch)).otherwise(F.lower(ch)), after)


def _allowed(text: Column, op: str) -> Column:
    """Under three bytes nothing is changed; three or four bytes only change in place."""
    return F.octet_length(text) >= (3 if op in ("sub", "case") else 5)


def _pick(places: Column, h: Column) -> Column:
    return F.get(places, F.pmod(h, F.greatest(F.size(places), F.lit(1))).cast("int"))


def _only(values: Column, name: str) -> Column:
    """Row generator that drops NULL.

    A filter on the edited string would be pushed down through the projections and
    repeat the whole edit; a generator is evaluated once.
    """
    return F.explode(F.filter(F.array(values), lambda v: v.isNotNull())).alias(name)


def forced_typos(units: DataFrame, op: str, seed: int, l_max: int = 32) -> DataFrame:
    """One edit of the given kind for every unit it applies to and that stays within ``l_max`` bytes."""
    rows = units.withColumn("_chars", char_units("unit"))
    rows = rows.withColumn("_at", _pick(_places(F.col("_chars"), op), id_hash(F.lit(str(seed)), F.lit(op), "unit")))
    to = id_hash(F.lit(str(seed)), F.lit(op), F.lit("to"), "unit")
    edited = F.when(_allowed(F.col("unit"), op), _edited(F.col("unit"), F.col("_chars"), F.col("_at"), op, to))
    fits = F.filter(F.array(edited), lambda v: v.isNotNull() & (F.octet_length(v) <= l_max))
    return rows.select(*units.columns, F.explode(fits).alias("typo"))


def _one_edit(df: DataFrame, source: str, out: str, seed: str, gate: Column, weights) -> DataFrame:
    """Add ``out``: ``source`` after one weighted edit, or ``source`` itself where gated or impossible.

    Each operation draws an exponential waiting time with its weight as rate and the
    first one that can change the string wins, which is a weighted choice.
    """
    rows = df.withColumn("_chars", char_units(source)).withColumn("_h", id_hash(F.lit(f"{seed}at"), source))
    options = []
    for op, weight in zip(OPS, weights):
        wait = -F.log(hash01(f"{seed}{op}", source) + F.lit(1e-18)) / F.lit(float(weight))
        options.append(
            F.struct(
                wait.alias("wait"),
                F.lit(op).alias("op"),
                F.when(_allowed(F.col(source), op), _pick(_places(F.col("_chars"), op), F.col("_h"))).alias("at"),
            )
        )
    first = F.array_min(F.filter(F.array(*options), lambda o: o["at"].isNotNull()))
    rows = rows.select("*", F.explode(F.array(first)).alias("_pick"))
    to = id_hash(F.lit(f"{seed}to"), source)
    edited = F.lit(None).cast("string")
    for op in OPS:
        value = _edited(F.col(source), F.col("_chars"), F.col("_pick.at"), op, to)
        edited = F.when(F.col("_pick.op") == op, value).otherwise(edited)
    done = F.coalesce(F.when(gate, edited), F.col(source))
    return rows.select(*df.columns, F.explode(F.array(done)).alias(out))


def typo_variants(
    units: DataFrame, weights=OP_WEIGHTS, two_edit_p: float = 0.15, l_max: int = 32, seed: int = 0
) -> DataFrame:
    """A typo of every distinct unit: one edit, or two with probability ``two_edit_p``.

    Operations are drawn by weight among those that can change the unit.  Units that no
    operation changes, or whose variant exceeds ``l_max`` bytes, give no row.
    """
    rows = _one_edit(units, "unit", "_first", f"{seed}-1-", F.lit(True), weights)
    again = hash01(f"{seed}-two", "unit") < two_edit_p
    rows = _one_edit(rows, "_first", "_second", f"{seed}-2-", again, weights)
    new = F.col("_second")
    fine = (new != F.col("unit")) & (new != "") & (F.octet_length(new) <= l_max)
    return rows.select(*units.columns, _only(F.when(fine, new), "typo"))


def typo_probability(units: DataFrame, top: DataFrame, p: float, freq_scale: float) -> DataFrame:
    """p x length gate x throttle for the most frequent units."""
    joined = join_checked(units, top.select("unit", F.lit(True).alias("_top")), "unit")
    size = F.octet_length("unit")
    gate = F.when(size < 3, 0.0).when(size <= 4, 0.5).otherwise(1.0)
    return joined.withColumn("p", F.lit(p) * gate * F.when(F.col("_top"), F.lit(freq_scale)).otherwise(1.0)).drop("_top")
