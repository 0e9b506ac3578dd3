"""Packing token pieces into sequences by best-fit decreasing, certified partition by partition.

Pieces are dealt to partitions of bounded size; each partition packs its pieces best fit
decreasing and compares its number of bins with a lower bound from dual feasible
functions.  Full bins are final, and in partitions that meet their bound the nearly full ones too.  What lies in the
other bins is exchanged (dealt anew) between the partitions and packed again, until the number of bins meets the
bound of all pieces together or an exchange saves nothing.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import durable, keeps, ship, turn_to

CAPACITY = 2048
END_ID = 0
VOCABULARY = "word_bpe_49k.json"
#: Pieces per partition (about 2 MB); the number of partitions follows the table.
PARTITION_PIECES = 20_000
#: Exchanges after which remaining gaps are accepted; each continues only if it saved bins.
ROUNDS = 6
#: Fill from which a bin of a partition that meets its bound is final.
DENSE = 0.99
#: Entries of a worker's table of known words (about 40 MB); it is emptied when full.
KNOWN_WORDS = 200_000
#: Words of more characters are encoded each time, so that the table's size is bounded.
LONG_WORD = 64
#: Documents whose new words are encoded in one call.
TOGETHER = 128

PLACED = "row long, length long, sequence_id long, offset long, settled boolean"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path), {}


@lru_cache(maxsize=4)
def _special(path: str) -> tuple[str, ...]:
    return tuple(token.content.lower() for token in _tokenizer(path)[0].get_added_tokens_decoder().values())


keeps("packing", _tokenizer.cache_clear)


#: A run of signs that ends with one of the signs set apart below.
_SIGNS = re.compile(r"(?:[^\w\s]|_)[.,][ \n]")


def _words(text: str) -> list[str]:
    """Parts of the text that can be encoded one by one: the tokenizer drops blanks and never joins across them.

    It lower-cases letter by letter (final sigma excepted, so such texts stay as they are) and parts letters from signs, so a
    single comma or stop after a word may be set apart as well; that keeps the number of different words low.
    """
    if "\u03a3" not in text:
        text = text.lower()
    if not _SIGNS.search(text):
        text = text.replace(", ", " , ").replace(". ", " . ").replace(".\n", " . ")
    return text.replace("\n", " ").split(" ")


def token_bytes(texts: list[str], path: str) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit integers, by way of the words that the worker knows.

    Texts that hold a special token, in whatever case, are encoded whole.
    """
    tokenizer, known = _tokenizer(path)
    lowered = [text.lower() for text in texts]
    whole = {i for i, low in enumerate(lowered) if any(token in low for token in _special(path))}
    if len(known) > KNOWN_WORDS:
        known.clear()
    split = [[] if i in whole else _words(text) for i, text in enumerate(texts)]
    new = list(set().union(*split).difference(known))
    if new:
        coded = tokenizer.encode(" ".join(new), add_special_tokens=False)
        ends = np.cumsum([len(w) + 1 for w in new])
        first = np.fromiter((start for start, _ in coded.offsets), dtype=np.int64, count=len(coded.ids))
        upto = np.searchsorted(np.searchsorted(ends, first, side="right"), np.arange(len(new)), side="right") * 4
        ids, at = np.asarray(coded.ids, dtype="<u4").tobytes(), 0
        for word, end in zip(new, upto.tolist()):
            known[word] = ids[at:end]
            at = end
    out = [b"".join(map(known.__getitem__, words)) for words in split]
    for i in whole:
        out[i] = np.asarray(tokenizer.encode(texts[i], add_special_tokens=False).ids, dtype="<u4").tobytes()
    for word in new:
        if len(word) > LONG_WORD:
            del known[word]
    return out


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document row; only documents over ``capacity`` are cut.

    A null or empty text is the end id alone, one piece.  Other columns are ignored.
    """
    ship(docs.sparkSession)
    path = vocabulary or vocabulary_path()
    end = np.asarray([END_ID], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("packing")
        kinds = {"long": pa.int64(), "int": pa.int32()}
        schema = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, PIECES.split(", "))])
        for batch in batches:
            rows = []
            for at in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(at, TOGETHER)
                coded = token_bytes([t or "" for t in some["text"].to_pylist()], path)
                for doc_id, ids in zip(some["doc_id"].to_pylist(), coded):
                    ids += end
                    for number, start in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[start : start + 4 * capacity]
                        rows.append((doc_id, number, start // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def lower_bound(sizes: np.ndarray, counts: np.ndarray | None = None, capacity: int = CAPACITY) -> int:
    """Bins that any packing of ``sizes`` needs: the best of two families of dual feasible functions.

    A dual feasible function maps sizes so that whatever fits a bin keeps a sum of at most 1; the
    mapped total is then a bound.  u_k rounds size*(k+1)/capacity down unless whole (k = 1..40);
    the threshold family counts sizes over capacity - t as 1, those under t as 0, the rest as they are.
    """
    if not len(sizes):
        return 0
    if counts is None:
        sizes, counts = np.unique(sizes, return_counts=True)
    best = -(-int((sizes * counts).sum()) // capacity)
    for k in range(1, 41):
        scaled = sizes * (k + 1)
        whole = scaled % capacity == 0
        total = np.where(whole, sizes * k, (scaled // capacity) * capacity) * counts
        best = max(best, -(-int(total.sum()) // (k * capacity)))
    for t in np.unique(np.minimum(sizes, capacity - sizes)):
        if 0 < t <= capacity // 2:
            mapped = np.where(sizes > capacity - t, capacity, np.where(sizes < t, 0, sizes)) * counts
            best = max(best, -(-int(mapped.sum()) // capacity))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of every length, and the number of bins; ties go to the earlier row.

    ``room`` holds the open bins by their free space and ``mask`` has a bit for each space in use, so the
    tightest bin is the lowest set bit from the wanted length on.
    """
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, opened = 0, 0
    for row in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[row])
        fits = mask >> need
        if fits:
            free = need + (fits & -fits).bit_length() - 1
            place = room[free].pop()
            if not room[free]:
                mask &= ~(1 << free)
        else:
            free, place, opened = capacity, opened, opened + 1
        bins[row], offsets[row] = place, capacity - free
        if free > need:
            room[free - need].append(place)
            mask |= 1 << (free - need)
    return bins, offsets, opened


def pack(items: DataFrame, capacity: int = CAPACITY, per_partition: int = PARTITION_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """``items`` (any columns, a ``length`` of 1 to ``capacity``) with sequence_id and offset.

    ``items`` must be stable when read twice (a table or a checkpoint).  Sizes of partitions are
    bounded whatever the keys, since rows are dealt by their number.  An empty table stays empty.
    """
    numbered = durable(items.select("length", F.monotonically_increasing_id().alias("row"), F.struct(*items.columns).alias("item")))
    full = numbered.filter(F.col("length") >= capacity).select(
        "row", (F.col("row") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    place = ["row", "sequence_id", "offset"]
    placed, pool, pool_bins = full, numbered.filter(F.col("length") < capacity).select("length", "row"), None
    # One row per length, so at most as many as the capacity.
    lengths = pool.groupBy("length").agg(F.count("*").alias("n")).collect()
    left = lower_bound(np.array([r["length"] for r in lengths], np.int64), np.array([r["n"] for r in lengths], np.int64), capacity)
    for number in range(rounds):
        held = pool.count()
        if not held:
            break
        parts = F.lit(-(-held // per_partition))
        dealt = pool.select("length", "row", F.pmod(F.xxhash64("row", F.lit(number)), parts).alias("part"))
        packed = durable(dealt.groupBy("part").applyInPandas(_packer(capacity, number), PLACED))
        if pool_bins is not None and _bins(packed) >= pool_bins:
            break  # dealing anew saved nothing, so the packing before stands
        settled, pool = packed.filter("settled"), packed.filter("not settled")
        placed = placed.unionByName(settled.select(*place))
        left, pool_bins = left - _bins(settled), _bins(pool)
        if pool_bins <= left:
            break  # as few as the bound of all pieces allows
    if pool_bins:
        placed = placed.unionByName(pool.select(*place))
    return numbered.join(placed, "row").select("item.*", "sequence_id", "offset")


def _bins(packed: DataFrame) -> int:
    return packed.select("sequence_id").distinct().count()


def _packer(capacity: int, number: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row")
        lengths = group["length"].to_numpy(np.int64)
        bins, offsets, used = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, weights=lengths, minlength=used)
        certified = used <= lower_bound(lengths, capacity=capacity)
        # Even numbers, so never that of a full piece.
        base = (number << 58) + (int(group["part"].iloc[0]) << 20)
        return pd.DataFrame(
            {
                "row": group["row"],
                "length": lengths,
                "sequence_id": (base + bins) * 2,
                "offset": offsets,
                "settled": fill[bins] >= (DENSE * capacity if certified else capacity),
            }
        )

    return run


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = durable(pieces(docs, vocabulary, capacity))
    return pack(cut, capacity)
