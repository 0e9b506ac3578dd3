"""Benchmark passages in documents: windows of normalised words, looked up in a broadcast hash set.

Every benchmark window is known by the hash of its words and found through one anchor, its
rarest word among the benchmark's windows.  Documents are exploded to words, and a broadcast
join inside the same stage keeps only anchors; at those the window's words are compared.
Whole texts and all windows take part; nothing is sampled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import durable, fresh, row_key

WINDOW = 10
#: Windows per broadcast (about 100 MB); a larger benchmark is looked up in several passes over the documents.
BROADCAST_ROWS = 500_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """A-Z lower-cased, then runs of 0-9, a-z and everything beyond ASCII; null has none."""
    pieces = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.filter(pieces, lambda w: w != "")


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(anchor, shift, len, gram, items): one row per distinct window.

    ``shift`` is the anchor's place in the window and ``items`` the distinct ids that hold it.
    An item of fewer than ``size`` words is one window; one without words has none.
    """
    split = items.select(F.col(item_id).alias("item"), words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    grams = split.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, size))).alias("gram"))
    # The number of windows of an item is bounded by its words; of a window's items by the benchmark.
    distinct = grams.groupBy("gram").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    spread = distinct.select("gram", "items", F.posexplode("gram").alias("place", "word"))
    common = spread.groupBy("word").agg(F.count("*").alias("n"))
    ranked = spread.join(common, "word").groupBy("gram").agg(
        F.min(F.struct("n", "place", "word")).alias("pick"), F.first("items").alias("items")
    )
    return ranked.select(
        F.col("pick.word").alias("anchor"), F.col("pick.place").alias("shift"), F.size("gram").alias("len"), "gram", "items"
    )


def occurrences(docs: DataFrame, known: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, start, len, items) of every place where a window of ``known`` occurs in ``text``."""
    known = durable(known)
    passes = max(1, -(-known.count() // BROADCAST_ROWS))
    split = docs.select(F.col(key).alias("key"), words(F.col(text)).alias("w"))
    placed = split.select("key", "w", F.posexplode("w").alias("at", "anchor"))
    start = F.col("at") - F.col("shift")
    same = (start >= 0) & (F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("len")) == F.col("gram"))
    found = None
    for number in range(passes):
        part = known.filter(F.pmod(F.xxhash64("gram"), F.lit(passes)) == number)
        hits = placed.join(F.broadcast(part), "anchor").filter(same).select("key", start.alias("start"), "len", "items")
        found = hits if found is None else found.unionByName(hits)
    return found


def report(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """One row per document row: n_words, n_hit, n_items, items_sha256, contaminated.

    A word inside any occurrence of a window is hit, once.  Null texts have no words; null
    item ids have no name and are left out of the lists, their windows still hit; repeated
    rows are each answered; other columns are ignored.  An empty benchmark hits nothing.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    keyed = docs.select("doc_id", "text", row_key().alias("key"))
    hits = occurrences(keyed, windows(items, item_id, text), "key")
    per_doc = hits.groupBy("key").agg(
        F.collect_set(F.struct("start", "len")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("names")
    )
    # Words covered by spans in order of their start: what each adds beyond the furthest end so far.
    cover = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["start"] + s["len"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), s["start"] + s["len"] - F.greatest(a["end"], s["start"]))).alias("n"),
        ),
        lambda a: a["n"],
    )
    found = per_doc.select("key", cover.alias("n_hit"), F.array_sort("names").alias("names"))
    joined = keyed.select("doc_id", "key", F.size(words(F.col("text"))).cast("long").alias("n_words")).join(found, "key", "left")
    names = F.coalesce("names", F.array().cast(T.ArrayType(T.StringType())))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """``docs`` without the rows that hold a benchmark window; all columns stay as they are.

    Equal texts share one verdict, so the decision is joined by the text's digest.
    """
    key = fresh(docs, "decision_key")
    keyed = docs.withColumn(key, F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))
    hit = occurrences(keyed, windows(items, item_id), key, text).select(F.col("key").alias(key)).distinct()
    return keyed.join(hit, key, "left_anti").select(*docs.columns)
