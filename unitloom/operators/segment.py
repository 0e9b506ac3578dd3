"""Documents to units: deterministic splitters and their byte geometry.

Every splitter is one regular expression evaluated inside the scan stage, followed
by a generate; nothing is shuffled.  Output columns: the kept key columns, then
``pos``, ``unit``, ``n_bytes``, ``doc_start``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import (
    CORE,
    RUNS,
    WORD_NEXT,
    WORD_PREV,
    chunk_chars,
    coin,
    n_bytes,
    slice_at,
    start_offsets,
)

PATTERNS = {"prev": WORD_PREV, "next": WORD_NEXT, "runs": RUNS, "core": CORE}


def unit_array(text, pattern: str, l_max: int | None = None) -> Column:
    """ARRAY<STRING> of units; pieces over ``l_max`` bytes are cut between characters."""
    text = F.col(text) if isinstance(text, str) else text
    units = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if l_max is None:
        return units
    capped = F.flatten(F.transform(units, lambda u: chunk_chars(u, l_max)))
    return F.when(F.exists(units, lambda u: F.octet_length(u) > l_max), capped).otherwise(units)


def explode_units(df: DataFrame, units: Column, keep: Sequence[str]) -> DataFrame:
    """One row per unit.

    ``units`` should be the expression itself: for a plain column the optimizer adds a
    size filter and pushes it down, which would evaluate the splitter twice.
    """
    out = df.select(*keep, F.posexplode(units).alias("pos", "unit"))
    return out.select(
        *keep,
        F.col("pos").cast("bigint").alias("pos"),
        "unit",
        n_bytes("unit").alias("n_bytes"),
        (F.col("pos") == 0).alias("doc_start"),
    )


def _split(docs: DataFrame, pattern: str, l_max: int | None, text: str, keep: Sequence[str]) -> DataFrame:
    return explode_units(docs, unit_array(text, pattern, l_max), keep)


def segment_word(
    docs: DataFrame, merge: str = "prev", l_max: int | None = 32, text: str = "text", keep=("shard", "doc_id")
) -> DataFrame:
    """Whole words, single number characters and symbol runs; a lone space joins its word."""
    if merge not in ("prev", "next"):
        raise ValueError("merge must be 'prev' or 'next'")
    return _split(docs, PATTERNS[merge], l_max, text, keep)


def segment_runs(docs: DataFrame, l_max: int | None = None, text: str = "text", keep=("shard", "doc_id")) -> DataFrame:
    """Byte-class runs: blanks, word bytes, symbols."""
    return _split(docs, PATTERNS["runs"], l_max, text, keep)


def segment_core(docs: DataFrame, l_max: int | None = 16, text: str = "text", keep=("shard", "doc_id")) -> DataFrame:
    """Word core with its trailing delimiters."""
    if l_max is not None and l_max < 4:
        raise ValueError("l_max must be at least 4, the widest UTF-8 character")
    return _split(docs, PATTERNS["core"], l_max, text, keep)


def unit_counts(docs: DataFrame, merge: str = "prev", l_max: int | None = 32, text: str = "text") -> DataFrame:
    """Units per document without exploding them."""
    return docs.select("shard", "doc_id", F.size(unit_array(text, PATTERNS[merge], l_max)).cast("bigint").alias("n_units"))


def byte_offsets(
    docs: DataFrame, pattern: str = WORD_PREV, text: str = "text", keep: Sequence[str] = ("shard", "doc_id")
) -> DataFrame:
    """Units with their start byte, numbered inside the row so nothing is shuffled."""
    rows = docs.select(*keep, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)).alias("_units"))
    at = start_offsets(F.transform("_units", lambda u: F.octet_length(u)))
    out = rows.select(*keep, F.posexplode(F.arrays_zip(F.col("_units").alias("unit"), at.alias("at"))).alias("pos", "_u"))
    return out.select(
        *keep, F.col("pos").cast("bigint").alias("pos"), F.col("_u.unit").alias("unit"), F.col("_u.at").alias("byte_off")
    )


def cut_list(pattern: str, text: str = "text") -> Column:
    """Inner byte offsets where a splitter cuts."""
    sizes = F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), lambda u: F.octet_length(u))
    return F.filter(start_offsets(sizes), lambda at: at > 0)


def combine_boundaries(
    docs: DataFrame,
    first: str = WORD_PREV,
    second: str = RUNS,
    p: float = 0.5,
    seed: int = 0,
    l_max: int = 32,
    pure: bool = False,
    text: str = "text",
    keep: Sequence[str] = ("shard", "doc_id"),
) -> DataFrame:
    """Units from two splitters: shared cuts stay, single cuts stay with probability ``p``.

    The coin depends on (seed, document, offset) only, so a rebuild gives the same
    units.  Both cut lists belong to one text and are merged inside its row: no join,
    no shuffle.  ``pure`` uses the second splitter alone.  Units are BINARY because
    the final byte cap may fall inside a character.
    """
    rows = docs.select(*keep, text, cut_list(second, text).alias("_second"))
    if pure:
        rows = rows.withColumn("_cuts", F.col("_second"))
    else:
        rows = rows.withColumn("_first", cut_list(first, text))
        rows = rows.withColumn("_shared", F.array_intersect("_first", "_second"))
        single = F.filter(
            F.array_except(F.array_union("_first", "_second"), "_shared"),
            lambda at: coin(p, seed, *[F.col(k) for k in keep], at),
        )
        rows = rows.withColumn("_cuts", F.sort_array(F.concat("_shared", single)))
    return explode_units(rows, slice_at(F.encode(text, "UTF-8"), F.col("_cuts"), l_max), keep)


def roundtrip(docs: DataFrame, pattern: str = WORD_PREV, l_max: int | None = 32, text: str = "text") -> DataFrame:
    """Documents checked, byte totals on both sides, and how many do not rebuild exactly."""
    joined = F.array_join(unit_array(text, pattern, l_max), "")
    return docs.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(n_bytes(text)).alias("text_bytes"),
        F.sum(n_bytes(joined)).alias("unit_bytes"),
        F.sum((joined != F.col(text)).cast("bigint")).alias("mismatches"),
    )
