"""String and byte expressions used by the unit jobs.  All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Word units: one number character; a letter run that takes a following lone space;
# any other run.  The look-ahead keeps a space out when it belongs to a longer run.
WORD_PREV = r"\p{N}|\p{L}+(?: (?=[\p{L}\p{N}]|\z))?|[^\p{L}\p{N}]+"
# The lone space leads the following letter run instead.
WORD_NEXT = r"(?<![^\p{L}\p{N}]) \p{L}+|\p{N}|\p{L}+|[^\p{L}\p{N}]+"
# Blank runs, runs of ASCII alphanumerics and non-ASCII characters, runs of ASCII symbols.
RUNS = r"[\x09-\x0D ]+|[0-9A-Za-z[^\x00-\x7F]]+|[\x00-\x08\x0E-\x1F!-/:-@\[-`{-\x7F]+"
# Core with trailing delimiters: an ASCII alphanumeric run with a short contraction,
# or one other word character; leading delimiters stand alone.
CORE = r"(?U)(?:[0-9A-Za-z]+(?:'[0-9A-Za-z]{1,2})?|\w)\W*|\W+"

BLANKS = " \t\n\r"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def n_bytes(col) -> Column:
    return F.octet_length(_c(col)).cast("bigint")


def byte_text(col) -> Column:
    """One character per byte (ISO-8859-1 view), so character functions count bytes."""
    return F.decode(F.encode(_c(col), "UTF-8"), "ISO-8859-1")


def byte_levenshtein(a, b) -> Column:
    return F.levenshtein(byte_text(a), byte_text(b)).cast("bigint")


def canonical_form(col) -> Column:
    return F.lower(F.btrim(_c(col), F.lit(BLANKS)))


def char_units(col) -> Column:
    """Indivisible characters of a string."""
    return F.split(_c(col), "")


def chop_bytes(col, size: int) -> Column:
    """Hard cut of a BINARY column every ``size`` bytes; may cut inside a character."""
    raw = _c(col)
    starts = F.sequence(F.lit(0), F.octet_length(raw) - 1, F.lit(size))
    return F.when(F.octet_length(raw) == 0, F.array().cast("array<binary>")).otherwise(
        F.transform(starts, lambda i: F.substring(raw, i + 1, F.lit(size)))
    )


def chunk_chars(col, cap: int) -> Column:
    """Greedy pieces of at most ``cap`` bytes cut between characters.

    A character wider than ``cap`` stays whole.  Pure ASCII is cut by arithmetic;
    only text with wide characters needs the running fold.
    """
    text = _c(col)
    ascii_cut = F.transform(
        F.sequence(F.lit(0), F.length(text) - 1, F.lit(cap)),
        lambda i: F.substring(text, i + 1, F.lit(cap)),
    )
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc, ch):
        full = (F.length(acc["cur"]) > 0) & (F.octet_length(acc["cur"]) + F.octet_length(ch) > cap)
        return F.when(
            full,
            F.struct(F.concat(acc["done"], F.array(acc["cur"])).alias("done"), ch.alias("cur")),
        ).otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["cur"], ch).alias("cur")))

    folded = F.aggregate(char_units(text), start, step, lambda acc: F.concat(acc["done"], F.array(acc["cur"])))
    return (
        F.when(F.octet_length(text) <= cap, F.array(text))
        .when(F.octet_length(text) == F.length(text), ascii_cut)
        .otherwise(folded)
    )


def unit_type(col) -> Column:
    """Coarse class of a unit: space, digitful, symbol, Capitalized, lower or mixed (a fixed rule, the letter ranges included)."""
    text = _c(col)
    return (
        F.when(F.btrim(text, F.lit(BLANKS)) == "", "space")
        .when(text.rlike("[0-9]"), "digitful")
        .when(~text.rlike("[A-Za-z]"), "symbol")
        .when(text.rlike(r"(?U)^\s*\p{Lu}"), "Capitalized")
        .when(~text.rlike("[A-`]"), "lower")
        .otherwise("mixed")
    )
