"""Small numeric expressions shared by the reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ratio(num, den) -> Column:
    """``num / max(den, 1)`` as DOUBLE."""
    return _c(num).cast("double") / F.greatest(_c(den).cast("double"), F.lit(1.0))


def stderr(p, n) -> Column:
    return F.sqrt(F.greatest(_c(p) * (1 - _c(p)), F.lit(0.0)) / F.greatest(_c(n), F.lit(1)))


def bits_per_byte(nll, size) -> Column:
    return _c(nll) * F.lit(math.log2(math.e)) / F.greatest(_c(size), F.lit(1))


def boundary_weight(doc_start="doc_start") -> Column:
    """0 where the target is a document's first unit, else 1."""
    return F.when(_c(doc_start), F.lit(0.0)).otherwise(F.lit(1.0))


def weighted_mean(value, weight) -> Column:
    return F.sum(_c(value) * _c(weight)) / F.greatest(F.sum(_c(weight)), F.lit(1.0))


def log_sum_exp(values) -> Column:
    """Stable log-sum-exp over an ARRAY<DOUBLE>."""
    values = _c(values)
    top = F.array_max(values)
    return top + F.log(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.exp(x - top)))


def first_target(targets) -> Column:
    """The target that counts where an item has a list of them: the first, or an unknown one if there is none."""
    return F.coalesce(F.get(_c(targets), F.lit(0)).cast("string"), F.lit(""))


def gold_index(target, choices) -> Column:
    """Index of the right answer: digits are an index, text is looked up, unknown is -1."""
    target, choices = _c(target), _c(choices)
    return F.when(target.rlike("^[0-9]+$"), target.try_cast("int")).otherwise(
        F.coalesce(F.array_position(choices, target).cast("int") - 1, F.lit(-1))
    )
