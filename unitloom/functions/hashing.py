"""Reproducible hashes: every sample, coin and shuffle in the package comes from here.

The value is the top 60 bits of MD5 over the key columns joined with ``|``, so any
SQL engine can recompute a sample row by row; no generator state is carried.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HASH_SPAN = 1 << 60


def id_hash(*keys) -> Column:
    """60-bit non-negative BIGINT hash of the given columns or literals."""
    parts = [k if isinstance(k, Column) else F.col(k) for k in keys]
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def hash01(seed, *keys) -> Column:
    """Uniform double in [0, 1) that depends only on seed and keys."""
    return id_hash(F.lit(str(seed)), *keys) / F.lit(float(HASH_SPAN))


def coin(p: float, seed, *keys) -> Column:
    """True with probability ``p``, decided by the keys alone."""
    return id_hash(F.lit(str(seed)), *keys) < F.lit(int(p * HASH_SPAN))
