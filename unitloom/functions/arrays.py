"""Array expressions Spark's built-ins only offer in quadratic time.

A running sum over an array by ``aggregate`` copies the result once per element.
These two Arrow functions work on the flat child buffers of a whole batch instead,
so they stay linear and touch no element one by one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, functions as F, types as T

#: Rows worked on at a time: a batch holds thousands of whole texts, and each of their pieces takes several numbers.
ROWS_TOGETHER = 256


def _in_slices(work: Callable[..., pa.Array], *columns: pa.Array) -> pa.Array:
    """``work`` on some rows at a time, so that its memory doesn't follow the batch."""
    lows = range(0, max(len(columns[0]), 1), ROWS_TOGETHER)
    return pa.concat_arrays([work(*[c.slice(low, ROWS_TOGETHER) for c in columns]) for low in lows])


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, row starts, row sizes) of a list array; null rows count as empty."""
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if lists.null_count:
        sizes[lists.is_null().to_numpy(zero_copy_only=False)] = 0
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return values, starts, sizes


@F.arrow_udf(T.ArrayType(T.LongType()))
def _start_offsets(lengths: pa.Array) -> pa.Array:
    return _in_slices(_offset_rows, lengths)


def _offset_rows(lengths: pa.Array) -> pa.Array:
    values, starts, sizes = _flat(lengths)
    running = np.concatenate([[0], np.cumsum(values)])
    begin = running[:-1] - np.repeat(running[starts[:-1]], sizes)
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(begin, pa.int64()))


def start_offsets(lengths: Column) -> Column:
    """Exclusive running sum of an ARRAY<INT>: where every piece starts."""
    return _start_offsets(lengths)


def _slice_rows(raw: pa.Array, cuts: pa.Array, l_max: int) -> pa.Array:
    raw = raw.cast(pa.large_binary())
    sizes = np.array(pa.compute.binary_length(raw).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    base = np.concatenate([[0], np.cumsum(sizes)])
    values, _, n_cuts = _flat(cuts)
    row = np.concatenate([np.repeat(np.arange(len(sizes)), n_cuts), np.arange(len(sizes))[sizes > 0]])
    at = np.concatenate([values + np.repeat(base[:-1], n_cuts), base[:-1][sizes > 0]])
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    ends = np.append(at[1:], base[-1])
    pieces = np.maximum(-(-(ends - at) // l_max), 1)
    first = np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = np.repeat(at, pieces) + (np.arange(pieces.sum()) - first) * l_max
    row = np.repeat(row, pieces)
    flat = pa.array([b"".join(raw.drop_null().to_pylist())], pa.large_binary())
    data = flat.buffers()[2]
    bounds = np.append(at, base[-1]).astype(np.int64)
    units = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), data]).cast(pa.binary())
    per_row = np.bincount(row, minlength=len(sizes)) if len(row) else np.zeros(len(sizes), dtype=np.int64)
    list_offsets = np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(list_offsets, pa.int32()), units)


def slice_at(raw: Column, cuts: Column, l_max: int) -> Column:
    """Cut a BINARY at inner byte offsets, then hard-cut pieces over ``l_max`` bytes."""

    @F.arrow_udf(T.ArrayType(T.BinaryType()))
    def cut(data: pa.Array, at: pa.Array) -> pa.Array:
        return _in_slices(lambda some, places: _slice_rows(some, places, l_max), data, at)

    return cut(raw, cuts)
