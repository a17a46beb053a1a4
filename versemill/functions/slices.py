"""Rows of an Arrow batch in slices of bounded size, for functions that make Python objects of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18  # of the rows whose values are Python objects at once: a batch has thousands of rows, of texts of any length
LONGEST_KEPT = 64  # characters of what is kept for later look-ups


def _sizes(column: pa.Array) -> np.ndarray:
    """Bytes of each row's text, or of a list's texts as if all of a batch were as long; of other values none."""
    kind, zeros = column.type, np.zeros(len(column), np.int64)
    if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
        return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) * -(-column.nbytes // max(1, len(column.values)))
    return zeros


def in_slices(*columns: pa.Array) -> Iterator[tuple[list, ...]]:
    """The columns' values, as lists, in slices of SLICE_BYTES, or of one row that is larger. An Arrow function may give each
    slice's results as an array of their own."""
    n = len(columns[0])
    ends = np.cumsum(sum(_sizes(c) for c in columns) + np.ones(n, np.int64))
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield tuple(c.slice(at, end - at).to_pylist() for c in columns)
        at = end
