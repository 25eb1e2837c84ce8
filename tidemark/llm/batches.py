"""Bounded pieces of Arrow batch streams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20


def slices(batches, column: int, max_bytes: int = SLICE_BYTES):
    """The batches in pieces whose ``column`` (text or binary) holds about
    ``max_bytes``; a single longer value is a piece of its own."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        piece = (np.cumsum(size.astype(np.int64) + 64) - 1) // max_bytes
        cuts = np.r_[0, np.flatnonzero(piece[1:] != piece[:-1]) + 1, b.num_rows]
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield b.slice(lo, hi - lo)


def groups(batches, n_keys: int):
    """Whole groups (runs of equal values in the first ``n_keys`` columns) of
    a sorted stream, as tables; a group is bounded by its maker."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = [b.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)]
        change = np.zeros(b.num_rows - 1, bool)
        for k in keys:
            change |= k[1:] != k[:-1]
        cuts = np.r_[0, np.flatnonzero(change) + 1, b.num_rows]
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            now = tuple(k[lo] for k in keys)
            if now != last and held:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            last = now
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
