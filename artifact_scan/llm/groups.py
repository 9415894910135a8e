"""Streaming over sorted groups inside ``mapInArrow``, and small helpers for them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def grouped(batches, keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, starts, ends) with whole groups only, from batches sorted by integer ``keys``.

    Only the group that the last batch may continue is held back.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if len(held) > 1 and _key(held[0], keys, 0) == _key(batch, keys, -1):
            continue  # one group so far
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        starts = _starts(rows, keys)
        if len(starts) > 1:
            yield rows.slice(0, int(starts[-1])), starts[:-1], starts[1:]
        held = [rows.slice(int(starts[-1]))]
    if held:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        starts = _starts(rows, keys)
        yield rows, starts, np.append(starts[1:], rows.num_rows)


def _key(batch: pa.RecordBatch, keys: list[str], at: int) -> tuple:
    at = at % batch.num_rows
    return tuple(batch.column(k)[at].as_py() for k in keys)


def _starts(rows: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    change = np.ones(rows.num_rows, bool)
    change[1:] = False
    for k in keys:
        x = rows.column(k).to_numpy(zero_copy_only=False)
        change[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(change)


def forest(links: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix, the least index of each index's component."""
    n = len(links)
    root = np.arange(n)
    while True:
        near = np.where(links, root[None, :], n).min(1)
        new = np.minimum(root, near)
        new = new[new]
        if (new == root).all():
            return root
        root = new
