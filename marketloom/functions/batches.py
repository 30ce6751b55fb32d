"""Series in sorted Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def series_cuts(batch: pa.RecordBatch, keys: list[str]) -> list[tuple[int, int]]:
    """(start, end) of the runs of rows with equal keys; nulls are equal to each other."""
    new = np.zeros(batch.num_rows, dtype=bool)
    for key in keys:
        codes = np.asarray(pc.fill_null(batch.column(key).dictionary_encode().indices, -1))
        new[1:] |= codes[1:] != codes[:-1]
    starts = [0, *np.flatnonzero(new).tolist()]
    return list(zip(starts, [*starts[1:], batch.num_rows], strict=True)) if batch.num_rows else []


def doubles(batch: pa.RecordBatch, *columns: str) -> list[np.ndarray]:
    """Columns as doubles, nulls as NaN."""
    return [pc.cast(batch.column(c), pa.float64()).to_numpy(zero_copy_only=False) for c in columns]
