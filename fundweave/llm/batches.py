"""Small batches: what a worker turns into Python objects at once is bounded by bytes, not rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SIZE = 1 << 20


def by_size(batches: Iterator[pa.RecordBatch], column: int, size: int = SIZE) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose string or binary column holds about `size` bytes.

    A longer value has a slice of its own; rows are never dropped or cut.
    """
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16
        part = np.cumsum(lengths) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lengths)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)
