"""Runs of rows that one Python task receives in order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of whole runs of equal ``keys``, with about ``rows`` rows or one longer run.

    Rows arrive sorted by ``keys``; a batch without rows is never given.
    """
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            held.append(batch.slice(at, rows))
            n += held[-1].num_rows
            if n < rows:
                continue
            whole = pa.concat_batches(held)
            columns = [whole.column(k).to_numpy(zero_copy_only=False) for k in keys]
            starts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            end = int(starts[-1]) if starts.size else 0
            if end:
                yield whole.slice(0, end)
            held = [whole.slice(end)]
            n = whole.num_rows - end
    if n:
        yield pa.concat_batches(held)
