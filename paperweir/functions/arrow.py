"""Arrow batches in small parts, so that a Python worker holds little at a time."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a part holds, if it has more than one row.
PART_BYTES = 1 << 20

_libc = ctypes.CDLL("libc.so.6") if sys.platform == "linux" else None


def parts(batches: Iterator[pa.RecordBatch], text: int | str) -> Iterator[pa.RecordBatch]:
    """Slices of batches of at most PART_BYTES of the text column each, or of one row. What is free goes back to the system after
    each batch: a worker lives on after its task, and what it keeps counts against the next."""
    for batch in batches:
        column = batch.column(text)
        offsets = column.cast(pa.large_binary()).buffers()[1]
        offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets is not None and len(column) else np.zeros(1, np.int64)
        lo = 0
        while lo < len(column):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PART_BYTES, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi
        del batch, column, offsets
        pa.default_memory_pool().release_unused()
        if _libc is not None:
            _libc.malloc_trim(0)
