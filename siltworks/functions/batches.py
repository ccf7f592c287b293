"""Arrow batches inside Python workers: small slices, and memory given back."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text or tokens that a worker takes at once; a longer text stands alone, whole.
SLICE_BYTES = 2 << 20


def text_slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Slices of about SLICE_BYTES of a column of strings or (nested) lists of strings each: what Python makes of a batch stays small."""
    import numpy as np

    for batch in batches:
        lists = batch.column(column)
        bounds = np.arange(len(lists) + 1)
        while pa.types.is_list(lists.type):
            offsets = lists.offsets.to_numpy()
            bounds, lists = (offsets - offsets[0])[bounds], lists.flatten()
        sizes = pc.fill_null(pc.binary_length(lists), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[bounds]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_BYTES, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def frugal(run: Callable) -> Callable:
    """For functions over Arrow batches: at the end of a task, memory that is free again goes back to the system.

    Spark keeps a worker's process for the next task; without this each holds its highest level.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
            if trim is not None:
                trim(0)

    return wrapped
