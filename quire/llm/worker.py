"""What operators keep in Python workers, which Spark reuses from one operator to the next: bounded, one owner at a time."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute

#: Text bytes that a worker turns into Python objects at once.
BLOCK_BYTES = 2 << 20

_owner = ""
_kept: dict = {}


def memory(owner: str) -> dict:
    """The dictionary that ``owner`` keeps in this worker; what another operator kept goes."""
    global _owner
    if owner != _owner:
        for x in _kept.values():
            if isinstance(x, dict):
                x.clear()
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _owner = owner
    return _kept


def blocks(batch: pa.RecordBatch, column: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``most`` bytes of ``column``, or one row."""
    start, total = 0, 0
    for i, n in enumerate(pa.compute.binary_length(batch.column(column)).to_pylist()):
        if total and total + (n or 0) > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)
