"""What Python workers hold: one cache at a time, and Arrow columns in small parts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa

#: Rows of a batch that are Python objects at once.
ROWS = 256
_held: dict[Hashable, object] = {}
_libc = ctypes.CDLL(None)


def held(key: Hashable, make: Callable[[], object]):
    """The object made for ``key``; what was held for another key before is let go, as workers outlive stages."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Let go what is held, at the start of work that holds nothing."""
    if _held:
        _held.clear()
        trim()


def trim() -> None:
    """Give memory that is free back to the system: idle workers stay beside the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def parts(column: pa.Array, rows: int = ROWS) -> Iterator[list]:
    """The values of an Arrow array, some rows at a time."""
    for low in range(0, len(column), rows):
        yield column.slice(low, rows).to_pylist()
