"""Hashes of all windows of an array, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def windows_of(hashes: str, width: int) -> Column:
    """The hashes of all windows of ``width`` neighbours of an array column of 64-bit numbers.

    The numbers are read at their places, no window is cut out as an array of its own. An
    array shorter than a window has none; a null array gives null.
    """
    first = F.slice(hashes, 1, F.greatest(F.size(hashes) - (width - 1), F.lit(0)))
    return F.transform(first, lambda v, i: F.xxhash64(v, *(F.get(hashes, i + k) for k in range(1, width))))
