"""Index arithmetic on the axes of a dense array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column, n: int | Column) -> Column:
    """Whole-number division of non-negative numbers, as long."""
    return F.floor(a / n).cast("long")


def linear(axes: list[tuple[Column, int]]) -> Column:
    """Row-major position from (index, size) of each axis."""
    at = F.lit(0).cast("long")
    for c, size in axes:
        at = at * size + c
    return at


def unravel(i: Column, sizes: list[int]) -> list[Column]:
    """Indexes on each axis of a row-major position."""
    out, stride = [], 1
    for size in reversed(sizes):
        out.append(F.pmod(div(i, stride), F.lit(size)).cast("long"))
        stride *= size
    return out[::-1]


def reflect(i: Column, size: int) -> Column:
    """Mirror an index into 0 .. size - 1; the border element is not repeated."""
    return F.when(i < 0, -i).when(i >= size, 2 * (size - 1) - i).otherwise(i)


def pad_sides(size: int, multiple: int) -> tuple[int, int]:
    """Centred padding up to a multiple: before and after."""
    d = -size % multiple
    return d // 2, d - d // 2


def tail_pad(frames: int, window: int, overlap: int = 0) -> tuple[int, int]:
    """(number of windows, frames to append) so that windows at steps of window - overlap fill the axis."""
    step = window - overlap
    samples = max(0, -(-(frames - window) // step)) + 1
    return samples, (samples - 1) * step + window - frames
