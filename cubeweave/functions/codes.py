"""Quantiser, zig-zag and bit functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantize(x: Column, step: float | Column) -> Column:
    """Nearest multiple of step, halves to even, as a whole number."""
    return F.rint(x / step).cast("long")


def zigzag(v: Column) -> Column:
    """0, -1, 1, -2, ... to 0, 1, 2, 3, ..."""
    return F.when(v >= 0, 2 * v).otherwise(-2 * v - 1)


def unzigzag(u: Column) -> Column:
    return F.when(u % 2 == 0, F.shiftright(u, 1)).otherwise(-F.shiftright(u + 1, 1))


def bit(u: Column, plane: Column | int) -> Column:
    """One bit of a non-negative number."""
    return F.getbit(u, plane if isinstance(plane, Column) else F.lit(plane)).cast("long")


def planes(largest: Column) -> Column:
    """Bit planes that a largest code needs, one at least."""
    return F.greatest(F.lit(1), F.length(F.bin(largest))).cast("long")


def byte_of(bit_: Column, place: Column, msb_first: bool) -> Column:
    """What a bit adds to its byte; sum it over the eight places."""
    at = 7 - place % 8 if msb_first else place % 8
    return bit_ * F.pow(F.lit(2.0), at).cast("long")


def index_width(n: Column) -> Column:
    """Bytes of an index into a dictionary of n values: below 256 one, below 32768 two, else four."""
    return F.when(n < 256, 1).when(n < 32768, 2).otherwise(4)


def quantize_around(x: Column, offset: Column | float = 0.0) -> Column:
    """Nearest whole number of x - offset, halves to even, with the offset put back."""
    return F.rint(x - offset) + offset


def clamp(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """x no lower and no higher than the bounds given."""
    x = F.greatest(x, F.lit(low)) if low is not None else x
    return F.least(x, F.lit(high)) if high is not None else x


def scale_row(scale: Column, scales: list[float]) -> Column:
    """How many of all but the last entries of a table of scales lie strictly below the scale, which counts as the first at least."""
    return F.size(F.filter(F.array(*map(F.lit, scales[:-1])), lambda s: s < F.greatest(scale, F.lit(scales[0])))).cast("int")


def normal_likelihood(x: Column, scale: Column) -> Column:
    """Probability of the unit bin around x under a centred normal distribution, 1e-9 at least.

    erfc by a rational approximation with an error below 1.2e-7 of its value, since SQL has none.
    """

    def erfc(z: Column) -> Column:
        a = F.abs(z)
        t = 1 / (1 + 0.5 * a)
        poly = F.lit(0.17087277)
        for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
            poly = poly * t + c
        got = t * F.exp(-a * a + poly)
        return F.when(z >= 0, got).otherwise(2 - got)

    root = scale * (2.0**0.5)
    return F.greatest((erfc((F.abs(x) - 0.5) / root) - erfc((F.abs(x) + 0.5) / root)) / 2, F.lit(1e-9))


def noisy(x: Column, key: Column, seed: int) -> Column:
    """x with noise from -0.5 to 0.5 drawn from a whole number and a seed: what stands for rounding in training."""
    return x + F.pmod(F.pmod(key, F.lit(2147483647)) * 1103515245 + seed * 12345, F.lit(2147483648)) / 2147483648.0 - 0.5
