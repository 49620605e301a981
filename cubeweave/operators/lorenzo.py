"""Lorenzo differencing over the three axes of a block, by windows over cells and by numpy over blocks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

AXES = ("t", "h", "w")


def _lines(axis: str, block: Sequence[str]):
    return Window.partitionBy(*block, *[a for a in AXES if a != axis]).orderBy(axis)


def lorenzo(codes: DataFrame, block: Sequence[str], q: str = "q", out: str = "d") -> DataFrame:
    """Differences along each axis in turn: the 7-neighbour Lorenzo residual, zeros outside the block."""
    rows = codes.withColumn(out, F.col(q).cast("long"))
    for axis in AXES:
        rows = rows.withColumn(out, F.col(out) - F.lag(out, 1, 0).over(_lines(axis, block)))
    return rows


def inverse_lorenzo(deltas: DataFrame, block: Sequence[str], d: str = "d", out: str = "q") -> DataFrame:
    """Running sums along each axis in turn."""
    rows = deltas.withColumn(out, F.col(d).cast("long"))
    for axis in AXES:
        rows = rows.withColumn(out, F.sum(out).over(_lines(axis, block).rowsBetween(Window.unboundedPreceding, 0)))
    return rows


def context(codes: DataFrame, block: Sequence[str], q: str = "q") -> DataFrame:
    """The seven causal neighbours of each cell (0 outside) and the Lorenzo prediction from them.

    Names say which axes are one back: n_t, n_h, n_w, n_th, n_tw, n_hw, n_thw.
    """
    rows = codes.withColumn("n_", F.col(q).cast("long"))
    back = [""]
    for axis in AXES:
        w = _lines(axis, block)
        rows = rows.select("*", *[F.lag(f"n_{b}", 1, 0).over(w).alias(f"n_{b}{axis}") for b in back])
        back += [b + axis for b in back]
    plus, minus = ("t", "h", "w", "thw"), ("th", "tw", "hw")
    pred = sum((F.col(f"n_{b}") for b in plus), F.lit(0)) - sum((F.col(f"n_{b}") for b in minus), F.lit(0))
    return rows.drop("n_").withColumn("pred", pred.cast("long"))


def gradients(cells: DataFrame, block: Sequence[str], x: str = "x") -> DataFrame:
    """Backward differences along each axis, 0 at the edge, and their sizes: g_t, g_h, g_w, a_t, a_h, a_w."""
    for axis in AXES:
        cells = cells.withColumn(f"g_{axis}", F.col(x) - F.coalesce(F.lag(x).over(_lines(axis, block)), F.col(x)))
    return cells.select("*", *[F.abs(f"g_{a}").alias(f"a_{a}") for a in AXES])


def difference(q: np.ndarray) -> np.ndarray:
    """lorenzo() of one block, in 64-bit."""
    d = q.astype(np.int64)
    for axis in range(d.ndim):
        d = np.diff(d, axis=axis, prepend=0)
    return d


def integrate(d: np.ndarray) -> np.ndarray:
    for axis in range(d.ndim):
        d = np.cumsum(d, axis=axis, dtype=np.int64)
    return d


def zigzag(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.int64)
    return np.where(v >= 0, 2 * v, -2 * v - 1).astype(np.uint64)


def unzigzag(u: np.ndarray) -> np.ndarray:
    u = u.astype(np.int64)
    return np.where(u & 1, -((u + 1) >> 1), u >> 1)


def strict_deltas(q: np.ndarray, bias: np.ndarray | None = None, scale: float = 1.0) -> np.ndarray:
    """q minus its causal prediction rint(Lorenzo + bias * scale); without a bias this is difference()."""
    d = difference(q)
    if bias is None:
        return d
    pred = q.astype(np.int64) - d
    return q.astype(np.int64) - np.rint(pred + bias * scale).astype(np.int64)


def strict_inverse(d: np.ndarray, bias: np.ndarray | None = None, scale: float = 1.0) -> np.ndarray:
    """The inverse of strict_deltas, a wavefront t + h + w after the other, all contexts being known by then."""
    if bias is None:
        return integrate(d)
    nt, nh, nw = d.shape
    q = np.zeros((nt + 1, nh + 1, nw + 1), np.int64)
    t, h, w = np.indices(d.shape).reshape(3, -1)
    front = t + h + w
    order = np.argsort(front, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(front[order])) + 1):
        a, b, c = t[part] + 1, h[part] + 1, w[part] + 1
        pred = q[a - 1, b, c] + q[a, b - 1, c] + q[a, b, c - 1] - q[a - 1, b - 1, c] - q[a - 1, b, c - 1] - q[a, b - 1, c - 1] + q[a - 1, b - 1, c - 1]
        q[a, b, c] = d[t[part], h[part], w[part]] + np.rint(pred + bias[t[part], h[part], w[part]] * scale).astype(np.int64)
    return q[1:, 1:, 1:]
