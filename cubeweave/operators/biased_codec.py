"""Residual codec with one global step and a learned causal bias.

One step for the whole array is searched so that the NRMSE is met; codes are predicted from causal neighbours by the
Lorenzo rule plus a bias, a linear function of the neighbours' differences that is fitted here on all blocks, and the
differences are packed as bit planes. Blocks are rows and are coded independently.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeweave.operators.entropy import from_planes, plane_streams
from cubeweave.operators.lorenzo import difference, strict_deltas, strict_inverse, unzigzag, zigzag
from cubeweave.scratch import drop_table, materialize

BISECTIONS, SHRINK = 24, 0.999999
#: Doublings, halvings or shrinkings that one pass tries.
AHEAD = 16
FEATURES = 7


class _Residuals:
    """Residuals of rows (x, y), written once; a pass over them is one aggregate that tries a grid of steps."""

    def __init__(self, pairs: DataFrame, target: float) -> None:
        self.r = materialize(pairs.select("x", (F.col("x") - F.col("y")).alias("r")), "residuals")
        self.n, low, high, self.raw = self.r.agg(F.count("*"), F.min("x"), F.max("x"), F.sum(F.col("r") * F.col("r"))).first()
        self.empty = low is None
        self.span = (high or 0.0) - (low or 0.0)
        self.most = (target * self.span) ** 2 * self.n
        self.known: dict[float, bool] = {}

    def holds(self, step: float, ahead: Sequence[float]) -> bool:
        if step not in self.known:
            steps = list(dict.fromkeys([step, *ahead]))
            r = F.col("r")
            sums = self.r.agg(*[F.sum(F.pow(r - F.rint(r / st) * st, 2)) for st in steps]).first()
            self.known.update((st, x <= self.most) for st, x in zip(steps, sums, strict=True))
        return self.known[step]

    def bisected(self, a: float, b: float, rounds: int) -> float:
        """The largest step that held between a and b, four bisections ahead."""
        for _ in range(rounds):
            m = (a + b) / 2
            a, b = (m, b) if self.holds(m, _middles(a, b, 4)) else (a, m)
        return a


def _middles(a: float, b: float, depth: int) -> list[float]:
    m = (a + b) / 2
    return [m, *_middles(a, m, depth - 1), *_middles(m, b, depth - 1)] if depth else []


def global_step(pairs: DataFrame, target: float, *, bisections: int = BISECTIONS) -> tuple[float, float]:
    """(step, range) for rows (x, y): the largest step found by bisection with an NRMSE up to target, made smaller until it holds.

    1 where no correction is needed.
    """
    r = _Residuals(pairs, target)
    if not r.n or r.raw <= r.most:
        drop_table(r.r)
        return 1.0, r.span
    a = b = target * r.span * np.sqrt(12)
    while r.holds(b, [b * 2.0**k for k in range(AHEAD)]):
        a, b = b, 2 * b
    while not r.holds(a, [a / 2.0**k for k in range(AHEAD)]):
        a /= 2
    a = r.bisected(a, b, bisections)
    while not r.holds(a, [a * SHRINK**k for k in range(AHEAD)]):
        a *= SHRINK
    drop_table(r.r)
    return float(a), float(r.span)


def step_upwards(pairs: DataFrame, target: float, *, doublings: int = 12, bisections: int = BISECTIONS) -> float | None:
    """The step that is searched from target * range * sqrt(12) upwards only, for rows (x, y) of any NRMSE: up to so many
    doublings while it holds, then bisections. None where the first step doesn't hold, or there is no range."""
    r = _Residuals(pairs, target)
    first = target * r.span * np.sqrt(12)
    tried = [float(first * 2.0**k) for k in range(doublings)]
    held = 0
    if not r.empty and first > 0:
        while held < doublings and r.holds(tried[held], tried):
            held += 1
    a = r.bisected(tried[held - 1], 2 * tried[held - 1], bisections) if held else None
    drop_table(r.r)
    return a


def features(q: np.ndarray) -> np.ndarray:
    """Differences of causal neighbours [cells, FEATURES] that the bias is linear in."""
    p = np.pad(q.astype(np.float64), ((1, 0),) * 3)
    t, h, w = p[:-1, 1:, 1:], p[1:, :-1, 1:], p[1:, 1:, :-1]
    th, tw, hw, thw = p[:-1, :-1, 1:], p[:-1, 1:, :-1], p[1:, :-1, :-1], p[:-1, :-1, :-1]
    return np.stack([t - th, t - tw, h - hw, h - th, w - hw, w - tw, thw - th], axis=-1).reshape(-1, FEATURES)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple]:
    for i, shape, q in zip(batch.column("id").to_pylist(), batch.column("shape").to_pylist(), batch.column("q").to_pylist(), strict=True):
        yield i, np.array(q, np.int64).reshape(shape)


def fit_bias(blocks: DataFrame, ridge: float = 1.0) -> np.ndarray:
    """Weights of the bias by least squares over all cells of rows (id, shape, q): tasks send FEATURES * (FEATURES + 1) sums each."""
    size = FEATURES * (FEATURES + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            for _, q in _blocks(b):
                f, d = features(q), difference(q).ravel()
                total += np.r_[(f.T @ f).ravel(), f.T @ d]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["i", "x"])

    sums = np.zeros(size)
    for r in blocks.select("id", "shape", "q").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        sums[r["i"]] = r["x"]
    gram = sums[: FEATURES**2].reshape(FEATURES, FEATURES)
    return np.round(np.linalg.solve(gram + ridge * np.eye(FEATURES), sums[FEATURES**2 :]), 6)


def encode_codes(q: np.ndarray, weights: np.ndarray) -> tuple[int, list[bytes]]:
    """Planes and streams of a block; the decoder sees the same neighbours and so the same bias."""
    bias = (features(q) @ weights).reshape(q.shape)
    n, streams = plane_streams(zigzag(strict_deltas(q, bias)).ravel())
    return n, streams


def decode_codes(streams: Sequence[bytes], shape: Sequence[int], weights: np.ndarray) -> np.ndarray:
    """Cells in wavefronts t + h + w, for the bias of a cell needs its neighbours' codes."""
    d = unzigzag(from_planes(streams, int(np.prod(shape)))).reshape(shape)
    if not weights.any():
        return strict_inverse(d)
    q = np.zeros(tuple(n + 1 for n in shape), np.int64)
    t, h, w = np.indices(shape).reshape(3, -1)
    front = t + h + w
    order = np.argsort(front, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(front[order])) + 1):
        a, b, c = t[part] + 1, h[part] + 1, w[part] + 1
        nt, nh, nw = q[a - 1, b, c], q[a, b - 1, c], q[a, b, c - 1]
        th, tw, hw, thw = q[a - 1, b - 1, c], q[a - 1, b, c - 1], q[a, b - 1, c - 1], q[a - 1, b - 1, c - 1]
        f = np.stack([nt - th, nt - tw, nh - hw, nh - th, nw - hw, nw - tw, thw - th], axis=-1).astype(np.float64)
        pred = nt + nh + nw - th - tw - hw + thw
        q[a, b, c] = d[t[part], h[part], w[part]] + np.rint(pred + f @ weights).astype(np.int64)
    return q[1:, 1:, 1:]


def compress(blocks: DataFrame, weights: np.ndarray) -> DataFrame:
    """(id, bit_count, streams) of rows (id, shape, q). Every block is decoded again before it is handed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, q in _blocks(b):
                n, streams = encode_codes(q, weights)
                if not np.array_equal(decode_codes(streams, q.shape, weights), q):
                    raise AssertionError("codes don't come back")
                out.append((i, n, streams))
            i, n, streams = zip(*out, strict=True) if out else ((),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(n, pa.int32()), pa.array(streams, pa.list_(pa.binary()))], names=["id", "bit_count", "streams"])

    return blocks.select("id", "shape", "q").mapInArrow(run, "id long, bit_count int, streams array<binary>")


def decompress(coded: DataFrame, weights: np.ndarray) -> DataFrame:
    """(id, q) of rows (id, shape, streams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [decode_codes(s, shape, weights).ravel() for shape, s in zip(b.column("shape").to_pylist(), b.column("streams").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.list_(pa.int64()))], names=["id", "q"])

    return coded.select("id", "shape", "streams").mapInArrow(run, "id long, q array<bigint>")


def moving_average(old: float | np.ndarray, new: float | np.ndarray, beta: float = 0.995) -> float | np.ndarray:
    """Exponential moving average of weights."""
    return old * beta + (1 - beta) * new
