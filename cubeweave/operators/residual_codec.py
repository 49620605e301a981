"""Residual codec of a block: uniform quantiser with the largest step that meets the bound, Lorenzo, bit planes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cubeweave.operators.entropy import from_planes, plane_streams
from cubeweave.operators.lorenzo import difference, integrate, strict_deltas, strict_inverse, unzigzag, zigzag

LEVEL = 21
BISECTIONS, DOUBLINGS = 16, 40


def sse(x: np.ndarray, guess: np.ndarray, r: np.ndarray, step: float, mean: float, scale: float) -> float:
    """Squared error after quantising r and undoing the normalisation, in 32-bit but for the sum, as a share of scale**2."""
    s = np.float32(step)
    q = np.rint(r / s).astype(np.float32)
    back = (guess + q * s) * np.float32(scale) + np.float32(mean)
    d = (back.astype(np.float64) - x) / scale
    return float((d * d).sum())


def find_step(x: np.ndarray, guess: np.ndarray, r: np.ndarray, target: float, mean: float, scale: float) -> tuple[float, np.ndarray]:
    """(step, codes): the largest step with an error up to target**2 n; step 1 and zeros where r needs no correction."""
    most = target * target * x.size
    if sse(x, guess, np.zeros_like(r), 1.0, mean, scale) <= most:
        return 1.0, np.zeros(r.shape, np.int64)
    low = max(target * np.sqrt(12), 1e-12)
    while sse(x, guess, r, low, mean, scale) > most and low > 1e-12:
        low /= 2
    high = low
    for _ in range(DOUBLINGS):
        high *= 2
        if sse(x, guess, r, high, mean, scale) > most:
            break
        low = high
    for _ in range(BISECTIONS):
        middle = (low + high) / 2
        low, high = (middle, high) if sse(x, guess, r, middle, mean, scale) <= most else (low, middle)
    return low, np.rint(r / np.float32(low)).astype(np.int64)


def find_steps(r: np.ndarray, most: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The largest steps of many blocks of residuals [blocks, cells] at once: DOUBLINGS doublings from low, of which those
    that hold a block's squared error count, and BISECTIONS bisections; no block ends early. 1 where none is needed."""
    def holds(step: np.ndarray) -> np.ndarray:
        d = r - np.rint(r / step[:, None]) * step[:, None]
        return (d * d).sum(axis=1) <= most

    a, b, growing = low.astype(np.float64), 2 * low.astype(np.float64), np.ones(len(r), bool)
    for _ in range(DOUBLINGS):
        growing &= holds(b)
        a, b = np.where(growing, b, a), np.where(growing, 2 * b, b)
    for _ in range(BISECTIONS):
        m = (a + b) / 2
        fits = holds(m)
        a, b = np.where(fits, m, a), np.where(fits, b, m)
    return np.where((r * r).sum(axis=1) <= most, 1.0, a)


def largest_steps(blocks: DataFrame, target: float) -> DataFrame:
    """(id, step) of rows (id, orig, recon) of one length: the steps of an Arrow batch are searched together. They
    begin at target / 1000, which holds any block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                flat = lambda c: b.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)  # noqa: B023,E731
                r = flat("orig") - flat("recon")
                step = find_steps(r, np.full(len(r), target * target * r.shape[1]), np.full(len(r), target / 1000))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(step)], names=["id", "step"])

    return blocks.select("id", "orig", "recon").mapInArrow(run, "id long, step double")


def encode_block(orig: np.ndarray, recon: np.ndarray, target: float, mean: float, scale: float, bias: np.ndarray | None = None, d_scale: float = 1.0) -> tuple[float, int, list[bytes]]:
    """(step, planes, streams) of one block [t, h, w]."""
    x = orig.astype(np.float64)
    guess = ((recon.astype(np.float32) - np.float32(mean)) / np.float32(scale)).astype(np.float32)
    r = ((orig.astype(np.float32) - np.float32(mean)) / np.float32(scale)).astype(np.float32) - guess
    step, q = find_step(x, guess, r, target, mean, scale)
    d = difference(q) if bias is None else strict_deltas(q, bias, d_scale)
    n, streams = plane_streams(zigzag(d).ravel(), LEVEL)
    if not np.array_equal(decode_codes(streams, q.shape, bias, d_scale), q):
        raise AssertionError("codes don't come back")
    return step, n, streams


def decode_codes(streams: Sequence[bytes], shape: Sequence[int], bias: np.ndarray | None = None, d_scale: float = 1.0) -> np.ndarray:
    d = unzigzag(from_planes(streams, int(np.prod(shape)))).reshape(shape)
    return integrate(d) if bias is None else strict_inverse(d, bias, d_scale)


def decode_block(recon: np.ndarray, step: float, streams: Sequence[bytes], mean: float, scale: float) -> np.ndarray:
    guess = (recon.astype(np.float32) - np.float32(mean)) / np.float32(scale)
    q = decode_codes(streams, recon.shape).astype(np.float32)
    return (guess + q * np.float32(step)) * np.float32(scale) + np.float32(mean)


def compress(blocks: DataFrame, target: float, mean: float, scale: float) -> DataFrame:
    """(id, step, bit_count, streams) of rows (id, shape array<int>, orig, recon); blocks may be of any shape. A scale of 0 is an error."""
    if not scale > 0:
        raise ValueError("all values are equal: there is nothing to correct")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [encode_block(np.array(o, np.float32).reshape(s), np.array(g, np.float32).reshape(s), target, mean, scale) for s, o, g in zip(*(b.column(c).to_pylist() for c in ("shape", "orig", "recon")), strict=True)]
            step, bits, streams = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(step, pa.float64()), pa.array(bits, pa.int32()), pa.array(streams, pa.list_(pa.binary()))], names=["id", "step", "bit_count", "streams"])

    return blocks.select("id", "shape", "orig", "recon").mapInArrow(run, "id long, step double, bit_count int, streams array<binary>")


def decompress(blocks: DataFrame, mean: float, scale: float) -> DataFrame:
    """(id, fixed) of rows (id, shape, recon, step, streams)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [decode_block(np.array(g, np.float32).reshape(s), st, z, mean, scale).ravel() for s, g, st, z in zip(*(b.column(c).to_pylist() for c in ("shape", "recon", "step", "streams")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.list_(pa.float32()))], names=["id", "fixed"])

    return blocks.select("id", "shape", "recon", "step", "streams").mapInArrow(run, "id long, fixed array<float>")
