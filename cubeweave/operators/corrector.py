"""Residual correction with a guaranteed bound, by principal components of the residuals that exceed it.

Rows are (id, orig, recon): arrays of whole patches of n values, one after the other, already normalised. A patch
whose residual is longer than eps * sqrt(n) is a violator. Violators are projected on the eigenvectors of their
covariance; the largest coefficients, quantised with bin 2 eps, are kept until the rest is within the bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeweave.operators.entropy import frame, unframe


@dataclass(frozen=True)
class Basis:
    """Rows are components; bin is the quantiser's step and eps the bound per value."""

    vectors: np.ndarray
    eps: float
    bin: float


def _patches(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Residual patches, originals, and the number of patches of each row."""
    counts = batch.column("orig").value_lengths().to_numpy(zero_copy_only=False) // n
    flat = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
    orig, recon = flat("orig"), flat("recon")
    return orig - recon, recon, counts


def moments(rows: DataFrame, n: int, bound: float) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, sums and products of the violating residuals: every task adds up its own, and sends n * (n + 1) + 1 numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + n + n * n)
        for b in batches:
            r, _, _ = _patches(b, n)
            r = r[np.sqrt((r * r).sum(axis=1)) > bound]
            total += np.concatenate([[len(r)], r.sum(axis=0), (r.T @ r).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "x"])

    found = rows.select("orig", "recon").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    total = np.zeros(1 + n + n * n)
    total[found["i"].to_numpy()] = found["x"].to_numpy()
    return int(round(total[0])), total[1 : 1 + n], total[1 + n :].reshape(n, n)


def covariance(rows: DataFrame, n: int) -> np.ndarray:
    """Sample covariance [n, n] of all residuals of rows (orig, recon)."""
    count, sums, products = moments(rows, n, -1.0)
    return (products - np.outer(sums, sums) / count) / (count - 1)


def fit(rows: DataFrame, eps: float, n: int = 64, factor: float = 2.0, components: int | None = None) -> Basis | None:
    """The basis of the violators, by falling eigenvalue; None if nothing violates. Fewer than n violators get the unit vectors."""
    if not 0 < factor <= 2:
        raise ValueError("the bound needs a factor of 2 at most")
    count, sums, products = moments(rows, n, eps * np.sqrt(n))
    if not count:
        return None
    if count < n:
        return Basis(np.eye(n), eps, factor * eps)
    values, vectors = np.linalg.eigh((products - np.outer(sums, sums) / count) / (count - 1))
    return Basis(vectors[:, np.argsort(values)[::-1]].T[:components], eps, factor * eps)


def choose(r: np.ndarray, basis: Basis) -> tuple[np.ndarray, np.ndarray]:
    """(violating, q): which residuals violate, and the kept codes of those, 0 elsewhere."""
    bound2 = basis.eps**2 * r.shape[1]
    bad = (r * r).sum(axis=1) > bound2
    c = r[bad] @ basis.vectors.T
    q = np.rint(c / basis.bin)
    order = np.argsort(-(c * c), axis=1, kind="stable")
    gain = np.take_along_axis(c * c - (c - q * basis.bin) ** 2, order, 1)
    left = (r[bad] ** 2).sum(axis=1)[:, None] - np.cumsum(gain, axis=1) + gain
    keep = np.zeros(c.shape, bool)
    np.put_along_axis(keep, order, left > bound2 * (1 - 1e-12), 1)
    return bad, np.where(keep, q, 0).astype(np.int64)


def pack(bad: np.ndarray, q: np.ndarray) -> bytes:
    """Mask of violators, prefix bits up to each one's last code, their lengths, and codes by dictionary."""
    flags = q != 0
    length = np.where(flags.any(axis=1), q.shape[1] - np.argmax(flags[:, ::-1], axis=1), 0)
    inside = np.arange(q.shape[1])[None] < length[:, None]
    values, codes = np.unique(q[flags], return_inverse=True)
    width = np.uint8 if len(values) < 256 else np.uint16 if len(values) < 32768 else np.uint32
    head = np.array([len(bad), len(values)], np.int64).tobytes() + values.astype(np.int64).tobytes()
    parts = [head, np.packbits(bad).tobytes(), np.packbits(flags[inside]).tobytes(), length.astype(np.uint16).tobytes(), codes.astype(width).tobytes()]
    return frame(parts)


def unpack(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    head, mask, prefix, lengths, codes = unframe(data, 5)
    count, kinds = np.frombuffer(head[:16], np.int64)
    values = np.frombuffer(head[16:], np.int64)
    bad = np.unpackbits(np.frombuffer(mask, np.uint8), count=count).astype(bool)
    length = np.frombuffer(lengths, np.uint16).astype(np.int64)
    inside = np.arange(n)[None] < length[:, None]
    flags = np.zeros(inside.shape, bool)
    flags[inside] = np.unpackbits(np.frombuffer(prefix, np.uint8), count=int(length.sum())).astype(bool)
    width = np.uint8 if kinds < 256 else np.uint16 if kinds < 32768 else np.uint32
    q = np.zeros(inside.shape, np.int64)
    q[flags] = values[np.frombuffer(codes, width)] if kinds else 0
    return bad, q


def compress(rows: DataFrame, basis: Basis, n: int = 64) -> DataFrame:
    """(id, payload) of rows (id, orig, recon); rows without violators have an empty payload."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r, _, counts = _patches(b, n)
            out = []
            for part in np.split(r, np.cumsum(counts)[:-1]):
                bad, q = choose(part, basis)
                out.append(pack(bad, q) if bad.any() else b"")
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.binary())], names=["id", "payload"])

    return rows.select("id", "orig", "recon").mapInArrow(run, "id long, payload binary")


def decompress(rows: DataFrame, basis: Basis, n: int = 64) -> DataFrame:
    """(id, fixed) of rows (id, recon, payload)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for recon, data in zip(b.column("recon").to_pylist(), b.column("payload").to_pylist(), strict=True):
                x = np.array(recon, np.float64).reshape(-1, n)
                if data:
                    bad, q = unpack(data, len(basis.vectors))
                    x[bad] += (q * basis.bin) @ basis.vectors
                out.append(x.ravel())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.list_(pa.float64()))], names=["id", "fixed"])

    return rows.select("id", "recon", "payload").mapInArrow(run, "id long, fixed array<double>")
