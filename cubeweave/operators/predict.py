"""Predictors: what stands in for a learned transform. Each codes a block [frames, height, width] and decodes it alike."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeweave.functions.index import div
from cubeweave.operators.entropy import unzstd, zstd
from cubeweave.operators.layout import keyframes

Coder = tuple[Callable[[np.ndarray], bytes], Callable[[bytes, tuple[int, ...]], np.ndarray]]
STEP = 1 / 4096


def _codes(x: np.ndarray) -> bytes:
    return zstd(np.clip(np.rint(x / STEP), -(1 << 15), (1 << 15) - 1).astype("<i2").tobytes())


def _values(data: bytes, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(unzstd(data), "<i2").reshape(shape).astype(np.float64) * STEP


def mean_encode(x: np.ndarray) -> bytes:
    """The mean of each frame."""
    return _codes(x.mean(axis=(1, 2)))


def mean_decode(data: bytes, shape: tuple[int, ...]) -> np.ndarray:
    return np.broadcast_to(_values(data, (shape[0], 1, 1)), shape).copy()


def _edges(n: int, k: int = 4) -> np.ndarray:
    return np.arange(0, n, k)


def coarse_encode(x: np.ndarray) -> bytes:
    """Means over 4 x 4 cells."""
    sums = np.add.reduceat(np.add.reduceat(x, _edges(x.shape[1]), axis=1), _edges(x.shape[2]), axis=2)
    area = np.diff(np.r_[_edges(x.shape[1]), x.shape[1]])[:, None] * np.diff(np.r_[_edges(x.shape[2]), x.shape[2]])[None]
    return _codes(sums / area)


def _line(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m = len(_edges(n))
    c = np.clip((np.arange(n) + 0.5) / 4 - 0.5, 0, m - 1)
    i = np.floor(c).astype(int)
    return i, np.minimum(i + 1, m - 1), c - i


def coarse_decode(data: bytes, shape: tuple[int, ...]) -> np.ndarray:
    """Bilinear upsampling of the means."""
    c = _values(data, (shape[0], len(_edges(shape[1])), len(_edges(shape[2]))))
    i, j, f = _line(shape[1])
    c = c[:, i] * (1 - f)[None, :, None] + c[:, j] * f[None, :, None]
    i, j, f = _line(shape[2])
    return c[:, :, i] * (1 - f) + c[:, :, j] * f


def keyframe_encode(x: np.ndarray, every: int = 3) -> bytes:
    """Every third frame, and the last."""
    return _codes(x[_keys(len(x), every)])


def _keys(n: int, every: int = 3) -> np.ndarray:
    return np.unique(np.r_[np.arange(0, n, every), n - 1])


def keyframe_decode(data: bytes, shape: tuple[int, ...]) -> np.ndarray:
    """Linear interpolation in time."""
    at = _keys(shape[0])
    c = _values(data, (len(at), *shape[1:]))
    t = np.arange(shape[0])
    j = np.clip(np.searchsorted(at, t, "right"), 1, max(1, len(at) - 1))
    if len(at) == 1:
        return np.broadcast_to(c, shape).copy()
    f = (t - at[j - 1]) / (at[j] - at[j - 1])
    return c[j - 1] * (1 - f)[:, None, None] + c[j] * f[:, None, None]


PREDICTORS: dict[str, Coder] = {"mean": (mean_encode, mean_decode), "coarse4": (coarse_encode, coarse_decode), "keyframe3": (keyframe_encode, keyframe_decode)}


def register(name: str, encode: Callable[[np.ndarray], bytes], decode: Callable[[bytes, tuple[int, ...]], np.ndarray]) -> None:
    """A predictor of one's own, such as a network: it must be deterministic, for the encoder runs its decoder."""
    PREDICTORS[name] = (encode, decode)


def interpolated(cells: DataFrame, step: int = 3, keys: Sequence[str] = ("v",)) -> DataFrame:
    """(keys, t, y): each cell from the keyframes beside it, those at multiples of step, linearly; at the ends, from the one there is."""
    kept = keyframes(cells, step).select(*keys, F.col("t").alias("__kt"), F.col("x").alias("__kx"))
    near = cells.select(*keys, "t", F.explode(F.array_distinct(F.array(div(F.col("t"), step) * step, div(F.col("t") + step - 1, step) * step))).alias("__kt"))
    met = near.join(kept, [*keys, "__kt"])
    a = met.groupBy(*keys, "t").agg(F.min("__kt").alias("a"), F.max("__kt").alias("b"), F.min_by("__kx", "__kt").alias("xa"), F.max_by("__kx", "__kt").alias("xb"))
    y = F.when(F.col("a") == F.col("b"), F.col("xa")).otherwise(F.col("xa") + (F.col("xb") - F.col("xa")) * (F.col("t") - F.col("a")) / (F.col("b") - F.col("a")))
    return a.select(*keys, "t", y.alias("y"))
