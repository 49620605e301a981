"""Probability models, rANS and packing of codes: one stream a row, so streams are coded in parallel."""

from __future__ import annotations

import bisect
import math
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PRECISION = 16
LOW = 1 << 31
NIBBLE = 4
#: Symbols that share a state when a stream is coded in lanes.
LANE = 1024
#: Symbols that a task codes at a time.
PIECE = 1 << 19


def check_cdf(cdf: Sequence[int]) -> None:
    """A CDF begins at 0, ends at 2**16 and rises strictly."""
    if cdf[0] != 0 or cdf[-1] != 1 << PRECISION or any(a >= b for a, b in zip(cdf, cdf[1:], strict=False)):
        raise ValueError("not a 16-bit cumulative distribution")


def quantized_cdf(pmf: Sequence[float]) -> list[int]:
    """16-bit CDF of probabilities, every symbol with one count at least."""
    total, n = sum(pmf), len(pmf)
    left = (1 << PRECISION) - n
    freq = [1 + int(left * p / total) for p in pmf]
    freq[max(range(n), key=lambda i: pmf[i])] += (1 << PRECISION) - sum(freq)
    out = [0]
    for f in freq:
        out.append(out[-1] + f)
    return out


def gaussian_tables(levels: int = 128, low: float = 0.1, high: float = 20.0, support: int = 123) -> tuple[list[float], list[list[int]], int]:
    """Scales, a CDF for each over -support .. support and a tail, and the offset of the first symbol."""
    scales = [math.exp(math.log(low) + (math.log(high) - math.log(low)) * i / (levels - 1)) for i in range(levels)]
    tables = []
    for s in scales:
        phi = lambda x, s=s: 0.5 * math.erfc(-x / (s * math.sqrt(2)))
        pmf = [max(phi(k + 0.5) - phi(k - 0.5), 1e-12) for k in range(-support, support + 1)]
        tables.append(quantized_cdf([*pmf, max(1 - sum(pmf), 1e-9)]))
    return scales, tables, -support


def scale_row(scale: float, scales: Sequence[float]) -> int:
    """How many of all but the last scales lie strictly below the scale, at least the first of them."""
    return bisect.bisect_left(scales, max(scale, scales[0]), 0, len(scales) - 1)


def scale_rows(values: np.ndarray, scales: Sequence[float]) -> np.ndarray:
    """scale_row of many values."""
    return np.searchsorted(np.asarray(scales[:-1]), np.maximum(np.asarray(values, np.float64), scales[0]), "left")


def likelihood(x: float, scale: float) -> float:
    """Probability of the unit bin around x under a centred normal distribution, 1e-9 at least."""
    root = scale * math.sqrt(2)
    a = abs(x)
    return max(0.5 * (math.erfc((a - 0.5) / root) - math.erfc((a + 0.5) / root)), 1e-9)


def encode(symbols: Sequence[int], rows: Sequence[int], cdfs: Sequence[Sequence[int]], offset: int | Sequence[int]) -> bytes:
    """64-bit rANS of symbols under the CDF row of each. The last entry of a row is an escape: what it stands for follows raw, in nibbles."""
    ops: list[tuple[int, int, int]] = []  # start, frequency, bits
    for s, r in zip(symbols, rows, strict=True):
        cdf = cdfs[r]
        top = len(cdf) - 2
        v = s - (offset if isinstance(offset, int) else offset[r])
        inside = 0 <= v < top
        at = v if inside else top
        ops.append((cdf[at], cdf[at + 1] - cdf[at], PRECISION))
        if not inside:
            raw = -2 * v - 1 if v < 0 else 2 * (v - top)
            n = max(1, -(-raw.bit_length() // NIBBLE))
            count = n
            while count >= 15:
                ops.append((15, 1, NIBBLE))
                count -= 15
            ops.append((count, 1, NIBBLE))
            ops += [((raw >> (NIBBLE * k)) & 15, 1, NIBBLE) for k in range(n)]
    x, words = LOW, []
    for start, freq, bits in reversed(ops):
        if x >= ((LOW >> bits) << 32) * freq:
            words.append(x & 0xFFFFFFFF)
            x >>= 32
        x = ((x // freq) << bits) + x % freq + start
    return struct.pack(f"<{len(words) + 2}I", x & 0xFFFFFFFF, x >> 32, *reversed(words))


def decode(data: bytes, rows: Sequence[int], cdfs: Sequence[Sequence[int]], offset: int | Sequence[int]) -> list[int]:
    words = struct.unpack(f"<{len(data) // 4}I", data)
    x, at, out = words[0] | words[1] << 32, 2, []

    def refill(x: int, at: int) -> tuple[int, int]:
        return ((x << 32) | words[at], at + 1) if x < LOW and at < len(words) else (x, at)

    def nibble(x: int, at: int) -> tuple[int, int, int]:
        got = x & 15
        x, at = refill(x >> NIBBLE, at)
        return got, x, at

    for r in rows:
        cdf = cdfs[r]
        low = x & 0xFFFF
        s = bisect.bisect_right(cdf, low) - 1
        x, at = refill((cdf[s + 1] - cdf[s]) * (x >> PRECISION) + low - cdf[s], at)
        if s == len(cdf) - 2:
            n = 0
            while True:
                got, x, at = nibble(x, at)
                n += got
                if got < 15:
                    break
            raw = 0
            for k in range(n):
                got, x, at = nibble(x, at)
                raw |= got << (NIBBLE * k)
            s = -((raw + 1) >> 1) if raw & 1 else s + (raw >> 1)
        out.append(s + (offset if isinstance(offset, int) else offset[r]))
    return out


class Tables:
    """CDF rows side by side, for coding many lanes at once: start and frequency of every entry, and a map from the low
    16 bits of a state to its entry."""

    def __init__(self, cdfs: Sequence[Sequence[int]], offset: int | Sequence[int]) -> None:
        self.cdfs, self.offset = [list(c) for c in cdfs], offset
        width = max(map(len, cdfs))
        self.grid = np.full((len(cdfs), width), (1 << PRECISION) + 1, np.int64)
        for i, c in enumerate(cdfs):
            self.grid[i, : len(c)] = c
        self.top = np.array([len(c) - 2 for c in cdfs])
        self.first = np.full(len(cdfs), offset, np.int64) if isinstance(offset, int) else np.asarray(offset, np.int64)
        self.flat = (self.grid + (np.arange(len(cdfs)) * ((1 << PRECISION) + 2))[:, None]).ravel()  # rises over all rows

    def find(self, rows: np.ndarray, low: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.flat, low + rows * ((1 << PRECISION) + 2), "right") - 1
        return at - rows * self.grid.shape[1]


def _ops(symbols: np.ndarray, rows: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, frequency, bits) of what encode() does for the symbols; only escapes are worked out one by one."""
    v = symbols - t.first[rows]
    top = t.top[rows]
    inside = (v >= 0) & (v < top)
    at = np.where(inside, v, top)
    start, freq = t.grid[rows, at], t.grid[rows, at + 1] - t.grid[rows, at]
    bits = np.full(len(v), PRECISION)
    if inside.all():
        return start, freq, bits
    parts, done = [], 0
    for k in np.flatnonzero(~inside):
        raw = int(-2 * v[k] - 1 if v[k] < 0 else 2 * (v[k] - top[k]))
        n = max(1, -(-raw.bit_length() // NIBBLE))
        extra = [15] * (n // 15) + [n % 15] + [(raw >> (NIBBLE * j)) & 15 for j in range(n)]
        parts += [np.stack([x[done : k + 1] for x in (start, freq, bits)]), np.stack([np.array(extra), np.ones(len(extra), int), np.full(len(extra), NIBBLE)])]
        done = k + 1
    parts.append(np.stack([x[done:] for x in (start, freq, bits)]))
    return tuple(np.concatenate(parts, axis=1))


def encode_lanes(lanes: Sequence[tuple[np.ndarray, np.ndarray]], t: Tables) -> list[bytes]:
    """encode() of many (symbols, rows) at once: one state a lane, all lanes a step at a time."""
    ops = [_ops(np.asarray(s, np.int64), np.asarray(r, np.int64), t) for s, r in lanes]
    sizes = np.array([len(o[0]) for o in ops])
    most = int(sizes.max(initial=0))
    grid = np.zeros((3, most, len(ops)), np.uint64)  # from the end: the last operation of every lane first
    for i, o in enumerate(ops):
        grid[:, : sizes[i], i] = np.stack(o)[:, ::-1]
    order = np.argsort(-sizes, kind="stable")
    grid, sizes = grid[:, :, order], sizes[order]
    x, words, count = np.full(len(ops), LOW, np.uint64), np.zeros((len(ops), most + 2), np.uint32), np.zeros(len(ops), np.int64)
    low, shift = np.uint64(LOW), np.uint64(32)
    for k in range(most):
        n = int(np.searchsorted(-sizes, -k, "left"))  # lanes that have an operation left
        start, freq, bits = grid[0, k, :n], grid[1, k, :n], grid[2, k, :n]
        y = x[:n]
        out = np.flatnonzero(y >= ((low >> bits) << shift) * freq)
        words[out, count[out]] = y[out] & np.uint64(0xFFFFFFFF)
        count[out] += 1
        y[out] >>= shift
        q = y // freq
        x[:n] = (q << bits) + (y - q * freq) + start
    found: list[bytes] = [b""] * len(ops)
    for i, o in enumerate(order):
        head = np.array([int(x[i]) & 0xFFFFFFFF, int(x[i]) >> 32], np.uint32)
        found[o] = np.concatenate([head, words[i, : count[i]][::-1]]).astype("<u4").tobytes()
    return found


def decode_lanes(data: Sequence[bytes], rows: Sequence[np.ndarray], t: Tables) -> list[np.ndarray]:
    """decode() of many lanes at once."""
    sizes = np.array([len(r) for r in rows], np.int64)
    order = np.argsort(-sizes, kind="stable")
    lanes, most = len(rows), int(sizes.max(initial=0))
    words = [np.frombuffer(data[o], "<u4") for o in order]
    grid = np.zeros((lanes, max(map(len, words), default=0) + 1), np.uint64)
    which = np.zeros((most, lanes), np.int64)
    for i, o in enumerate(order):
        grid[i, : len(words[i])] = words[i]
        which[: sizes[o], i] = rows[o]
    left, sizes = np.array([len(w) for w in words]), sizes[order]
    x, at = grid[:, 0] | grid[:, 1] << np.uint64(32) if lanes else np.zeros(0, np.uint64), np.full(lanes, 2)
    out, low, mask = np.zeros((most, lanes), np.int64), np.uint64(LOW), np.uint64(0xFFFF)

    def refill(i: np.ndarray) -> None:
        i = i[(x[i] < low) & (at[i] < left[i])]
        x[i] = (x[i] << np.uint64(32)) | grid[i, at[i]]
        at[i] += 1

    def nibble(i: np.ndarray) -> int:
        got = int(x[i[0]]) & 15
        x[i] >>= np.uint64(NIBBLE)
        refill(i)
        return got

    every = np.arange(lanes)
    for k in range(most):
        n = int(np.searchsorted(-sizes, -k, "left"))
        r, y = which[k, :n], x[:n]
        part = (y & mask).astype(np.int64)
        s = t.find(r, part)
        start = t.grid[r, s]
        x[:n] = (t.grid[r, s + 1] - start).astype(np.uint64) * (y >> np.uint64(PRECISION)) + (part - start).astype(np.uint64)
        refill(every[:n])
        for i in np.flatnonzero(s == t.top[r]):  # escapes
            one, count = every[i : i + 1], 0
            while (got := nibble(one)) == 15:
                count += 15
            raw = 0
            for j in range(count + got):
                raw |= nibble(one) << (NIBBLE * j)
            s[i] = -((raw + 1) >> 1) if raw & 1 else s[i] + (raw >> 1)
        out[k, :n] = s + t.first[r]
    found: list[np.ndarray] = [np.zeros(0, np.int64)] * lanes
    for i, o in enumerate(order):
        found[o] = out[: sizes[i], i]
    return found


def _pack_lanes(parts: Sequence[bytes]) -> bytes:
    return struct.pack(f"<{len(parts) + 1}I", len(parts), *map(len, parts)) + b"".join(parts)


def _unpack_lanes(data: bytes) -> list[bytes]:
    (n,) = struct.unpack_from("<I", data)
    sizes, at, out = struct.unpack_from(f"<{n}I", data, 4), 4 + 4 * n, []
    for size in sizes:
        out.append(data[at : at + size])
        at += size
    return out


def _coded(streams: Sequence[tuple[np.ndarray, np.ndarray]], t: Tables, lane: int) -> list[bytes]:
    """Every stream (symbols, rows) in lanes, those of all streams side by side."""
    cut = [[(s[at : at + lane], i[at : at + lane]) for at in range(0, len(s), lane)] for s, i in streams]
    coded = iter(encode_lanes([x for c in cut for x in c], t))
    return [_pack_lanes([next(coded) for _ in c]) for c in cut]


def _decoded(data: Sequence[bytes], rows: Sequence[np.ndarray], t: Tables, lane: int) -> list[np.ndarray]:
    parts = [_unpack_lanes(p) for p in data]
    back = iter(decode_lanes([x for p in parts for x in p], [i[at : at + lane] for i in rows for at in range(0, len(i), lane)], t))
    return [np.concatenate([next(back) for _ in p]) if p else np.zeros(0, np.int64) for p in parts]


def _pieces(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Slices of some PIECE symbols at most, or of one row."""
    at, total = 0, 0
    for k, size in enumerate(np.nan_to_num(sizes)):
        if k > at and total + size > PIECE:
            yield batch.slice(at, k - at)
            at, total = k, 0
        total += size
    yield batch.slice(at)


def empirical_cdf(symbols: DataFrame) -> DataFrame:
    """(channel, symbol, low, high): 16-bit cumulative counts of the symbols of each channel, one at least for each."""
    counts = symbols.groupBy("channel", "symbol").agg(F.count("*").alias("n"))
    w = Window.partitionBy("channel").orderBy("symbol")
    every = Window.partitionBy("channel")
    share = F.floor(F.sum("n").over(w) * ((1 << PRECISION) - F.count("*").over(every)) / F.sum("n").over(every)).cast("long") + F.row_number().over(w)
    rows = counts.withColumn("high", share)
    return rows.select("channel", "symbol", F.coalesce(F.lag("high").over(w), F.lit(0)).cast("long").alias("low"), F.col("high").cast("long"))


def tables_of(cdf: DataFrame) -> tuple[dict[int, int], list[list[int]], list[int]]:
    """Row of each channel, CDF rows with an escape, and offsets, for encode(). A channel has few distinct symbols."""
    by: dict[int, list] = {}
    for r in cdf.orderBy("channel", "symbol").collect():
        by.setdefault(r["channel"], []).append(r)
    rows, tables, first = {}, [], []
    for c, entries in by.items():
        low, high = entries[0]["symbol"], entries[-1]["symbol"]
        seen = {e["symbol"]: e["high"] - e["low"] for e in entries}
        rows[c] = len(tables)
        first.append(low)
        tables.append(quantized_cdf([*(seen.get(s, 0) + 0.01 for s in range(low, high + 1)), 0.01]))
    return rows, tables, first


def _arrays(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column as arrays; null is empty."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
    return np.split(flat, ends[:-1]) if len(column) else []


def encode_streams(streams: DataFrame, tables: Sequence[Sequence[int]], offset: int | Sequence[int], keys: Sequence[str] = ("sid",), lane: int = LANE) -> DataFrame:
    """(keys, payload) of rows (keys, sym array, idx array): rANS of lane symbols at a time, each with a state of its own,
    which are coded side by side, and the sizes of the lanes before them."""
    sc = streams.sparkSession.sparkContext.broadcast((list(map(list, tables)), offset))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tables(*sc.value)
        for b in batches:
            out = _coded(list(zip(_arrays(b.column("sym")), _arrays(b.column("idx")), strict=True)), t, lane)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(out, pa.binary())], names=[*keys, "payload"])

    kinds = dict(streams.dtypes)
    return streams.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", payload binary")


def decode_streams(streams: DataFrame, tables: Sequence[Sequence[int]], offset: int | Sequence[int], keys: Sequence[str] = ("sid",), lane: int = LANE) -> DataFrame:
    """(keys, sym) of rows (keys, payload, idx)."""
    sc = streams.sparkSession.sparkContext.broadcast((list(map(list, tables)), offset))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tables(*sc.value)
        for b in batches:
            out = _decoded(b.column("payload").to_pylist(), _arrays(b.column("idx")), t, lane)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(out, pa.list_(pa.int64()))], names=[*keys, "sym"])

    kinds = dict(streams.dtypes)
    return streams.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", sym array<bigint>")


def zstd(data: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def unzstd(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def frame(parts: Sequence[bytes], level: int = 3) -> bytes:
    """Sizes of the parts' frames, 64-bit little-endian, then the zstd frames."""
    frames = [zstd(p, level) for p in parts]
    return struct.pack(f"<{len(frames)}Q", *map(len, frames)) + b"".join(frames)


def unframe(data: bytes, n: int) -> list[bytes]:
    """The parts again; a size beyond the data is an error."""
    if len(data) < 8 * n:
        raise ValueError("truncated header")
    sizes, at, out = struct.unpack(f"<{n}Q", data[: 8 * n]), 8 * n, []
    for s in sizes:
        if at + s > len(data):
            raise ValueError("truncated frame")
        out.append(unzstd(data[at : at + s]))
        at += s
    return out


def plane_streams(zz: np.ndarray, level: int = 3) -> tuple[int, list[bytes]]:
    """Bit planes of non-negative codes, packed least significant bit first, a zstd frame each."""
    n = max(1, int(zz.max(initial=0)).bit_length())
    return n, [zstd(np.packbits(((zz >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), bitorder="little").tobytes(), level) for b in range(n)]


def from_planes(streams: Sequence[bytes], n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    for b, s in enumerate(streams):
        out |= np.unpackbits(np.frombuffer(unzstd(s), np.uint8), count=n, bitorder="little").astype(np.uint64) << np.uint64(b)
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


class MonotonePrior:
    """A cumulative distribution given by a network that can only rise: layers softplus(weight) x + bias, each but the
    last bent by tanh(bend) tanh(x), and a sigmoid at the end. The weights are given; nothing is trained here.

    weights: [out, in] for each layer, the first of one input and the last of one output; biases [out]; bends [out].
    """

    def __init__(self, weights: Sequence[np.ndarray], biases: Sequence[np.ndarray], bends: Sequence[np.ndarray], least: float = 1e-9) -> None:
        self.weights, self.biases, self.bends, self.least = [np.logaddexp(0, w) for w in weights], list(biases), [np.tanh(b) for b in bends], least

    def logits(self, x: np.ndarray) -> np.ndarray:
        y = np.asarray(x, np.float64).reshape(1, -1)
        for k, (w, b) in enumerate(zip(self.weights, self.biases, strict=True)):
            y = w @ y + b[:, None]
            if k < len(self.bends):
                y = y + self.bends[k][:, None] * np.tanh(y)
        return y[0]

    def cdf(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x))

    def likelihood(self, x: np.ndarray) -> np.ndarray:
        """Probability of the unit bin around x, on the side where the sigmoid keeps its digits."""
        high, low = self.logits(np.asarray(x) + 0.5), self.logits(np.asarray(x) - 0.5)
        sign = np.where(high + low > 0, -1.0, 1.0)
        return np.maximum(np.abs(sigmoid(sign * high) - sigmoid(sign * low)), self.least)

    def inverse(self, p: np.ndarray, low: float = -1e4, high: float = 1e4, rounds: int = 80) -> np.ndarray:
        """Where the distribution reaches p, by bisection."""
        a, b = np.full(np.shape(p), low), np.full(np.shape(p), high)
        for _ in range(rounds):
            m = (a + b) / 2
            under = self.cdf(m) < p
            a, b = np.where(under, m, a), np.where(under, b, m)
        return (a + b) / 2

    def sample(self, n: int, seed: int) -> np.ndarray:
        return self.inverse(np.random.default_rng(seed).random(n))

    def table(self, reach: int = 30) -> tuple[int, list[int]]:
        """(first symbol, 16-bit CDF) over reach symbols on either side of the median; the last entry, the escape, has the mass of both tails."""
        median = math.ceil(float(self.inverse(np.array([0.5]))[0]) - 0.5)
        k = np.arange(median - reach, median + reach + 1)
        tail = float(self.cdf(np.array([k[0] - 0.5]))[0] + 1 - self.cdf(np.array([k[-1] + 0.5]))[0])
        return int(k[0]), quantized_cdf([*self.likelihood(k), max(tail, self.least)])


class LatentCoder:
    """Compresses rows (keys, y, z) of latents and hyper-latents, arrays of equal length: z under the prior's table, y under
    normal tables whose scale is scale_of(z), both in lanes as in encode_streams(). Everything the decoder needs but the
    prior is in the two payloads. A task codes some PIECE symbols at a time, or one row, if that is longer."""

    def __init__(self, prior: MonotonePrior, levels: int = 32, support: int = 31) -> None:
        first, cdf = prior.table()
        scales, tables, offset = gaussian_tables(levels, support=support)
        self.state = (first, cdf, scales, tables, offset)

    def compress(self, rows: DataFrame, keys: Sequence[str] = ("sid",), lane: int = LANE) -> DataFrame:
        """(keys, n, z_payload, y_payload)."""
        state = self.state

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, cdf, scales, tables, offset = state
            z_tables, y_tables = Tables([cdf], first), Tables(tables, offset)
            for b in (piece for b in batches for piece in _pieces(b, b.column("y").value_lengths().to_numpy(zero_copy_only=False))):
                ys, zs = _arrays(b.column("y")), _arrays(b.column("z"))
                z_data = _coded([(z, np.zeros(len(z), np.int64)) for z in zs], z_tables, lane)
                y_data = _coded([(y, scale_rows(z, scales)) for y, z in zip(ys, zs, strict=True)], y_tables, lane)
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(map(len, ys), pa.int64()), pa.array(z_data, pa.binary()), pa.array(y_data, pa.binary())], names=[*keys, "n", "z_payload", "y_payload"])

        kinds = dict(rows.dtypes)
        return rows.select(*keys, "y", "z").mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n long, z_payload binary, y_payload binary")

    def decompress(self, coded: DataFrame, keys: Sequence[str] = ("sid",), lane: int = LANE) -> DataFrame:
        """(keys, y, z)."""
        state = self.state

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, cdf, scales, tables, offset = state
            z_tables, y_tables = Tables([cdf], first), Tables(tables, offset)
            for b in (piece for b in batches for piece in _pieces(b, b.column("n").to_numpy())):
                zs = _decoded(b.column("z_payload").to_pylist(), [np.zeros(n, np.int64) for n in b.column("n").to_pylist()], z_tables, lane)
                ys = _decoded(b.column("y_payload").to_pylist(), [scale_rows(z, scales) for z in zs], y_tables, lane)
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(ys, pa.list_(pa.int64())), pa.array(zs, pa.list_(pa.int64()))], names=[*keys, "y", "z"])

        kinds = dict(coded.dtypes)
        return coded.select(*keys, "n", "z_payload", "y_payload").mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", y array<bigint>, z array<bigint>")
