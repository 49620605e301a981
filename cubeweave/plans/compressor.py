"""Error-bounded compression of frames to an archive, and back.

frames -> blocks of n_frame x height x width -> constant blocks apart -> predictor on normalised blocks -> residual
correction that holds the error bound -> Parquet rows, one a block, and a JSON header. Everything a block needs to be
decoded stands in its row or in the header.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeweave.functions.index import tail_pad
from cubeweave.operators import corrector, residual_codec
from cubeweave.operators.layout import widened
from cubeweave.operators.predict import PREDICTORS
from cubeweave.scratch import materialize
from cubeweave.sources.raw import filesystem, five

PATCH = 8
#: Bytes of blocks that are cut at a time.
CUT_BYTES = 8 << 20
LEAST_BOUND = 2 * float(np.finfo(np.float32).eps)


@dataclass
class Header:
    """What holds for all blocks of an archive."""

    shape: list[int]
    n_frame: int
    block: list[int]
    predictor: str
    codec: str
    eps: float
    mean: float = 0.0
    range: float = 0.0
    basis: list[list[float]] | None = None
    bin: float = 0.0
    given_shape: list[int] = field(default_factory=list)


def _tiles(x: np.ndarray, block: Sequence[int]) -> np.ndarray:
    """Blocks [frames, rows * cols, height, width] of frames [frames, h, w], after zeros where needed and reflecting padding."""
    h, w, pre_h, pre_w = widened(x.shape[1:], tuple(block))
    x = np.pad(x, ((0, 0), (pre_h, pre_h), (pre_w, pre_w)))
    pads = [((-n % b) // 2, (-n % b) - (-n % b) // 2) for n, b in zip((h, w), block, strict=True)]
    x = np.pad(x, ((0, 0), *pads), mode="reflect")
    n, r, c = len(x), x.shape[1] // block[0], x.shape[2] // block[1]
    return x.reshape(n, r, block[0], c, block[1]).transpose(0, 1, 3, 2, 4).reshape(n, r * c, *block)


def _untile(tiles: np.ndarray, size: Sequence[int], block: Sequence[int]) -> np.ndarray:
    h, w, pre_h, pre_w = widened(tuple(size), tuple(block))
    r, c = -(-h // block[0]), -(-w // block[1])
    x = tiles.reshape(r, c, *block).transpose(0, 2, 1, 3).reshape(r * block[0], c * block[1])
    top, left = (-h % block[0]) // 2 + pre_h, (-w % block[1]) // 2 + pre_w
    return x[top : top + size[0], left : left + size[1]]


def patch_rows(x: np.ndarray) -> np.ndarray:
    """Patches of 8 x 8 of [frames, h, w] as one array, zeros up to whole patches."""
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % PATCH), (0, -x.shape[2] % PATCH)))
    return x.reshape(x.shape[0], x.shape[1] // PATCH, PATCH, x.shape[2] // PATCH, PATCH).transpose(0, 1, 3, 2, 4).ravel()


def unpatch_rows(flat: np.ndarray, shape: Sequence[int]) -> np.ndarray:
    n, h, w = shape
    r, c = -(-h // PATCH), -(-w // PATCH)
    return flat.reshape(n, r, c, PATCH, PATCH).transpose(0, 1, 3, 2, 4).reshape(n, r * PATCH, c * PATCH)[:, :h, :w]


def blocks_of(frames: DataFrame, head: Header) -> DataFrame:
    """(v, s, k, id, data): s counts sections and tiles; frames after the end mirror those before it, as often as needed."""
    _, _, T, H, W = head.shape
    n, block = head.n_frame, head.block
    samples, pad = tail_pad(T, n)
    tiles = _tiles(np.zeros((1, H, W), np.float32), block).shape[1]
    sections = head.shape[1]

    step = max(1, CUT_BYTES // (4 * tiles * block[0] * block[1]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows, step)):
            v, s, t = (b.column(c).to_numpy() for c in ("v", "s", "t"))
            data = _tiles(b.column("data").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, H, W), block)
            for p in (a + shift for a in (t, 2 * T - 1 - t) for shift in range(0, T + pad, 2 * T)):  # a frame's own places and its mirrored ones
                here = p < T + pad
                m, flat = int(here.sum()), data[here].reshape(-1, block[0] * block[1])
                if m:
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), flat.shape[1]).cast(pa.list_(pa.float32()))
                    each = lambda x, here=here: pa.array(np.repeat(x[here], tiles))
                    yield pa.RecordBatch.from_arrays([each(v), pa.array(np.repeat(s[here] * tiles, tiles) + np.tile(np.arange(tiles), m)), each(p // n), each(p % n), lists], names=["v", "s", "k", "j", "data"])

    parts = frames.select("v", "s", "t", "data").mapInArrow(cut, "v long, s long, k long, j long, data array<float>")
    whole = parts.groupBy("v", "s", "k").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("j", "data"))), lambda e: e["data"])).alias("data"))
    return whole.withColumn("id", ((F.col("v") * sections * tiles + F.col("s")) * samples + F.col("k")).cast("long"))


def predicted(blocks: DataFrame, head: Header) -> DataFrame:
    """(v, s, k, id, constant, offset, scale, side, orig, recon): arrays of patches, normalised over the whole array."""
    shape = (head.n_frame, *head.block)
    encode, decode = PREDICTORS[head.predictor]
    span = head.range or 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for v, s, k, i, data in zip(*(b.column(c).to_pylist() for c in ("v", "s", "k", "id")), b.column("data"), strict=True):
                x = data.values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(shape)
                if (x == x.flat[0]).all():
                    rows.append((v, s, k, i, float(x.flat[0]), None, None, None, None, None))
                    continue
                offset, scale = float(x.mean()), max(float(x.max() - x.min()), 1e-12)
                side = encode((x - offset) / scale)
                recon = decode(side, shape) * scale + offset
                rows.append((v, s, k, i, None, offset, scale, side, patch_rows((x - head.mean) / span), patch_rows((recon - head.mean) / span)))
            kinds = [pa.int64()] * 4 + [pa.float64()] * 3 + [pa.binary()] + [pa.list_(pa.float64())] * 2
            columns = zip(*rows, strict=True) if rows else [()] * 10
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["v", "s", "k", "id", "constant", "offset", "scale", "side", "orig", "recon"])

    return blocks.mapInArrow(run, "v long, s long, k long, id long, constant double, offset double, scale double, side binary, orig array<double>, recon array<double>")


def compress(frames: DataFrame, shape: Sequence[int], path: str, *, eps: float = 1e-3, n_frame: int = 8, block: tuple[int, int] = (256, 256), predictor: str = "coarse4", codec: str = "pca") -> Header:
    """Write an archive of frames (v, s, t, data) with NRMSE up to eps. All variables are coded; constant arrays, too."""
    if eps < LEAST_BOUND:
        raise ValueError(f"a relative bound below {LEAST_BOUND} can't be held in 32-bit floats")
    stats = frames.select(F.explode("data").alias("x")).agg(F.avg(F.col("x").cast("double")), F.max("x"), F.min("x")).first()
    inner = eps * inside(five(shape), n_frame, block, codec) ** 0.5
    head = Header(five(shape), n_frame, list(block), predictor, codec, inner, float(stats[0]), float(stats[1]) - float(stats[2]), given_shape=list(shape))
    rows = materialize(predicted(blocks_of(frames, head), head), "predicted")
    live = rows.filter("side IS NOT NULL")
    out = rows.select("v", "s", "k", "id", "constant", "offset", "scale", "side")
    if head.range and codec == "pca":
        basis = corrector.fit(live, inner)
        if basis is None:
            out = out.withColumn("payload", F.lit(None).cast("binary"))
        else:
            head.basis, head.bin = basis.vectors.tolist(), basis.bin
            out = out.join(corrector.compress(live, basis), "id", "left")
    elif head.range:
        shaped = live.withColumn("shape", F.array(F.lit(1), F.lit(1), F.size("orig")))
        out = out.join(residual_codec.compress(shaped, inner, 0.0, 1.0), "id", "left")
    else:
        out = out.withColumn("payload", F.lit(None).cast("binary"))
    out.write.mode("overwrite").parquet(f"{path}/blocks")
    files, root = filesystem(path)
    files.create_dir(root, recursive=True)
    with files.open_output_stream(f"{root}/header.json") as f:
        f.write(json.dumps(asdict(head)).encode())
    return head


def inside(shape: Sequence[int], n_frame: int, block: Sequence[int], codec: str) -> float:
    """The share of real cells among those over which a codec spreads its error: padding must not be where it holds the bound."""
    _, _, T, H, W = shape
    h, w, _, _ = widened((H, W), tuple(block))
    rows, cols = -(-h // block[0]) * block[0], -(-w // block[1]) * block[1]
    if codec == "lorenzo":
        samples, _ = tail_pad(T, n_frame)
        return T * H * W / (samples * n_frame * rows * cols)
    reach = lambda n, whole: n if n == whole and n % PATCH == 0 else min(n + 2 * PATCH - 2, whole + PATCH)
    return H * W / (reach(H, rows) * reach(W, cols))


def load_header(path: str) -> Header:
    files, root = filesystem(path)
    with files.open_input_stream(f"{root}/header.json") as f:
        return Header(**json.loads(f.read()))


def decompress(spark: SparkSession, path: str) -> DataFrame:
    """Frames (v, s, t, data) of an archive."""
    head = load_header(path)
    shape, n = (head.n_frame, *head.block), head.n_frame
    tiles = _tiles(np.zeros((1, *head.shape[3:]), np.float32), head.block).shape[1]
    T, size, block, mean, span = head.shape[2], head.shape[3:], head.block, head.mean, head.range or 1.0
    decode = PREDICTORS[head.predictor][1]
    basis = corrector.Basis(np.array(head.basis), head.eps, head.bin) if head.basis else None
    stored = spark.read.parquet(f"{path}/blocks")
    names = stored.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                if r["constant"] is not None:
                    x = np.full(shape, r["constant"])
                else:
                    x = decode(r["side"], shape) * r["scale"] + r["offset"]
                    if "payload" in names and r["payload"] and basis is not None:
                        bad, q = corrector.unpack(r["payload"], len(basis.vectors))
                        flat = patch_rows((x - mean) / span).reshape(-1, PATCH * PATCH)
                        flat[bad] += (q * basis.bin) @ basis.vectors
                        x = unpatch_rows(flat.ravel(), shape) * span + mean
                    elif "streams" in names and r["streams"]:
                        flat = patch_rows((x - mean) / span)
                        fixed = residual_codec.decode_block(flat.reshape(1, 1, -1), r["step"], r["streams"], 0.0, 1.0)
                        x = unpatch_rows(fixed.ravel().astype(np.float64), shape) * span + mean
                t = r["k"] * n + np.arange(n)
                keep = t < T
                flat = x.astype(np.float32).reshape(n, -1)[keep]
                lists = pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), flat.shape[1]).cast(pa.list_(pa.float32()))
                m = int(keep.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, r["v"])), pa.array(np.full(m, r["s"] // tiles)), pa.array(t[keep]), pa.array(np.full(m, r["s"] % tiles)), lists], names=["v", "s", "t", "tile", "data"])

    parts = stored.mapInArrow(run, "v long, s long, t long, tile long, data array<float>")
    whole = parts.groupBy("v", "s", "t").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("tile", "data"))), lambda e: e["data"])).alias("data"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [_untile(d.values.to_numpy(zero_copy_only=False).reshape(tiles, *block), size, block).ravel() for d in b.column("data")]
            yield pa.RecordBatch.from_arrays([b.column("v"), b.column("s"), b.column("t"), pa.array(out, pa.list_(pa.float32()))], names=["v", "s", "t", "data"])

    return whole.mapInArrow(join, "v long, s long, t long, data array<float>")


def verify(frames: DataFrame, restored: DataFrame) -> DataFrame:
    """One row: frames, missing frames, nrmse and psnr."""
    both = frames.select("v", "s", "t", F.col("data").alias("a")).join(restored.select("v", "s", "t", F.col("data").alias("b")), ["v", "s", "t"], "left")
    d = F.aggregate(F.zip_with("a", "b", lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda m, e: m + e)
    per = both.select(d.alias("sse"), F.size("a").alias("n"), F.array_max("a").cast("double").alias("high"), F.array_min("a").cast("double").alias("low"), F.col("b").isNull().alias("gone"))
    total = per.agg(F.count("*").alias("frames"), F.count_if("gone").alias("missing"), (F.sum("sse") / F.sum("n")).alias("mse"), (F.max("high") - F.min("low")).alias("range"))
    nrmse = F.when(F.col("mse") == 0, 0.0).otherwise(F.sqrt("mse") / F.col("range"))
    psnr = F.when(F.col("mse") == 0, float("inf")).otherwise(20 * F.log10("range") - 10 * F.log10("mse"))
    return total.select("frames", "missing", nrmse.alias("nrmse"), psnr.alias("psnr"))


def archive_bytes(spark: SparkSession, path: str) -> DataFrame:
    """One row: payload bytes, and header bytes with the blocks' numbers."""
    stored = spark.read.parquet(f"{path}/blocks")
    kept = F.coalesce(F.length("side"), F.lit(0))
    if "payload" in stored.columns:
        kept = kept + F.coalesce(F.length("payload"), F.lit(0))
    if "streams" in stored.columns:
        kept = kept + F.coalesce(F.aggregate("streams", F.lit(0), lambda a, s: a + F.length(s)), F.lit(0))
    files, root = filesystem(path)
    return stored.agg(F.sum(kept).alias("payload_bytes"), (F.count("*") * 40 + files.get_file_info(f"{root}/header.json").size).alias("header_bytes"))


def sweep(frames: DataFrame, shape: Sequence[int], path: str, targets: Sequence[float], **options) -> list[dict]:
    """compress and verify for each target."""
    out = []
    for i, eps in enumerate(targets):
        compress(frames, shape, f"{path}/{i}", eps=eps, **options)
        spark = frames.sparkSession
        out.append({"target": eps, **verify(frames, decompress(spark, f"{path}/{i}")).first().asDict(), **archive_bytes(spark, f"{path}/{i}").first().asDict()})
    return out
