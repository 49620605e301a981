"""Archives of arrays, stream files, containers, metrics and settings."""

from __future__ import annotations

import itertools
import json
import os
import struct
import zipfile
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cubeweave.sources.raw import filesystem, listing

MAGIC = b"CWRES_V1\n"


Span = tuple[int, int | None]


def _open_array(archive: zipfile.ZipFile, key: str):
    """(shape with leading axes, dtype, stream after the header) of an array of an .npz file."""
    f = archive.open(f"{key}.npy")
    version = np.lib.format.read_magic(f)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if fortran and len(shape) > 1:
        raise ValueError(f"{key} is stored by columns")
    if len(shape) > 5:
        raise ValueError(f"{key} has more than five axes")
    return (1,) * (5 - len(shape)) + tuple(shape), dtype, f


def _npz_frames(path: str, keys: Sequence[str], spans: Sequence[Span], crop: tuple[int, int] | None) -> Iterator[tuple]:
    """(v, s, t, height, width, data...) of one file: frames outside the spans are passed over in the stream, and one
    frame a key is held at a time."""
    files, at = filesystem(path)
    with files.open_input_file(at) as raw, zipfile.ZipFile(raw) as archive:
        arrays = [_open_array(archive, k) for k in keys]
        shape = arrays[0][0]
        if any(a[0] != shape for a in arrays):
            raise ValueError(f"{path}: the shapes of {', '.join(keys)} differ")
        lows, highs = zip(*((a, n if b is None else min(b, n)) for (a, b), n in zip(spans, shape, strict=False)), strict=True)
        height, width = shape[3:]
        th, tw = crop or (height, width)
        if th > height or tw > width:
            raise ValueError(f"{path}: frames of {height} x {width} have no middle of {th} x {tw}")
        y, x = (height - th) // 2, (width - tw) // 2
        for i in np.ndindex(shape[:3]):
            frames = [(f.read(dtype.itemsize * height * width), dtype) for _, dtype, f in arrays]
            if all(a <= k < b for k, a, b in zip(i, lows, highs, strict=True)):
                yield (*i, th, tw, *(np.frombuffer(d, t).reshape(height, width)[y : y + th, x : x + tw].astype(np.float32).ravel() for d, t in frames))


def _read_npz(spark: SparkSession, path: str, keys: Mapping[str, str], spans: Sequence[Span], crop: tuple[int, int] | None) -> DataFrame:
    paths = spark.read.format("binaryFile").load(path).select("path")
    names, keys = list(keys.values()), list(keys)
    ints = ["v", "s", "t", "height", "width"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column("path").to_pylist():
                rows = _npz_frames(file, keys, spans, crop)
                while part := list(itertools.islice(rows, 64)):
                    columns = [*(pa.array([r[k] for r in part], pa.int64()) for k in range(5)), pa.array([file] * len(part)), *(pa.array([r[5 + k] for r in part], pa.list_(pa.float32())) for k in range(len(keys)))]
                    yield pa.RecordBatch.from_arrays(columns, names=[*ints, "file", *names])

    return paths.mapInArrow(run, ", ".join(f"{c} long" for c in ints) + ", file string, " + ", ".join(f"{n} array<float>" for n in names))


def read_npz(spark: SparkSession, path: str, key: str = "data", *, variable: int | None = None, sections: Span = (0, None), frames: Span = (0, None), crop: tuple[int, int] | None = None) -> DataFrame:
    """Frames (v, s, t, height, width, file, data) of the arrays under a key in .npz files; lower ranks get leading axes.

    One variable, half-open ranges of sections and frames, and the middle of the frames can be asked for: only these
    become rows, under their own numbers. A file is read as a stream, a frame at a time, and may have any size.
    """
    spans = [(0, None) if variable is None else (variable, variable + 1), sections, frames]
    return _read_npz(spark, path, {key: "data"}, spans, crop)


def read_npz_pair(spark: SparkSession, path: str, **slices) -> DataFrame:
    """Frames with orig and recon of .npz files with original_data and recons_data; their shapes must agree."""
    variable = slices.pop("variable", None)
    spans = [(0, None) if variable is None else (variable, variable + 1), slices.pop("sections", (0, None)), slices.pop("frames", (0, None))]
    return _read_npz(spark, path, {"original_data": "orig", "recons_data": "recon"}, spans, slices.pop("crop", None))


def save_streams(streams: DataFrame, path: str) -> None:
    """One file of (64-bit length, bytes) for rows (sid, payload), in order of sid; rows come to the driver a partition at a time."""
    files, target = filesystem(path)
    with files.open_output_stream(target) as out:
        for r in streams.orderBy("sid").toLocalIterator():
            out.write(struct.pack("<Q", len(r["payload"])) + bytes(r["payload"]))


def load_streams(spark: SparkSession, path: str) -> DataFrame:
    """(sid, payload) of such a file, or of a folder of parts, numbered in order; a stream that the file cuts off is dropped."""
    files, _ = filesystem(path)
    parts, first = [], 0
    for file, rows, _ in listing(path):
        parts.append((file, first))
        first += max(rows, 0)
    named = spark.createDataFrame(parts, "file string, first long").repartition(max(1, min(len(parts), spark.sparkContext.defaultParallelism)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = filesystem(path)
        for b in batches:
            for file, sid in zip(b.column("file").to_pylist(), b.column("first").to_pylist(), strict=True):
                with own.open_input_stream(file) as f:
                    out: list[bytes] = []
                    while len(head := f.read(8)) == 8:
                        (n,) = struct.unpack("<Q", head)
                        data = f.read(n)
                        if len(data) < n:
                            break
                        out.append(data)
                        if sum(map(len, out[-64:])) > 8 << 20 or len(out) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(np.arange(sid, sid + len(out)), pa.int64()), pa.array(out, pa.binary())], names=["sid", "payload"])
                            sid, out = sid + len(out), []
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(sid, sid + len(out)), pa.int64()), pa.array(out, pa.binary())], names=["sid", "payload"])

    return named.mapInArrow(run, "sid long, payload binary")


def save_container(path: str, header: Mapping, blocks: DataFrame) -> None:
    """A container: magic, header as JSON with its length, and of each block its planes' number and streams. Renamed when complete."""
    files, target = filesystem(path)
    text = json.dumps(dict(header), sort_keys=True).encode()
    with files.open_output_stream(target + ".tmp") as out:
        out.write(MAGIC + struct.pack("<Q", len(text)) + text)
        for r in blocks.select("id", "step", "bit_count", "streams").orderBy("id").toLocalIterator():
            out.write(struct.pack("<qdI", r["id"], r["step"], r["bit_count"]))
            for s in r["streams"]:
                out.write(struct.pack("<Q", len(s)) + bytes(s))
    files.move(target + ".tmp", target)


def load_container(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    files, target = filesystem(path)
    with files.open_input_file(target) as f:
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is no container")
        header = json.loads(f.read(struct.unpack("<Q", f.read(8))[0]))
    skip = len(MAGIC) + 8 + len(json.dumps(header, sort_keys=True).encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("content").to_pylist():
                at, rows = skip, []
                while at < len(data):
                    i, step, bits = struct.unpack_from("<qdI", data, at)
                    at, streams = at + 20, []
                    for _ in range(bits):
                        (n,) = struct.unpack_from("<Q", data, at)
                        streams.append(data[at + 8 : at + 8 + n])
                        at += 8 + n
                    rows.append((i, step, bits, streams))
                i, step, bits, streams = zip(*rows, strict=True) if rows else ((),) * 4
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(step, pa.float64()), pa.array(bits, pa.int32()), pa.array(streams, pa.list_(pa.binary()))], names=["id", "step", "bit_count", "streams"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "id long, step double, bit_count int, streams array<binary>")
    return header, rows


def append_metrics(spark: SparkSession, path: str, rows: Sequence[Mapping]) -> None:
    """Rows of metrics to a CSV table, with a header in each file."""
    spark.createDataFrame([dict(r) for r in rows]).coalesce(1).write.mode("append").option("header", True).csv(path)


def merge_json(path: str, data: Mapping, mode: str = "update") -> dict:
    """Update a JSON file of results, or append to its lists (mode cat)."""
    files, target = filesystem(path)
    old: dict = {}
    if files.get_file_info(target).is_file:
        with files.open_input_stream(target) as f:
            old = json.loads(f.read())
    new = {**old, **data} if mode == "update" else {k: [*old.get(k, []), *(data[k] if isinstance(data.get(k), list) else [data[k]] if k in data else [])] for k in {*old, *data}}
    with files.open_output_stream(target) as out:
        out.write(json.dumps(new, sort_keys=True).encode())
    return new


def find_model(spark: SparkSession | None, name: str, folder_conf: str = "spark.cubeweave.models", folder_env: str = "CUBEWEAVE_MODELS") -> str:
    """A model or table file: in the folder of the session's setting, of the environment, or of the package."""
    places = [spark.conf.get(folder_conf, None) if spark else None, os.environ.get(folder_env), os.path.join(os.path.dirname(__file__), "models")]
    for p in filter(None, places):
        files, path = filesystem(f"{p.rstrip('/')}/{name}")
        if files.get_file_info(path).is_file:
            return f"{p.rstrip('/')}/{name}"
    raise FileNotFoundError(f"{name} is in none of {[p for p in places if p]}")
