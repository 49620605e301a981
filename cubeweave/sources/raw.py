"""Headerless arrays: float32 files as frames, integer files, synthetic fields. Files are split by frames."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import nullcontext
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThan

from cubeweave.functions.index import unravel

SPLIT_BYTES = 32 << 20
#: Bytes of frames that are read at a time.
READ_BYTES = 8 << 20
MANIFEST = "_manifest.json"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (file:/x as Hadoop writes it, too)."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def five(shape: Sequence[int]) -> list[int]:
    """A shape of rank 1 to 5 with leading ones; all sizes are positive."""
    if not shape or len(shape) > 5 or any(n <= 0 for n in shape):
        raise ValueError(f"not a shape of one to five positive sizes: {list(shape)}")
    return [1] * (5 - len(shape)) + list(shape)


def listing(path: str) -> list[tuple[str, int, int]]:
    """(file, rows, bytes) of the parts of a folder with a manifest, in order, or of the one file, with rows -1."""
    import json

    files, root = filesystem(path)
    found = files.get_file_info(root)
    if found.type == fs.FileType.Directory:
        with files.open_input_stream(f"{root}/{MANIFEST}") as f:
            return [(f"{root}/{name}", rows, size) for name, rows, size in json.loads(f.read())["parts"]]
    return [(root, -1, found.size)]


@dataclass
class Frames(InputPartition):
    """Frames start to end of the array, in a file that begins with frame first."""

    start: int
    end: int
    file: str = ""
    first: int = 0


class RawSource(DataSource):
    """Format ``rawf32``: rows (v, s, t, data) of a float32 file, or of a folder of parts. Options: path; shape, as 1,1,20,256,256; split_bytes.

    A file that is shorter than the shape is an error; bytes after it are ignored. Equality and ranges on v, s and
    t are taken over: frames outside them are not read.
    """

    @classmethod
    def name(cls) -> str:
        return "rawf32"

    def schema(self) -> str:
        return "v long, s long, t long, data array<float>"

    def reader(self, schema) -> DataSourceReader:
        return RawReader(self.options)


class RawReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.shape = options["path"], five([int(n) for n in options["shape"].split(",")])
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.spans = {"v": [0, self.shape[0]], "s": [0, self.shape[1]], "t": [0, self.shape[2]]}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            span = self.spans.get(f.attribute[0]) if isinstance(f, EqualTo | GreaterThanOrEqual | LessThan) else None
            if span is None:
                yield f
            elif isinstance(f, LessThan):
                span[1] = min(span[1], f.value)
            else:
                span[0] = max(span[0], f.value)
                span[1] = min(span[1], f.value + 1) if isinstance(f, EqualTo) else span[1]

    def partitions(self) -> list[Frames]:
        frame = 4 * self.shape[3] * self.shape[4]
        n = self.shape[0] * self.shape[1] * self.shape[2]
        parts, first = [], 0
        step = max(1, self.split // frame)
        for file, _, size in listing(self.path):
            end = min(first + size // frame, n)
            parts += [Frames(a, min(a + step, end), file, first) for a in range(first, end, step)]
            first = end
        if first < n:
            raise ValueError(f"{self.path} is shorter than its shape {self.shape}")
        return [p for p in parts if any(self._wanted(i) for i in (p.start, p.end - 1)) or any(map(self._wanted, range(p.start, p.end)))] or [Frames(0, 0)]

    def _wanted(self, i: int) -> bool:
        _, s, t = self.shape[:3]
        at = {"v": i // (s * t), "s": i // t % s, "t": i % t}
        return all(self.spans[k][0] <= at[k] < self.spans[k][1] for k in at)

    def read(self, partition: Frames) -> Iterator[pa.RecordBatch]:
        files, _ = filesystem(self.path)
        _, s, t, h, w = self.shape
        i = np.arange(partition.start, partition.end)
        places = {"v": i // (s * t), "s": i // t % s, "t": i % t}
        wanted = np.flatnonzero(np.all([(self.spans[k][0] <= at) & (at < self.spans[k][1]) for k, at in places.items()], axis=0))
        runs = np.split(wanted, np.flatnonzero(np.diff(wanted) > 1) + 1) if len(wanted) else []
        most = max(1, READ_BYTES // (4 * h * w))
        with files.open_input_file(partition.file) if runs else nullcontext() as f:
            for run in (r[k : k + most] for r in runs for k in range(0, len(r), most)):
                f.seek((int(i[run[0]]) - partition.first) * 4 * h * w)
                data = np.frombuffer(f.read(4 * h * w * len(run)), "<f4").reshape(len(run), h * w)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(data.ravel()), h * w).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*(pa.array(at[run]) for at in places.values()), lists], names=["v", "s", "t", "data"])


def read_raw(spark: SparkSession, path: str, shape: Sequence[int]) -> DataFrame:
    """Frames (v, s, t, data) of a float32 file."""
    spark.dataSource.register(RawSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("rawf32").option("shape", ",".join(map(str, shape))).load(path)


def write_raw(frames: DataFrame, path: str) -> None:
    """Frames as one float32 file. The tasks write parts, in order of (v, s, t); the driver joins them, a part at a time."""
    ordered = frames.select("v", "s", "t", "data").repartitionByRange("v", "s", "t").sortWithinPartitions("v", "s", "t")
    files, target = filesystem(path)
    files.create_dir(target.rpartition("/")[0], recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, root = filesystem(path)
        part = f"{root}.part-{TaskContext.get().partitionId():05d}-{TaskContext.get().taskAttemptId()}"
        n = 0
        with own.open_output_stream(part) as out:
            for b in batches:
                out.write(b.column("data").flatten().cast(pa.float32()).to_numpy().astype("<f4").tobytes())
                n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([part])], names=["pid", "part"])

    parts = ordered.mapInArrow(run, "pid int, part string").collect()
    with files.open_output_stream(target) as out:
        for r in sorted(parts):
            with files.open_input_stream(r["part"]) as f:
                while chunk := f.read(8 << 20):
                    out.write(chunk)
            files.delete_file(r["part"])


def cells_of_frames(frames: DataFrame, width: int) -> DataFrame:
    """Cells (v, s, t, h, w, x) of frames."""
    e = frames.select("v", "s", "t", F.posexplode("data").alias("k", "x"))
    return e.select("v", "s", "t", F.floor(F.col("k") / width).cast("long").alias("h"), (F.col("k") % width).cast("long").alias("w"), F.col("x").cast("double").alias("x"))


def frames_of_cells(cells: DataFrame, width: int) -> DataFrame:
    k = F.col("h") * width + F.col("w")
    return cells.groupBy("v", "s", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), "x"))), lambda e: e["x"].cast("float")).alias("data"))


def read_ints(spark: SparkSession, path: str, cols: int, dtype: str = "<i4", with_file: bool = False) -> DataFrame:
    """(row, col, x) of files of whole numbers as matrices with cols columns, with the file if asked; sizes must divide.

    Files are read by the tasks in pieces of whole rows, so a file may have any size.
    """
    paths = spark.read.format("binaryFile").load(path).select("path", "length")
    width = cols * np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, size in zip(b.column("path").to_pylist(), b.column("length").to_pylist(), strict=True):
                if size % width:
                    raise ValueError("the file's size doesn't divide into rows")
                files, at = filesystem(file)
                with files.open_input_stream(at) as f:
                    row = 0
                    while data := f.read(max(1, (4 << 20) // width) * width):
                        x = np.frombuffer(data, dtype).astype(np.int64)
                        i = np.arange(len(x))
                        yield pa.RecordBatch.from_arrays([pa.array(row + i // cols), pa.array(i % cols), pa.array(x), pa.array([file] * len(x))], names=["row", "col", "x", "file"])
                        row += len(x) // cols

    found = paths.mapInArrow(run, "row long, col long, x long, file string")
    return found if with_file else found.drop("file")


def synthetic(spark: SparkSession, shape: Sequence[int] = (1, 1, 20, 256, 256)) -> DataFrame:
    """Cells of sin(X) cos(Y) cos(T / 10) + 0.3 sin(2X + T / 20), X along h and Y along w in [0, 2 pi], T in [0, 4 pi]."""
    sizes = five(shape)
    n = int(np.prod(sizes))
    v, s, t, h, w = unravel(F.col("id"), sizes)
    at = lambda c, size, top: c * (top / max(1, size - 1))
    x, y, z = at(h, sizes[3], 2 * np.pi), at(w, sizes[4], 2 * np.pi), at(t, sizes[2], 4 * np.pi)
    value = F.sin(x) * F.cos(y) * F.cos(0.1 * z) + 0.3 * F.sin(2 * x + 0.05 * z)
    return spark.range(n).select(v.alias("v"), s.alias("s"), t.alias("t"), h.alias("h"), w.alias("w"), value.cast("float").cast("double").alias("x"))
