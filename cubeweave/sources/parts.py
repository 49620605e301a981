"""Folders of part files with a manifest: what tasks write side by side in place of one file that the driver writes.

The parts in the manifest's order are the single file, byte for byte. A part has a name of its own for every attempt of
a task, and only those that the manifest names count, so lost executors and repeated tasks leave nothing behind that
is read.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeweave.sources.raw import MANIFEST, filesystem


@dataclass
class Part:
    """A part file: its name, number of rows and bytes."""

    name: str
    rows: int
    bytes: int


def write_parts(rows: DataFrame, folder: str, order: list[str], encode: Callable[[pa.RecordBatch], bytes], **more: object) -> list[Part]:
    """The rows, in order of columns that should be total, as parts of a folder. The driver gets a row a task."""
    files, root = filesystem(folder)
    files.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, path = filesystem(folder)
        name, n, size = f"part-{uuid.uuid4().hex}", 0, 0
        with own.open_output_stream(f"{path}/{name}") as out:
            for b in batches:
                data = encode(b)
                out.write(data)
                n, size = n + b.num_rows, size + len(data)
        if not n:
            own.delete_file(f"{path}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((TaskContext.get().partitionId(), pa.int32()), (name, pa.string()), (n, pa.int64()), (size, pa.int64()))], names=["pid", "name", "rows", "bytes"])

    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = ordered.mapInArrow(run, "pid int, name string, rows long, bytes long").filter("rows > 0").collect()
    parts = [Part(r["name"], r["rows"], r["bytes"]) for r in sorted(found, key=lambda r: r["pid"])]
    text = json.dumps({"parts": [[p.name, p.rows, p.bytes] for p in parts], **more}).encode()
    with files.open_output_stream(f"{root}/{MANIFEST}.tmp") as out:
        out.write(text)
    files.move(f"{root}/{MANIFEST}.tmp", f"{root}/{MANIFEST}")
    return parts


def write_raw_parts(frames: DataFrame, folder: str) -> list[Part]:
    """Frames (v, s, t, data) as headerless float32 parts, which read_raw() reads as one file."""
    return write_parts(frames.select("v", "s", "t", "data"), folder, ["v", "s", "t"], lambda b: b.column("data").flatten().cast(pa.float32()).to_numpy().astype("<f4").tobytes())


def write_stream_parts(streams: DataFrame, folder: str) -> list[Part]:
    """Streams (sid, payload) as parts of (64-bit length, bytes), which load_streams() reads as one file."""
    def encode(b: pa.RecordBatch) -> bytes:
        return b"".join(struct.pack("<Q", len(p)) + p for p in b.column("payload").to_pylist())

    return write_parts(streams.select("sid", "payload"), folder, ["sid"], encode)


def encode_resumable(blocks: DataFrame, folder: str, coder: Callable[[dict], bytes], *, chunk: int = 1024, header: Mapping | None = None) -> DataFrame:
    """Code rows with a column id into chunks of ids, a file a chunk: (chunk, blocks, bytes) of the chunks made now.

    A chunk's file is renamed when complete, so a run that is repeated codes only the chunks that are missing; the
    blocks of a chunk stand in order of id, which makes the files in order of their names the whole.
    """
    files, root = filesystem(folder)
    files.create_dir(root, recursive=True)
    if header is not None:
        with files.open_output_stream(f"{root}/header.json") as out:
            out.write(json.dumps(dict(header), sort_keys=True).encode())
    numbered = blocks.withColumn("__chunk", F.floor(F.col("id") / chunk).cast("long"))
    if done := chunks_of(folder):
        known = blocks.sparkSession.createDataFrame([(k,) for k in done], "__chunk long")
        numbered = numbered.join(known, "__chunk", "left_anti")

    def run(table: pa.Table) -> pa.Table:
        own, path = filesystem(folder)
        rows = table.sort_by("id").to_pylist()
        k, name = rows[0]["__chunk"], uuid.uuid4().hex
        size = 0
        with own.open_output_stream(f"{path}/_{name}") as out:
            for r in rows:
                data = coder(r)
                out.write(struct.pack("<qQ", r["id"], len(data)) + data)
                size += len(data)
        own.move(f"{path}/_{name}", f"{path}/chunk-{k:016d}")
        return pa.table({"chunk": [k], "blocks": [len(rows)], "bytes": [size]})

    return numbered.groupBy("__chunk").applyInArrow(run, "chunk long, blocks long, bytes long")


def chunks_of(folder: str) -> list[int]:
    """The chunks that are complete."""
    from pyarrow import fs

    files, root = filesystem(folder)
    names = (m.base_name for m in files.get_file_info(fs.FileSelector(root, allow_not_found=True)))
    return sorted(int(n.removeprefix("chunk-")) for n in names if n.startswith("chunk-"))


def decode_chunks(spark, folder: str, decoder: Callable[[int, bytes], object], schema: str) -> DataFrame:
    """Rows (id, value) of all chunks: decoder(id, data) gives the value. A file is read a block at a time."""
    files, root = filesystem(folder)
    kind = spark.createDataFrame([], schema).schema
    paths = spark.createDataFrame([(f"{folder.rstrip('/')}/chunk-{k:016d}",) for k in chunks_of(folder)], "path string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        names = to_arrow_schema(kind)
        for b in batches:
            for path in b.column("path").to_pylist():
                own, at = filesystem(path)
                with own.open_input_stream(at) as f:
                    while head := f.read(16):
                        i, n = struct.unpack("<qQ", head)
                        yield pa.RecordBatch.from_pylist([dict(zip(names.names, (i, decoder(i, f.read(n))), strict=True))], names)

    return paths.repartition(max(1, min(paths.count(), spark.sparkContext.defaultParallelism))).mapInArrow(run, schema)
