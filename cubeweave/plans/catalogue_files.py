"""Registered queries that write and read files: arrays, streams, archives, metrics, and the command line."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeweave.functions.codes import quantize
from cubeweave.functions.index import linear
from cubeweave.plans.catalogue import PAIR, E, cube_e, query, table
from cubeweave.scratch import new_path
from cubeweave.sources.raw import cells_of_frames, filesystem, frames_of_cells, read_raw, synthetic


def _label(file: str = "file"):
    return F.regexp_extract(file, r"label-(\d+)", 1).cast("long")


def _npz(cells: DataFrame, folder: str, columns: dict[str, str]) -> None:
    """A file of each label, written by the tasks: its frames as arrays [t, 8, 8] under the given keys."""
    files, root = filesystem(folder)
    files.create_dir(root, recursive=True)

    def write(part: pa.Table) -> pa.Table:
        part = part.sort_by([("t", "ascending"), ("h", "ascending"), ("w", "ascending")])
        v, arrays = part["v"][0].as_py(), {k: part[c].to_numpy().astype(np.float32).reshape(-1, 8, 8) for k, c in columns.items()}
        own, at = filesystem(folder)
        with own.open_output_stream(f"{at}/label-{v}.npz") as out:
            np.savez(out, **arrays)
        return pa.table({"v": [v]})

    cells.groupBy("v").applyInArrow(write, "v long").write.format("noop").mode("overwrite").save()


@query(f"WITH {E} SELECT v, t, h - 1 AS h, w - 2 AS w, x FROM e WHERE t >= 3 AND h BETWEEN 1 AND 6 AND w BETWEEN 2 AND 5")
def npz_slice(spark, d):
    """An .npz file of each label, read from its third frame on and cut to the middle 6 x 4."""
    from cubeweave.sources.files import read_npz

    folder = new_path(spark, "npz")
    _npz(cube_e(spark, d), folder, {"data": "x"})
    got = read_npz(spark, folder, frames=(3, None), crop=(6, 4))
    return cells_of_frames(got.withColumn("v", _label()), 4).select("v", "t", "h", "w", "x")


@query(f"WITH {PAIR} SELECT CAST(label AS BIGINT) AS label, count(*) AS n, round(sum(pow(x - CAST(CAST(y AS FLOAT) AS DOUBLE), 2)), 4) AS sse FROM q GROUP BY 1")
def npz_pair(spark, d):
    """The frames of each label and what the label's mean predicts, in one file a label, read back as pairs."""
    from cubeweave.sources.files import read_npz_pair

    cells, folder = cube_e(spark, d), new_path(spark, "npz")
    mean = cells.groupBy("v", "h", "w").agg(F.avg("x").alias("y"))
    _npz(cells.join(mean, ["v", "h", "w"]), folder, {"original_data": "x", "recons_data": "y"})
    got = read_npz_pair(spark, folder).withColumn("v", _label())
    sse = F.aggregate(F.zip_with("orig", "recon", lambda a, b: F.pow(a.cast("double") - b.cast("double"), 2)), F.lit(0.0), lambda m, e: m + e)
    return got.groupBy(F.col("v").alias("label")).agg(F.sum(F.size("orig")).alias("n"), F.round(F.sum(sse), 4).alias("sse"))


@query(f"WITH {E} SELECT v, t AS row, h * 8 + w AS col, CAST(round_even(x / 0.05, 0) AS BIGINT) AS x FROM e")
def int_file_matrix(spark, d):
    """Codes of each label as a headerless int32 file, read back as a matrix of 64 columns."""
    from cubeweave.sources.raw import read_ints

    folder = new_path(spark, "ints")
    files, root = filesystem(folder)
    files.create_dir(root, recursive=True)
    rows = cube_e(spark, d).select("v", linear([(F.col("t"), 1), (F.col("h"), 8), (F.col("w"), 8)]).alias("i"), quantize(F.col("x"), 0.05).alias("q"))

    def write(part: pa.Table) -> pa.Table:
        part = part.sort_by("i")
        own, at = filesystem(folder)
        with own.open_output_stream(f"{at}/label-{part['v'][0].as_py()}.bin") as out:
            out.write(part["q"].to_numpy().astype("<i4").tobytes())
        return pa.table({"v": part["v"][:1]})

    rows.groupBy("v").applyInArrow(write, "v long").write.format("noop").mode("overwrite").save()
    return read_ints(spark, folder, 64, with_file=True).select(_label().alias("v"), "row", "col", "x")


@query("SELECT CAST(label AS BIGINT) AS label, count(*) AS patches, CAST(r AS BIGINT) AS run FROM embeddings, (SELECT unnest([0, 1]) AS r) GROUP BY 1, 3")
def metrics_csv(spark, d):
    """Counts of each label appended to a CSV table twice, and read back."""
    from cubeweave.sources.files import append_metrics

    path = new_path(spark, "metrics")
    counts = [r.asDict() for r in table(spark, d, "embeddings").groupBy(F.col("label").cast("long").alias("label")).agg(F.count("*").alias("patches")).collect()]  # a row a label
    for run in range(2):
        append_metrics(spark, path, [r | {"run": run} for r in counts])
    return spark.read.option("header", True).schema("label long, patches long, run long").csv(path)


@query("SELECT CAST(label AS VARCHAR) AS label, count(*) AS newest, [count(*), 2 * count(*)] AS all_of_them FROM embeddings GROUP BY 1")
def merged_results(spark, d):
    """A JSON file of results that is updated twice, and one whose lists grow."""
    from cubeweave.sources.files import merge_json

    path = new_path(spark, "results")
    files, root = filesystem(path)
    files.create_dir(root, recursive=True)
    counts = {str(r[0]): r[1] for r in table(spark, d, "embeddings").groupBy("label").count().collect()}  # a row a label
    for k in (1, 2):
        merge_json(f"{path}/newest.json", {s: n if k == 2 else -n for s, n in counts.items()})
        merge_json(f"{path}/all.json", {s: k * n for s, n in counts.items()}, "cat")
    read = lambda name, kind: spark.read.text(f"{path}/{name}", wholetext=True).select(F.explode(F.from_json("value", f"map<string, {kind}>")).alias("label", name.split(".")[0]))
    return read("newest.json", "bigint").join(read("all.json", "array<bigint>"), "label").select("label", "newest", F.col("all").alias("all_of_them"))


@query("SELECT * FROM (VALUES ('own.bin', 'setting'), ('both.bin', 'setting'), ('env.bin', 'environment'), ('none.bin', 'missing')) AS t(name, place)")
def model_lookup(spark, d):
    """Where a model's file is found: the setting's folder before that of the environment."""
    import os

    from cubeweave.sources.files import find_model

    places = {"setting": new_path(spark, "models"), "environment": new_path(spark, "models")}
    for place, names in (("setting", ("own.bin", "both.bin")), ("environment", ("both.bin", "env.bin"))):
        files, root = filesystem(places[place])
        files.create_dir(root, recursive=True)
        for n in names:
            with files.open_output_stream(f"{root}/{n}") as out:
                out.write(b"x")
    before = spark.conf.get("spark.cubeweave.models", None), os.environ.get("CUBEWEAVE_MODELS")
    spark.conf.set("spark.cubeweave.models", places["setting"])
    os.environ["CUBEWEAVE_MODELS"] = places["environment"]
    rows = []
    try:
        for n in ("own.bin", "both.bin", "env.bin", "none.bin"):
            try:
                at = find_model(spark, n)
                rows.append((n, next(p for p, folder in places.items() if at.startswith(folder))))
            except FileNotFoundError:
                rows.append((n, "missing"))
    finally:
        spark.conf.unset("spark.cubeweave.models") if before[0] is None else spark.conf.set("spark.cubeweave.models", before[0])
        os.environ.pop("CUBEWEAVE_MODELS") if before[1] is None else os.environ.update(CUBEWEAVE_MODELS=before[1])
    return spark.createDataFrame(rows, "name string, place string")


@query(f"WITH {E} SELECT v, s, t, h, w, x FROM e")
def raw_parts_roundtrip(spark, d):
    """All frames of all labels as float32 parts that tasks write side by side, read back as one array."""
    from pyspark.sql import Window

    from cubeweave.sources.parts import write_raw_parts

    frames, path = frames_of_cells(cube_e(spark, d), 8), new_path(spark, "raw-parts")
    n = sum(p.rows for p in write_raw_parts(frames, path))
    lengths = frames.groupBy("v").agg(F.count("*").alias("n"))  # a row a label
    spans = lengths.select(F.col("v").alias("label"), (F.sum("n").over(Window.orderBy("v")) - F.col("n")).alias("start"), "n")
    read = read_raw(spark, path, (1, 1, n, 8, 8))
    met = read.join(F.broadcast(spans), (F.col("t") >= F.col("start")) & (F.col("t") < F.col("start") + F.col("n")))
    return cells_of_frames(met.select(F.col("label").cast("long").alias("v"), "s", (F.col("t") - F.col("start")).alias("t"), "data"), 8)


@query("SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS sid, md5(rpad(hex(vec_id), CAST(16 + vec_id % 97 AS INTEGER), '0')) AS digest FROM embeddings")
def stream_parts_roundtrip(spark, d):
    """Byte streams of many lengths as parts that tasks write, read back and hashed."""
    from cubeweave.sources.files import load_streams
    from cubeweave.sources.parts import write_stream_parts

    path = new_path(spark, "stream-parts")
    text = F.expr("rpad(hex(vec_id), cast(16 + vec_id % 97 AS int), '0')")
    write_stream_parts(table(spark, d, "embeddings").select(F.col("vec_id").alias("sid"), F.encode(text, "UTF-8").alias("payload")), path)
    return load_streams(spark, path).select("sid", F.md5("payload").alias("digest"))


@query(f"WITH {E} SELECT v AS id, CAST(sum(CAST(round_even(x / 0.05, 0) AS BIGINT)) AS BIGINT) AS total, count(*) AS n, CAST(sum(CAST(round_even(x / 0.05, 0) AS BIGINT) * ((t * 8 + h) * 8 + w + 1)) AS BIGINT) AS places, true AS resumed FROM e GROUP BY 1")
def biased_codec_resumed(spark, d):
    """Codes of each label through the biased codec into chunk files; one chunk is deleted and made again, and all are
    decoded: sums of the codes, also weighted by their places."""
    from cubeweave.operators import biased_codec
    from cubeweave.sources.parts import chunks_of, decode_chunks, encode_resumable

    k = linear([(F.col("t"), 1), (F.col("h"), 8), (F.col("w"), 8)])
    rows = cube_e(spark, d).select(F.col("v").alias("id"), k.alias("k"), quantize(F.col("x"), 0.05).alias("q")).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "q"))), lambda e: e["q"]).alias("q"))
    blocks = rows.withColumn("shape", F.array((F.size("q") / 64).cast("int"), F.lit(8), F.lit(8)))
    weights, path = biased_codec.fit_bias(blocks), new_path(spark, "chunks")

    def coder(r: dict) -> bytes:
        _, streams = biased_codec.encode_codes(np.array(r["q"], np.int64).reshape(r["shape"]), weights)
        return struct.pack("<4I", *r["shape"], len(streams)) + b"".join(struct.pack("<I", len(s)) + s for s in streams)

    def decoder(_: int, data: bytes) -> list[int]:
        *shape, n = struct.unpack_from("<4I", data)
        at, streams = 16, []
        for _ in range(n):
            (size,) = struct.unpack_from("<I", data, at)
            streams.append(data[at + 4 : at + 4 + size])
            at += 4 + size
        return biased_codec.decode_codes(streams, shape, weights).ravel().tolist()

    first = encode_resumable(blocks, path, coder, chunk=3, header={"weights": weights.tolist()}).collect()  # a row a chunk
    files, root = filesystem(path)
    files.delete_file(f"{root}/chunk-{chunks_of(path)[0]:016d}")
    again = encode_resumable(blocks, path, coder, chunk=3).collect()
    resumed = len(again) == 1 and again[0]["chunk"] == min(r["chunk"] for r in first)
    back = decode_chunks(spark, path, decoder, "id long, q array<bigint>").select("id", F.posexplode("q").alias("k", "q"))
    return back.groupBy("id").agg(F.sum("q").alias("total"), F.count("*").alias("n"), F.sum(F.col("q") * (F.col("k") + 1)).alias("places"), F.lit(resumed).alias("resumed"))


@query("SELECT count(*) AS frames, CAST(0 AS BIGINT) AS missing, true AS within FROM embeddings")
def archive_cube_e(spark, d):
    """All frames of all labels compressed to an archive and read back from its files; short labels end in zeros."""
    from cubeweave.plans.compressor import compress, decompress, verify

    frames = frames_of_cells(cube_e(spark, d), 8)
    n = frames.agg(F.max("t") + 1).first()[0]
    labels = frames.select("v").distinct().count()
    grid = spark.range(labels).select(F.col("id").alias("v"), F.lit(0).cast("long").alias("s"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("t"))
    whole = grid.join(frames, ["v", "s", "t"], "left").withColumn("data", F.coalesce("data", F.array_repeat(F.lit(0.0).cast("float"), 64)))
    path = new_path(spark, "archive")
    compress(whole, (labels, 1, n, 8, 8), path, eps=1e-3, block=(8, 8))
    found = verify(whole, decompress(spark, path)).withColumn("given", F.lit(frames.count()).cast("long"))
    return found.select(F.col("given").alias("frames"), "missing", (F.col("nrmse") <= 1e-3 + 1.2e-7).alias("within"))


@query("SELECT CAST(20 AS BIGINT) AS frames, CAST(0 AS BIGINT) AS missing, true AS within")
def archive_256(spark, d):
    """The acceptance case: a field of (1, 1, 20, 256, 256), compressed, read back from files alone, NRMSE up to 1e-4."""
    from cubeweave.plans.compressor import compress, decompress, verify

    shape = (1, 1, 20, 256, 256)
    frames, path = frames_of_cells(synthetic(spark, shape), 256), new_path(spark, "archive")
    compress(frames, shape, path, eps=1e-4)
    return verify(frames, decompress(spark, path)).select("frames", "missing", (F.col("nrmse") <= 1e-4 + 1.2e-7).alias("within"))


@query("SELECT count(*) AS frames, CAST(0 AS BIGINT) AS missing, true AS within, true AS same FROM embeddings")
def command_line(spark, d):
    """The command line: compress, decompress and verify a file of all vectors as frames of 8 x 8."""
    import contextlib
    import io

    from cubeweave import cli
    from cubeweave.sources.parts import write_raw_parts
    from cubeweave.sources.raw import write_raw

    frames = table(spark, d, "embeddings").select(F.lit(0).cast("long").alias("v"), F.lit(0).cast("long").alias("s"), F.col("vec_id").alias("t"), F.col("embedding").cast("array<float>").alias("data"))
    given, parts, archive, out, metrics = (new_path(spark, n) for n in ("given", "given-parts", "archive", "out", "metrics"))
    write_raw(frames, given)
    n = sum(p.rows for p in write_raw_parts(frames, parts))
    with contextlib.redirect_stdout(io.StringIO()):
        cli.main(["compress", "--shape", f"{n},8,8", "--error-bound", "1e-3", "--block", "8", given, archive])
        cli.main(["decompress", archive, out, "--verify", given, "--metrics", metrics])
    read = lambda p: read_raw(spark, p, (n, 8, 8)).select("t", F.sha1(F.to_json(F.struct("data"))).alias("h"))
    same = read(given).join(read(parts).withColumnRenamed("h", "g"), "t").agg(F.min(F.col("h") == F.col("g"))).first()[0]
    row = spark.read.option("header", True).option("inferSchema", True).csv(metrics)
    return row.select(F.col("frames").cast("long").alias("frames"), F.col("missing").cast("long").alias("missing"), (F.col("nrmse") <= 1e-3 + 1.2e-7).alias("within"), F.lit(same).alias("same"))


@query("SELECT event_type, epoch(date_trunc('day', ts))::BIGINT AS day, count(*) AS n FROM events GROUP BY 1, 2 QUALIFY day < max(day) OVER ()")
def streamed_frames(spark, d):
    """The events as a stream in two runs of one query: the folder grows between them, and the second goes on where the
    first ended. Frames of the last day stay open, for its watermark never passes."""
    from cubeweave.streaming.frames import write_frames

    events = table(spark, d, "events")
    source, target = new_path(spark, "events"), new_path(spark, "frames")
    middle = events.select(F.expr("percentile_approx(ts, 0.5)")).first()[0]
    for half in (F.col("ts") < F.date_trunc("day", F.lit(middle)), F.col("ts") >= F.date_trunc("day", F.lit(middle))):
        events.filter(half).coalesce(1).write.mode("append").parquet(source)
        write_frames(spark, source, events.schema, target)
    got = spark.read.parquet(target)
    return got.select("event_type", (F.datediff(F.col("start").cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400).alias("day"), "n")


@query("SELECT CAST(label AS BIGINT) AS label, count(*) AS n, true AS loaded_once FROM embeddings GROUP BY 1")
def worker_cache(spark, d):
    """A table that every Python worker loads once, however many tasks and batches it runs."""
    def run(batches):
        from cubeweave.workers import once

        calls: list[int] = []

        def load() -> dict:
            calls.append(1)
            return {"factor": 1}

        for b in batches:
            for _ in range(3):
                once("worker_cache", load)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(calls) <= 1] * b.num_rows)], names=["label", "ok"])

    rows = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("label")).mapInArrow(run, "label long, ok boolean")
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.min("ok").alias("loaded_once"))
