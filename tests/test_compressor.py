"""Archives: bound, constants, short and ragged arrays, several variables, from files alone."""

import json
from datetime import datetime

import numpy as np
import pytest

from cubeweave.cli import main
from cubeweave.plans.compressor import Header, blocks_of, compress, decompress, load_header, sweep, verify
from cubeweave.scratch import new_path
from cubeweave.sources.files import append_metrics, find_model, load_container, load_streams, merge_json, read_npz, read_npz_pair, save_container, save_streams
from cubeweave.sources.parts import write_raw_parts, write_stream_parts
from cubeweave.sources.raw import cells_of_frames, frames_of_cells, read_ints, read_raw, synthetic, write_raw
from cubeweave.streaming.frames import write_frames

rng = np.random.default_rng(3)


def frames_from(spark, x):
    return spark.createDataFrame([(v, s, t, x[v, s, t].ravel().tolist()) for v in range(x.shape[0]) for s in range(x.shape[1]) for t in range(x.shape[2])], "v long, s long, t long, data array<float>")


@pytest.mark.parametrize("codec", ["pca", "lorenzo"])
@pytest.mark.parametrize("shape", [(1, 1, 20, 32, 32), (2, 2, 3, 10, 13), (1, 1, 1, 5, 5)])
def test_bound_holds_from_disk(spark, shape, codec):
    x = rng.normal(size=shape).cumsum(axis=-1).astype(np.float32)
    x[0] *= 10
    frames, path = frames_from(spark, x), new_path(spark, "t")
    compress(frames, shape, path, eps=1e-3, n_frame=8, block=(16, 16), codec=codec, predictor="keyframe3")
    found = verify(frames, decompress(spark, path)).first()
    assert found["missing"] == 0 and found["nrmse"] <= 1e-3 + 1.2e-7


def test_constant_array_comes_back(spark):
    x = np.full((1, 1, 8, 16, 16), 2.5, np.float32)
    frames, path = frames_from(spark, x), new_path(spark, "t")
    compress(frames, x.shape, path, block=(16, 16))
    assert load_header(path).range == 0
    assert verify(frames, decompress(spark, path)).first()["nrmse"] == 0


def test_bound_below_float_precision_is_rejected(spark):
    with pytest.raises(ValueError):
        compress(frames_from(spark, np.zeros((1, 1, 1, 2, 2))), (1, 1, 1, 2, 2), "x", eps=1e-8)


def test_sweep(spark):
    shape = (1, 1, 9, 16, 16)
    frames = frames_of_cells(synthetic(spark, shape), 16)
    for r in sweep(frames, shape, new_path(spark, "s"), [1e-2, 1e-3], block=(16, 16)):
        assert r["nrmse"] <= r["target"] and r["payload_bytes"] > 0


def test_raw_files(spark):
    shape = (2, 1, 3, 4, 5)
    frames = frames_of_cells(synthetic(spark, shape), 5)
    path = new_path(spark, "raw")
    write_raw(frames, path)
    back = read_raw(spark, path, shape)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, frames.select("v", "s", "t", "data").collect()))
    assert back.filter("v = 1 AND t >= 1").count() == 2
    assert cells_of_frames(back, 5).count() == 120
    with pytest.raises(Exception, match="shorter"):
        read_raw(spark, path, (9, 9, 9)).count()
    assert read_ints(spark, path, 5).count() == 120


def test_npz(spark, tmp_path):
    x = rng.normal(size=(3, 4, 5)).astype(np.float32)
    np.savez(tmp_path / "a.npz", data=x, original_data=x, recons_data=x + 1)
    assert read_npz(spark, f"file://{tmp_path}/a.npz").filter("t = 2").first()["data"] == x[2].ravel().tolist()
    pair = read_npz_pair(spark, f"file://{tmp_path}/a.npz").first()
    assert len(pair["orig"]) == len(pair["recon"]) == 20


def test_streams_and_container(spark, tmp_path):
    path = f"file://{tmp_path}/s.bin"
    save_streams(spark.createDataFrame([(1, b"xy"), (0, b"")], "sid long, payload binary"), path)
    assert [bytes(r["payload"]) for r in load_streams(spark, path).orderBy("sid").collect()] == [b"", b"xy"]
    (tmp_path / "cut.bin").write_bytes((tmp_path / "s.bin").read_bytes()[:-1])
    assert load_streams(spark, f"file://{tmp_path}/cut.bin").count() == 1
    rows = [(0, 0.5, 2, [b"a", b"bc"]), (1, 1.0, 1, [b""])]
    save_container(f"file://{tmp_path}/c", {"mean": 1.0}, spark.createDataFrame(rows, "id long, step double, bit_count int, streams array<binary>"))
    head, back = load_container(spark, f"file://{tmp_path}/c")
    assert head == {"mean": 1.0}
    assert [(r[0], r[1], r[2], [bytes(s) for s in r[3]]) for r in back.orderBy("id").collect()] == rows


def test_metrics_json_and_models(spark, tmp_path, monkeypatch):
    append_metrics(spark, f"file://{tmp_path}/m", [{"nrmse": 0.1}])
    append_metrics(spark, f"file://{tmp_path}/m", [{"nrmse": 0.2}])
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/m").count() == 2
    merge_json(str(tmp_path / "r.json"), {"a": [1]})
    assert merge_json(str(tmp_path / "r.json"), {"a": [2], "b": 3}, "cat") == {"a": [1, 2], "b": [3]}
    (tmp_path / "cdf.bin").write_bytes(b"x")
    monkeypatch.setenv("CUBEWEAVE_MODELS", str(tmp_path))
    assert find_model(spark, "cdf.bin") == f"{tmp_path}/cdf.bin"
    with pytest.raises(FileNotFoundError):
        find_model(spark, "none.bin")


def test_npz_slices_and_errors(spark, tmp_path):
    x = rng.normal(size=(2, 3, 4, 6, 5)).astype(np.float64)
    np.savez_compressed(tmp_path / "a.npz", data=x, original_data=x, recons_data=x[:1])
    got = read_npz(spark, f"file://{tmp_path}", variable=1, sections=(1, None), frames=(1, 3), crop=(2, 3)).collect()
    assert sorted((r["v"], r["s"], r["t"]) for r in got) == [(1, s, t) for s in (1, 2) for t in (1, 2)]
    for r in got:
        assert (r["height"], r["width"]) == (2, 3) and r["data"] == x[1, r["s"], r["t"], 2:4, 1:4].astype(np.float32).ravel().tolist()
    with pytest.raises(Exception, match="differ"):
        read_npz_pair(spark, f"file://{tmp_path}").count()


def test_only_parts_of_the_manifest_count(spark, tmp_path):
    folder = f"file://{tmp_path}/f"
    frames = frames_of_cells(synthetic(spark, (2, 1, 30, 4, 5)), 5)
    parts = write_raw_parts(frames.repartition(7), folder)
    assert sum(p.rows for p in parts) == 60
    (tmp_path / "f" / "part-of-a-lost-task").write_bytes(b"x" * 1000)
    want = sorted(map(tuple, frames.select("v", "s", "t", "data").collect()))
    read = read_raw(spark, folder, (2, 1, 30, 4, 5))
    assert sorted(map(tuple, read.collect())) == want and read.filter("v = 1 AND t >= 20").count() == 10
    write_raw(frames, f"file://{tmp_path}/whole")
    joined = b"".join((tmp_path / "f" / p.name).read_bytes() for p in parts)
    assert joined == (tmp_path / "whole").read_bytes()
    write_stream_parts(spark.createDataFrame([], "sid long, payload binary"), f"file://{tmp_path}/none")
    assert load_streams(spark, f"file://{tmp_path}/none").count() == 0


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    row = lambda day, v: (datetime(2024, 1, day, 12), "a", v)
    schema = "ts timestamp, event_type string, value double"
    for days in ((1, 2, 3), (4, 5)):
        spark.createDataFrame([row(k, float(k)) for k in days], schema).coalesce(1).write.mode("append").parquet(source)
        write_frames(spark, source, spark.read.parquet(source).schema, target)
    assert sorted(r["start"].day for r in spark.read.parquet(target).collect()) == [1, 2, 3, 4]


def test_cutting_takes_no_longer_on_a_longer_axis(spark):
    import time

    for T, rows, want in ((3, [0, 1, 2], {0: [0, 1, 2, 2, 1, 0, 0, 1]}), (2_000_000_000, [0, 1_999_999_999], {0: [0], 249_999_999: [1_999_999_999]})):
        frames = spark.createDataFrame([(0, 0, t, [float(t)] * 64) for t in rows], "v long, s long, t long, data array<float>")
        began = time.monotonic()
        got = {r["k"]: r["data"][::64] for r in blocks_of(frames, Header([1, 1, T, 8, 8], 8, [8, 8], "mean", "pca", 1e-3)).collect()}
        assert got == {k: np.float32(x).tolist() for k, x in want.items()} and time.monotonic() - began < 60


def test_raw_reads_only_the_frames_asked_for(spark, tmp_path):
    shape = (2, 3, 50, 2, 2)
    x = np.arange(np.prod(shape), dtype="<f4")
    (tmp_path / "x.bin").write_bytes(x.tobytes())
    got = read_raw(spark, str(tmp_path / "x.bin"), shape).filter("s = 1 AND t >= 7 AND t < 9").collect()
    assert {(r["v"], r["s"], r["t"]): r["data"] for r in got} == {(v, 1, t): x.reshape(shape)[v, 1, t].ravel().tolist() for v in (0, 1) for t in (7, 8)}


def test_command_line(spark, tmp_path, capsys):
    frames = frames_of_cells(synthetic(spark, (1, 1, 9, 16, 16)), 16)
    write_raw(frames, f"{tmp_path}/in")
    assert main(["compress", "--shape", "9,16,16", "--block", "16", "--error-bound", "1e-3", f"{tmp_path}/in", f"{tmp_path}/a"]) == 0
    assert main(["decompress", f"{tmp_path}/a", f"{tmp_path}/out", "--verify", f"{tmp_path}/in"]) == 0
    said = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert said["missing"] == 0 and said["nrmse"] <= 1e-3 + 1.2e-7
    a, b = (np.fromfile(tmp_path / n, "<f4") for n in ("in", "out"))
    assert np.sqrt(((a - b) ** 2).mean()) / (a.max() - a.min()) <= 1e-3 + 1.2e-7
