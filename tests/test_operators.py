"""Catalogue queries against DuckDB at the smallest size, and operators that the catalogue doesn't reach."""

import glob
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cubeweave.components import components
from cubeweave.functions import codes
from cubeweave.operators import entropy, layout, biased_codec, select, stats
from cubeweave.plans import catalogue, catalogue_files, catalogue_more  # noqa: F401  these register their queries
from cubeweave.ranking import rank_in_groups
from cubeweave.rowkeys import with_row_keys

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def cell(x):
    return "nan" if isinstance(x, float) and math.isnan(x) else repr([*x]) if isinstance(x, list | tuple) else repr(x)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_catalogue(spark, db, name):
    got = catalogue.QUERIES[name](spark, SF).toArrow()
    want = db.sql(catalogue.ORACLES[name]).arrow().read_all()
    names = sorted(got.column_names)
    assert names == sorted(want.column_names)
    rows = lambda t: sorted(tuple(cell(r[c]) for c in names) for r in t.to_pylist())
    assert rows(got) == rows(want)


def cells(spark, x):
    return spark.createDataFrame([(0, 0, *map(int, i), float(v)) for i, v in np.ndenumerate(x)], "v long, s long, t long, h long, w long, x double")


def dense(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["t"], r["h"], r["w"]] = r["x"]
    return out


@pytest.mark.parametrize("frames", [1, 3, 5, 9, 20])
def test_tail_of_short_axes(spark, frames):
    x = np.arange(frames, dtype=float)[:, None, None]
    got = dense(layout.tail_reflect(cells(spark, x), 8), (-(-frames // 8) * 8, 1, 1)).ravel()
    want = np.concatenate([x.ravel(), x.ravel()[::-1]] * 9)[: len(got)]
    assert (got == want).all()


@pytest.mark.parametrize(("size", "block"), [((8, 8), (4, 4)), ((5, 7), (4, 4)), ((3, 2), (9, 9))])
def test_block_split_pads_as_numpy_does(spark, size, block):
    x = np.random.default_rng(1).normal(size=(2, *size))
    h, w, top, left = layout.widened(size, block)
    wide = np.pad(x, ((0, 0), (top, top), (left, left)))
    pads = [((-n % b) // 2, -n % b - (-n % b) // 2) for n, b in zip((h, w), block, strict=True)]
    wide = np.pad(wide, ((0, 0), *pads), mode="reflect")
    cols = wide.shape[2] // block[1]
    blocks = layout.block_split(cells(spark, x), size, block)
    for r in blocks.collect():
        assert r["x"] == wide[r["t"], r["s"] // cols * block[0] + r["h"], r["s"] % cols * block[1] + r["w"]]
    assert blocks.count() == wide.size
    assert (dense(layout.block_merge(blocks, size, block), x.shape) == x).all()


def test_nan_is_never_constant(spark):
    rows = [(0, 0, 0, 1.0), (0, 0, 0, 1.0), (0, 0, 1, float("nan")), (0, 0, 1, float("nan")), (0, 0, 2, 1.0), (0, 0, 2, 2.0), (0, 0, 3, None), (0, 0, 3, 1.0)]
    df = spark.createDataFrame(rows, "v long, s long, k long, x double")
    assert [tuple(r) for r in stats.constant_blocks(df).collect()] == [(0, 0, 0, 1.0)]


def test_zero_scale_is_an_error(spark):
    df = spark.createDataFrame([(0, 1.0)], "v long, x double")
    with pytest.raises(Exception, match="scale is zero"):
        stats.normalize_with(df, spark.createDataFrame([(0, 0.0, 0.0)], "v long, offset double, scale double"), ["v"]).collect()


def test_half_steps_and_bits(spark):
    df = spark.createDataFrame([(x,) for x in (-2.5, -1.5, -0.5, 0.5, 1.5, 2.5)], "x double")
    assert [r[0] for r in df.select(codes.quantize(F.col("x"), 1.0)).collect()] == [-2, -2, 0, 0, 2, 2]
    assert [r[0] for r in df.select(codes.unzigzag(codes.zigzag(codes.quantize(F.col("x"), 1.0)))).collect()] == [-2, -2, 0, 0, 2, 2]
    bits = spark.createDataFrame(list(enumerate([1, 0, 1, 1, 0, 0, 1, 0])), "i long, bit long").withColumn("p", F.lit(0))
    assert select.pack(bits, ["p"]).first()["byte"] == 178
    assert select.unpack(select.pack(bits, ["p"]), ["p"]).orderBy("i").select("bit").toPandas().bit.tolist() == [1, 0, 1, 1, 0, 0, 1, 0]
    assert df.select(F.max(codes.clamp(F.col("x"), -1.0, 1.0))).first()[0] == 1.0
    assert df.select(codes.quantize_around(F.col("x"), F.lit(0.25))).first()[0] == -2.75


def test_prefix_of_known_masks(spark):
    flags = spark.createDataFrame([(0, 1), (1, 0), (1, 3), (2, 3)], "pid long, k long")
    got = {r["pid"]: (r["last"], r["bits"]) for r in select.prefix_lengths(flags, 4).collect()}
    assert got == {0: (1, [0, 1]), 1: (3, [1, 0, 0, 1]), 2: (3, [0, 0, 0, 1])}


def test_gaussian_columns(spark):
    scales, _, _ = entropy.gaussian_tables(16)
    rows = [(float(x), s) for x in (-7, 0, 3) for s in (0.05, 0.1, scales[4], 3.3, 50.0)]
    df = spark.createDataFrame(rows, "x double, s double").select("x", "s", codes.scale_row(F.col("s"), scales).alias("r"), codes.normal_likelihood(F.col("x"), F.col("s")).alias("p"))
    for r in df.collect():
        assert r["r"] == entropy.scale_row(r["s"], scales)
        assert r["p"] == pytest.approx(entropy.likelihood(r["x"], r["s"]), rel=1e-4, abs=2e-7)


def test_biased_codec_round_trip_and_step(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6, 9, 7)).cumsum(axis=0)
    y = x + 0.05 * rng.normal(size=x.shape)
    pairs = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x.ravel(), y.ravel(), strict=True)], "x double, y double")
    step, span = biased_codec.global_step(pairs, 1e-3, bisections=8)
    q = np.rint((x - y) / step).astype(int)
    assert np.sqrt(((x - y - q * step) ** 2).mean()) / span <= 1e-3
    assert biased_codec.global_step(pairs, 0.5)[0] == 1.0
    blocks = spark.createDataFrame([(i, [3, 9, 7], (q[3 * i : 3 * i + 3]).ravel().tolist()) for i in range(2)], "id long, shape array<int>, q array<long>")
    weights = biased_codec.fit_bias(blocks)
    back = biased_codec.decompress(biased_codec.compress(blocks, weights).join(blocks.select("id", "shape"), "id"), weights)
    assert {r["id"]: r["q"] for r in back.collect()} == {r["id"]: r["q"] for r in blocks.collect()}


def test_global_step_value_is_that_of_its_sql(spark, tmp_path):
    rng = np.random.default_rng(1)
    spread = lambda r: np.concatenate([r, -r])
    cases = {  # residuals whose error at the first step is above the bound, is below it, and that need no step
        "null": spread(np.where(rng.random((50, 64)) < 0.5, 0.03, 0.5)),
        "step": spread(np.where(rng.random((50, 64)) < 0.5, 0.01, 0.5)),
        "small": np.arange(100)[:, None] % 2 + 1e-4 * rng.normal(size=(100, 64)),
    }
    for name, x in cases.items():
        rows = [(i, v.astype(np.float32).tolist(), i % 2 if name == "small" else 0) for i, v in enumerate(x)]
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"file://{tmp_path}/{name}/embeddings.parquet")
        con = duckdb.connect()
        con.execute(f"create view embeddings as select * from '{tmp_path}/{name}/embeddings.parquet/*.parquet'")
        want = con.execute(catalogue.ORACLES["global_step_value"]).fetchone()[0]
        got = catalogue.QUERIES["global_step_value"](spark, f"file://{tmp_path}/{name}").first()[0]
        assert got == want and (got is None) == (name == "null")


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (300, 301), (301, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ranks_and_row_keys(spark):
    rows = [(i % 3 if i % 5 else None, i * 7 % 50) for i in range(50)]
    got = rank_in_groups(spark.createDataFrame(rows, "g long, o long"), ["g"], ["o"], partitions=7).collect()
    for g in {r[0] for r in rows}:
        part = sorted((r["o"], r["rank"]) for r in got if r["g"] == g)
        assert [k for _, k in part] == list(range(len(part)))
    keyed = with_row_keys(spark.read.parquet(f"{SF}/documents.parquet"))
    assert keyed.select("__file", "__row").distinct().count() == keyed.count() == 200
    assert with_row_keys(spark.range(5).withColumn("_METADATA", F.lit(1))).columns == ["c0", "c1", "__file", "__row"]


def test_crops_and_resampling(spark):
    x = np.random.default_rng(3).normal(size=(2, 6, 8))
    got = dense(layout.random_crop(cells(spark, x), (6, 8), (4, 5), 7), (2, 4, 5))
    for t in range(2):
        assert any((x[t, i : i + 4, j : j + 5] == got[t]).all() for i in range(3) for j in range(4))
    assert (dense(layout.random_crop(cells(spark, x), (6, 8), (6, 10), 7), (2, 6, 10))[:, :, 1:9] == x).all()
    flat = np.full((1, 4, 4), 2.5)
    assert np.allclose(dense(layout.resample(cells(spark, flat), (4, 4), (7, 3)), (1, 7, 3)), 2.5)


def test_stream_of_frames_is_the_batch(spark, tmp_path):
    from cubeweave.streaming.frames import daily_frames, write_frames

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(f"file://{tmp_path}/in")
    write_frames(spark, f"file://{tmp_path}/in", events.schema, f"file://{tmp_path}/out", late="60 days")
    got = {(r["event_type"], r["start"]): r["n"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect()} if os.listdir(tmp_path / "out") else {}
    want = {(r["event_type"], r["start"]): r["n"] for r in daily_frames(events).collect()}
    assert all(want[k] == n for k, n in got.items())


def test_all_bit_planes_give_the_codes_back(spark):
    d = "/root/testdata/sf0.01"
    bits = select.unpack(catalogue.bitplane_pack_all(spark, d), ["v", "b", "plane"], msb_first=False)
    back = {(r["v"], r["b"], r["i"]): r["z"] for r in bits.groupBy("v", "b", "i").agg(F.sum(F.col("bit") * F.pow(F.lit(2), F.col("plane")).cast("long")).alias("z")).collect()}
    want = {(r["v"], r["b"], (r["t"] * 8 + r["h"]) * 8 + r["w"]): r["z"] for r in catalogue.zigzag_codes(spark, d).collect()}
    assert max(want.values()) > 15 and all(back[k] == z for k, z in want.items())


def test_raw_file_has_every_frame(spark):
    d = "/root/testdata/sf0.01"
    got, want = catalogue.raw_file_roundtrip_all(spark, d), catalogue.cube_e(spark, d)
    lengths = {r["n"] for r in want.groupBy("v").agg((F.count("*") / 64).alias("n")).collect()}
    assert len(lengths) > 1 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_steps_of_a_batch_are_those_of_each_block():
    from cubeweave.operators.residual_codec import find_step, find_steps

    rng = np.random.default_rng(6)
    r = rng.normal(size=(20, 64)) * rng.choice([0.001, 0.1, 1, 30], 20)[:, None]
    got = find_steps(r, np.full(20, 0.02**2 * 64), np.full(20, 0.02 / 1000))
    for k in range(20):
        sse = lambda st, k=k: ((r[k] - np.rint(r[k] / st) * st) ** 2).sum()
        assert got[k] == 1 and (r[k] ** 2).sum() <= 0.02**2 * 64 or sse(got[k]) <= 0.02**2 * 64
        one, _ = find_step(r[k], np.zeros(64, np.float32), r[k].astype(np.float32), 0.02, 0.0, 1.0)
        assert got[k] == 1 and one == 1 or got[k] > 0.9 * one


def test_monotone_prior():
    rng = np.random.default_rng(7)
    prior = entropy.MonotonePrior([rng.normal(size=s) for s in ((3, 1), (3, 3), (1, 3))], [rng.normal(size=n) for n in (3, 3, 1)], [rng.normal(size=3), rng.normal(size=3)])
    x = np.linspace(-60, 60, 4001)
    assert (np.diff(prior.cdf(x)) >= 0).all()
    assert np.allclose(prior.cdf(prior.inverse(np.array([0.1, 0.5, 0.9]))), [0.1, 0.5, 0.9])
    k = np.arange(-300, 301)
    assert abs(prior.likelihood(k).sum() - 1) < 1e-4
    first, cdf = prior.table()
    entropy.check_cdf(cdf)
    assert first <= prior.inverse(np.array([0.5]))[0] <= first + 61 and len(cdf) == 63
    draws = prior.sample(20000, 1)
    assert abs((draws <= 0).mean() - prior.cdf(np.array([0.0]))[0]) < 0.02


def test_latents_are_coded_in_lanes_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(entropy, "PIECE", 5000)
    rng = np.random.default_rng(9)
    batch = entropy.pa.RecordBatch.from_pydict({"i": list(range(6))})
    assert [p.column(0).to_pylist() for p in entropy._pieces(batch, np.array([9000, 10, 4000, 0, 2000, 3000]))] == [[0], [1, 2, 3], [4, 5]]
    prior = entropy.MonotonePrior([np.ones((3, 1)), np.ones((1, 3))], [np.zeros(3), np.zeros(1)], [np.zeros(3)])
    rows = [(i, i % 2, (y := np.rint(rng.normal(scale=3, size=n)).astype(int) * np.where(rng.random(n) < 0.01, 10**6, 1)).tolist(), np.minimum(abs(y), 20).tolist()) for i, n in enumerate((0, 1, 1023, 1024, 1025, 6000))]
    given = spark.createDataFrame(rows, "sid long, part long, y array<long>, z array<long>")
    coder, keys = entropy.LatentCoder(prior), ("sid", "part")
    coded = coder.compress(given, keys)
    assert {r["sid"]: len(entropy._unpack_lanes(bytes(r["y_payload"]))) for r in coded.collect()} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 2, 5: 6}
    assert sorted(tuple(r) for r in coder.decompress(coded, keys).collect()) == rows


def test_a_worker_loads_once():
    import threading

    from cubeweave import workers

    calls = []
    threads = [threading.Thread(target=lambda: workers.once("k", lambda: calls.append(1) or len(calls))) for _ in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert calls == [1] and workers.once("k", lambda: 5) == 1
    workers.forget("k")
    assert workers.once("k", lambda: 5) == 5


def test_resampling_is_that_of_dense_products(spark):
    x = np.random.default_rng(8).normal(size=(5, 6, 7))
    for size, to, kind in (((6, 7), (4, 9), "cubic"), ((5, 6, 7), (3, 8, 2), "linear")):
        got = dense(layout.resample(cells(spark, x), size, to, kind), (to[0] if len(to) == 3 else 5, *to[-2:]))
        want = x
        for axis, have, goal in zip((0, 1, 2)[-len(size) :], size, to, strict=True):
            m = np.zeros((goal, have))
            for i, o, wt in layout.weights(have, goal, kind):
                m[o, i] += wt
            assert np.allclose(m.sum(axis=1), 1)
            want = np.moveaxis(np.tensordot(m, want, (1, axis)), 0, axis)
        assert np.allclose(got, want)
