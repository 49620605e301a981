"""Block codecs and layout against their definitions, with the shapes of the fixtures."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cubeweave.functions.index import pad_sides, tail_pad
from cubeweave.operators import entropy, corrector, residual_codec, lorenzo
from cubeweave.operators.layout import fits_5d, slice_grid, widened
from cubeweave.operators.predict import PREDICTORS

rng = np.random.default_rng(7)


def test_zigzag_of_known_values():
    v = np.array([0, 1, -1, 2, -2, 127, -128, 32767, -32768, 2**30, -(2**30)])
    u = lorenzo.zigzag(v)
    assert u[:5].tolist() == [0, 2, 1, 4, 3]
    assert (lorenzo.unzigzag(u) == v).all()


@pytest.mark.parametrize("q", [np.zeros((4, 4, 4), int), np.full((3, 5, 7), 42), rng.integers(-500, 501, (8, 10, 12))])
def test_lorenzo_round_trip(q):
    d = lorenzo.difference(q)
    assert (lorenzo.integrate(d) == q).all()
    if (q == 42).all():
        assert d.flat[0] == 42 and not d.ravel()[1:].any()


def test_lorenzo_is_the_seven_neighbour_difference():
    q = np.pad(rng.integers(-9, 9, (4, 5, 6)), ((1, 0),) * 3)
    pred = q[:-1, 1:, 1:] + q[1:, :-1, 1:] + q[1:, 1:, :-1] - q[:-1, :-1, 1:] - q[:-1, 1:, :-1] - q[1:, :-1, :-1] + q[:-1, :-1, :-1]
    assert (lorenzo.difference(q[1:, 1:, 1:]) == q[1:, 1:, 1:] - pred).all()


def test_strict_coding_with_a_bias_comes_back():
    q, bias = rng.integers(-30, 30, (4, 5, 6)), rng.normal(size=(4, 5, 6))
    assert (lorenzo.strict_inverse(lorenzo.strict_deltas(q, bias, 3.0), bias, 3.0) == q).all()


def test_bit_planes_round_trip():
    z = rng.integers(0, 256, 1000).astype(np.uint64)
    n, streams = entropy.plane_streams(z)
    assert n == 8 and (entropy.from_planes(streams, 1000) == z).all()
    assert entropy.plane_streams(np.zeros(5, np.uint64))[0] == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(10**6), 10**6), max_size=60))
def test_rans_round_trip_with_escapes(symbols):
    cdf = entropy.quantized_cdf([1.0] * 30 + [0.1])
    entropy.check_cdf(cdf)
    rows = [0] * len(symbols)
    assert entropy.decode(entropy.encode(symbols, rows, [cdf], -15), rows, [cdf], -15) == symbols


def test_rans_stays_near_the_entropy():
    p = np.array([0.7, 0.2, 0.1])
    s = rng.choice(3, 4000, p=p).tolist()
    data = entropy.encode(s, [0] * 4000, [entropy.quantized_cdf([*p, 1e-4])], 0)
    bits = -(p * np.log2(p)).sum() * 4000
    assert bits <= 8 * len(data) <= bits * 1.05 + 64


def test_gaussian_tables_and_rows():
    scales, tables, offset = entropy.gaussian_tables(16)
    for t in tables:
        entropy.check_cdf(t)
    assert offset == -123
    assert entropy.scale_row(0.01, scales) == 0
    assert entropy.scale_row(scales[3], scales) == 3
    assert entropy.scale_row(scales[3] * 1.001, scales) == 4
    assert entropy.scale_row(1e9, scales) == 15
    assert abs(sum(entropy.likelihood(k, 2.0) for k in range(-60, 61)) - 1) < 1e-6


def test_frames_reject_truncation():
    data = entropy.frame([b"abc", b"", b"x" * 1000])
    assert entropy.unframe(data, 3) == [b"abc", b"", b"x" * 1000]
    with pytest.raises(ValueError):
        entropy.unframe(data[:-1], 3)


@pytest.mark.parametrize(("shape", "noise", "eps"), [((100, 64), 0.1, 1e-3), ((50, 64), 1.5, 0.05), ((1, 64), 0.5, 0.01), ((30, 16), 1.0, 0.08)])
def test_corrector_holds_its_bound(spark, shape, noise, eps):
    n = shape[1]
    orig = rng.normal(size=shape)
    recon = orig + noise * rng.normal(size=shape)
    rows = spark.createDataFrame([(i, o.tolist(), r.tolist()) for i, (o, r) in enumerate(zip(orig, recon, strict=True))], "id long, orig array<double>, recon array<double>")
    basis = corrector.fit(rows, eps, n)
    fixed = corrector.decompress(rows.join(corrector.compress(rows, basis, n), "id"), basis, n).orderBy("id").collect()
    far = np.linalg.norm(orig - np.array([r["fixed"] for r in fixed]), axis=1)
    assert (far <= eps * np.sqrt(n) * (1 + 1e-9)).all()


def test_corrector_has_nothing_to_do_within_the_bound(spark):
    rows = spark.createDataFrame([(0, [1.0] * 64, [1.001] * 64)], "id long, orig array<double>, recon array<double>")
    assert corrector.fit(rows, 10.0) is None
    with pytest.raises(ValueError):
        corrector.fit(rows, 0.1, factor=2.5)


def test_corrector_packing_of_vectors_without_codes():
    bad = np.array([True, False, True])
    q = np.zeros((2, 8), np.int64)
    q[1, 3] = -70000
    b, back = corrector.unpack(corrector.pack(bad, q), 8)
    assert (b == bad).all() and (back == q).all()


@pytest.mark.parametrize("shape", [(16, 32, 32), (7, 10, 9), (1, 1, 1)])
def test_residual_codec_holds_its_bound(shape):
    orig = rng.normal(size=shape).astype(np.float32)
    recon = orig + 0.05 * rng.normal(size=shape).astype(np.float32)
    scale, mean = float(np.ptp(orig)) or 1.0, float(orig.mean())
    step, n, streams = residual_codec.encode_block(orig, recon, 1e-4, mean, scale)
    back = residual_codec.decode_block(recon, step, streams, mean, scale)
    assert np.sqrt(((back - orig) ** 2).mean()) / scale <= 1.05e-4
    assert n == len(streams)


def test_residual_codec_without_need_for_correction():
    x = np.ones((2, 2, 2), np.float32)
    assert residual_codec.encode_block(x, x, 1e-4, 0.0, 1.0)[:2] == (1.0, 1)


@pytest.mark.parametrize("name", list(PREDICTORS))
@pytest.mark.parametrize("shape", [(8, 16, 16), (1, 5, 7), (4, 1, 9)])
def test_predictors_decode_what_they_encode(name, shape):
    encode, decode = PREDICTORS[name]
    x = rng.uniform(-1, 1, shape)
    first = decode(encode(x), shape)
    assert first.shape == shape and (decode(encode(x), shape) == first).all()
    flat = decode(encode(np.full(shape, 0.25)), shape)
    assert np.abs(flat - 0.25).max() < 1e-3


def test_padding_arithmetic():
    assert pad_sides(20, 256) == (118, 118)
    assert widened((20, 20), (256, 256)) == (218, 218, 99, 99)
    assert tail_pad(20, 8) == (3, 4) and tail_pad(9, 8) == (2, 7) and tail_pad(1, 8) == (1, 7)
    assert tail_pad(20, 8, 2) == (3, 0)
    assert fits_5d((10, 256, 256)) and not fits_5d((5, 100, 100)) and not fits_5d((10, 256, 256), force=True)
    assert len(slice_grid((7, 10, 9), (4, 4, 4))) == 2 * 3 * 3


def test_lanes_are_those_of_the_single_coder():
    rng = np.random.default_rng(12)
    cdfs = [entropy.quantized_cdf(rng.random(n) ** 3 + 1e-4) for n in (3, 9, 40)]
    t = entropy.Tables(cdfs, [-1, 0, -20])
    lanes = []
    for n in (0, 1, 7, 300, 300, 1024):
        rows = rng.integers(0, 3, n)
        symbols = rng.integers(-25, 25, n) * np.where(rng.random(n) < 0.02, 10**9, 1)
        lanes.append((symbols, rows))
    data = entropy.encode_lanes(lanes, t)
    for (symbols, rows), d in zip(lanes, data, strict=True):
        assert d == entropy.encode(symbols.tolist(), rows.tolist(), cdfs, [-1, 0, -20])
        assert entropy.decode(d, rows.tolist(), cdfs, [-1, 0, -20]) == symbols.tolist()
    back = entropy.decode_lanes(data, [r for _, r in lanes], t)
    assert all((b == s).all() and len(b) == len(s) for b, (s, _) in zip(back, lanes, strict=True))
