"""Chunked recurrences, running totals, read-outs and re-gridding against plain loops over whole tracks."""

import math
import random

import numpy as np
import pytest

from lanternfish.operators import chunks, dsp, running, spectral

FS = 200.0


@pytest.fixture(scope="module")
def tracks():
    rng = np.random.default_rng(6)
    return {"a": (40 * np.sin(np.arange(3000) * 0.2) + rng.normal(0, 9, 3000) + 25).tolist(), "b": rng.normal(3, 20, 1537).tolist(), "c": [1.0, -2.0, 3.0]}


@pytest.fixture(scope="module")
def samples(spark, tracks):
    return spark.createDataFrame([(t, i, x) for t, v in tracks.items() for i, x in enumerate(v)], "track string, i long, v double").repartition(3).cache()


@pytest.mark.parametrize("filters", [dsp.Filters(), dsp.Filters(hff=0, notch60=False), dsp.Filters(lff=0, hff=0, notch60=False), dsp.Filters(remove_dc=False, lff=0.05, hff=30.0)])
@pytest.mark.parametrize("size", [100, 517, 1 << 16])
def test_filters_cross_chunks(tracks, samples, filters, size):
    """The sample loop's output, whatever the chunks' size; a low cut whose memory spans many chunks too."""
    got = {}
    for r in chunks.out_of_chunks(chunks.filtered(chunks.in_chunks(samples, size), filters, FS), size).collect():
        got[r.track, r.i] = r.v
    for t, v in tracks.items():
        want = filters.apply(np.array(v), FS)
        own = np.array([got[t, i] for i in range(len(v))])
        assert np.abs(own - want).max() < 2e-4 * max(1.0, np.abs(want).max()) and len(own) == len(want)
    assert len(got) == sum(map(len, tracks.values()))


def test_a_section_is_the_sample_loop():
    x, k = np.random.default_rng(1).normal(0, 5, 700), dsp.highpass(FS, 1.0)
    b0, b1, b2, a1, a2 = k
    s1, s2, want = 0.4, -0.3, []
    for v in x:
        y = b0 * v + s1
        s1, s2 = s2 + b1 * v - a1 * y, b2 * v - a2 * y
        want.append(y)
    y, state = chunks.run(x, k, np.array([0.4, -0.3]))
    assert np.allclose(y, want, atol=1e-9) and np.allclose(state, [s1, s2], atol=1e-9)


@pytest.mark.parametrize("size", [1, 64, 1000, 1 << 16])
@pytest.mark.parametrize("hz", [0.0, 6.4, 50.0, 100.0])
def test_single_bin(tracks, samples, size, hz):
    got = {r.track: r.magnitude for r in chunks.single_bin(chunks.in_chunks(samples.where("track <> 'c'"), size), FS, hz, size).collect()}
    for t in ("a", "b"):
        x = np.array(tracks[t])
        k = int(len(x) * hz / FS + 0.5)
        want = abs((x * np.exp(-2j * np.pi * k / len(x) * np.arange(len(x)))).sum())
        assert got[t] == pytest.approx(want, rel=1e-6, abs=1e-5)


def window(v, t, seconds):
    return max(0, math.floor((t - seconds / 2) * FS)), min(len(v), math.floor((t + seconds / 2) * FS))


@pytest.mark.parametrize("size", [7, 64, 1024])
def test_centred_windows(spark, tracks, samples, size):
    rng = random.Random(8)
    at = sorted({round(rng.uniform(-0.5, 16), 3) for _ in range(60)} | {0.0, 7.5, 15.0, 100.0})
    cursors = spark.createDataFrame([(t, x) for t in tracks for x in at], "track string, t double")
    total = running.totals(samples, size)
    got = {(r.track, r.t): (r.hz, r.rms) for r in running.centred(total, cursors, FS).collect()}
    assert len(got) == 3 * len(at)
    sums = dict.fromkeys(at, (0.0, 0.0))
    for t, v in tracks.items():
        for x in at:
            a, b = window(v, x, 1.0)
            hz = 0.0 if b - a < 8 else sum(v[i - 1] <= 0 < v[i] for i in range(a + 1, b)) / ((b - a) / FS)
            a, b = window(v, x, 0.25)
            rms = 0.0 if b <= a else math.sqrt(sum(y * y for y in v[a:b]) / (b - a))
            assert got[t, x] == (pytest.approx(hz), pytest.approx(rms, abs=1e-6))
            sums[x] = sums[x][0] + hz / 3, sums[x][1] + rms / 3
    frames = spark.createDataFrame([(s, t, 0.1 * t, 0.2, 0.3, 0.1, 0.0) for s in ("left", "right") for t in range(4)], "side string, t long, delta double, theta double, alpha double, beta double, gamma double")
    read = running.readout(total, cursors, FS, frames).collect()
    assert len(read) == len(at)
    for r in read:
        assert (r.hz, r.uv) == (pytest.approx(sums[r.t][0]), pytest.approx(sums[r.t][1], abs=1e-6))
        frame = min(3, max(0, math.floor((max(0.0, r.t) - 1.0) / 0.5)))
        assert r.left.delta == r.right.delta == pytest.approx(0.1 * frame)
        assert r.band == ("delta" if r.hz < 4 else "theta" if r.hz < 8 else "alpha" if r.hz < 13 else "beta" if r.hz < 30 else "gamma")


def test_regridded(spark):
    frames = spark.createDataFrame([("left", t, [float(10 * t + f) for f in range(5)]) for t in range(3)] + [("right", 0, [1.0])], "side string, t long, power array<double>")
    got = {(r.side, r.t): r.power for r in spectral.regridded(frames, 5, 8).collect()}
    for t in range(5):
        assert got["left", t] == [10 * min(2, t) + min(4, math.floor(f / 7 * 4 + 0.5)) for f in range(8)] and got["right", t] == [1.0] * 8
    same = {(r.side, r.t): r.power for r in spectral.regridded(frames.where("side = 'left'"), 3, 5).collect()}
    assert same == {(r.side, r.t): r.power for r in frames.where("side = 'left'").collect()}
    assert {tuple(r.power) for r in spectral.regridded(frames, 1, 1).collect()} == {(0.0,), (1.0,)}
