"""The chain from channels to pages against the same steps on whole arrays."""

import numpy as np
import pytest

from lanternfish.operators import segments
from lanternfish.operators.display import View
from lanternfish.operators.dsp import Filters

FS = 200.0


@pytest.fixture(scope="module")
def channels(spark):
    return spark.createDataFrame([(0, 200.0), (1, 200.0), (2, 200.0), (3, 100.0)], "idx long, fs double")


@pytest.fixture(scope="module")
def waves():
    rng = np.random.default_rng(3)
    return {k: (30 * np.sin(np.arange(2600 if k < 3 else 1300) * 0.1 * (k + 1)) + rng.normal(k, 5, 2600 if k < 3 else 1300)) for k in range(4)}


@pytest.fixture(scope="module")
def samples(spark, waves):
    return spark.createDataFrame([(k, i, float(x)) for k, v in waves.items() for i, x in enumerate(v)], "track long, i long, v double").cache()


@pytest.fixture(scope="module")
def montage(spark):
    return spark.createDataFrame([("0-1", 0, 1, True), ("2", 2, None, True), ("slow", 3, None, True), ("gone", 0, 7, False)], "id string, source_a long, source_b long, available boolean")


def wanted(waves):
    return {"0-1": ((waves[0] - waves[1]).astype(np.float32).astype(float), 200.0), "2": (waves[2], 200.0), "slow": (waves[3], 100.0)}


def arrays(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r.i):
        out.setdefault(r.track, []).append((r.i, r.v))
    return out


def test_segment(samples, montage, channels, waves):
    filters = Filters(hff=30.0)
    got = arrays(segments.segment(samples, montage, channels, filters, 700).collect())
    assert set(got) == {"0-1", "2", "slow"}
    for track, (x, fs) in wanted(waves).items():
        assert [i for i, _ in got[track]] == list(range(len(x)))
        assert np.abs(np.array([v for _, v in got[track]]) - filters.apply(x, fs)).max() < 5e-3


def test_rates_must_agree(spark, samples, channels):
    mixed = spark.createDataFrame([("0-3", 0, 3, True)], "id string, source_a long, source_b long, available boolean")
    with pytest.raises(Exception, match="derivation source rates differ: 0-3"):
        segments.raw(samples, mixed, channels).collect()


def test_a_view_and_its_margin(samples, montage, channels, waves):
    """The slice is filtered from rest and loses the whole recording's mean."""
    filters, view = Filters(lff=2.0, hff=0, notch60=False), View(6.0, 2.0, 13.0)
    raw = segments.raw(samples, montage, channels)
    got = arrays(segments.window(raw, view, filters, 300).collect())
    plan = view.prefetched(2.0)
    for track, (x, fs) in wanted(waves).items():
        a, b = int(plan.start * fs), min(len(x), int(plan.end * fs))
        want = filters.apply(x[a:b], fs, x.mean())
        assert [i for i, _ in got[track]] == list(range(a, b))
        assert np.abs(np.array([v for _, v in got[track]]) - want).max() < 5e-3
    flipped = segments.window(raw, view, filters, 300, cleaned=lambda rows: rows.withColumn("v", -rows.v))
    assert arrays(flipped.collect())["2"][5][1] == pytest.approx(-got["2"][5][1])


def test_pages(samples, waves):
    filters = Filters(lff=2.0, hff=40.0)
    got = {}
    for r in segments.pages(samples.where("track < 3"), FS, 3.0, filters).collect():
        assert (r.track, r.i) not in got
        got[r.track, r.i] = (r.page, r.v)
    for k in range(3):
        x = waves[k]
        for page in range(5):
            view = View(page * 3.0, 3.0, 13.0)
            a, b = max(0, int((view.start - 3.0) * FS)), min(2600, int((view.end + 3.0) * FS))
            want = filters.apply(x[a:b], FS, x.mean())
            for i in range(int(view.start * FS), min(2600, int(view.end * FS))):
                assert got[k, i][0] == page and abs(got[k, i][1] - want[i - a]) < 5e-3
    assert len(got) == 3 * 2600
