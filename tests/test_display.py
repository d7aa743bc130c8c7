"""Viewports, navigation, traces and synthesis."""

import numpy as np
import pytest

from lanternfish.operators import display as V
from lanternfish.operators import synthesis as Y
from lanternfish.streaming import navigation as N


def test_views_clamp_zoom_and_prefetch():
    v = V.View.of(95, 10, 100)
    assert (v.start, v.seconds) == (90, 10) and V.View.of(0, 0.1, 100).seconds == 0.5 and V.View.of(0, 10, 0).seconds == 0.5
    z = V.View.of(20, 10, 100).zoomed(0.5, 24)
    assert z.seconds == 5 and (24 - z.start) / 5 == pytest.approx(0.4)
    p = V.View.of(40, 10, 100).prefetched(0.1)
    assert (p.start, p.end) == (10, 80) and p.holds(40, 10) and not p.holds(5, 10)
    assert V.View.of(0, 10, 100).showing(50, 51).start == 47 and V.View.of(0, 10, 100).showing(2, 3).start == 0


def test_navigation_fold():
    s = N.State.new(100.0)
    s = N.reduced(s, "tick", 50.0)
    assert s.view.start == 47
    s = N.reduced(s, "seek", 90.0)
    assert not s.follows and s.view.start == 87
    s = N.reduced(s, "pan", -1000.0)
    assert s.view.start == 0 and s.at == 90
    s = N.reduced(N.reduced(s, "select", "x", 30.0, 40.0), "follow", True)
    assert s.selected == "x" and s.view.start == 27
    assert N.reduced(s, "end").playback == "ended" and N.reduced(s, "end", True).at == 0
    assert N.reduced(s, "lengthen", 20.0).at == 20
    assert set(N.ACTIONS) == {"play", "pause", "stop", "tick", "end", "follow", "seek", "pan", "page", "set_view", "resize", "zoom", "select", "hover", "lengthen"}


def test_pixels_keep_extremes(spark):
    x = np.random.default_rng(4).normal(size=1000)
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "track long, i long, v double")
    rows = V.pixel_traces(df, 100.0, V.View.of(1, 7, 10), 60).collect()
    for r in rows:
        a, b = int((1 + r.pixel / 60 * 7) * 100 // 1), int((1 + (r.pixel + 1) / 60 * 7) * 100 // 1)
        assert (r.low, r.high, r.n) == (x[a:b].min(), x[a:b].max(), b - a) and r.low_at == a + x[a:b].argmin() and r.first == x[a]
    assert len(rows) == 60
    near = {r.pixel: r.v for r in V.at_pixel_centres(df, 100.0, V.View.of(2, 0.5, 10), 100).collect()}
    assert near[10] == pytest.approx(np.interp((2 + 10.5 / 100 * 0.5) * 100, np.arange(1000), x))
    assert V.native(df, 100.0, V.View.of(1, 1, 10)).count() == 103


def test_synthesis():
    x = np.sin(2 * np.pi * 10 * np.arange(2000) / 200)
    s = Y.Sound(mode="direct", rate=8000)
    y = Y.voiced(x, 200.0, "eeg", s)
    assert len(y) == 1600 and np.abs(np.fft.rfft(y)).argmax() / (len(y) / 8000) == pytest.approx(500, abs=10)
    for mode in ("choir", "contour", "pulse", "scale"):
        y = Y.voiced(x, 200.0, "eeg", Y.Sound(mode=mode, rate=4000))
        assert np.isfinite(y).all() and 0 < np.abs(y).max() <= 2 and np.array_equal(y, Y.voiced(x, 200.0, "eeg", Y.Sound(mode=mode, rate=4000)))
    for kind in ("ekg", "eog"):
        assert np.isfinite(Y.voiced(x, 200.0, kind, Y.Sound(rate=4000))).all()
    left, right = Y.mixed([(np.ones(10) * 2, 1.0, -1.0), (np.ones(5), 1.0, 1.0)])
    assert np.abs(left).max() == pytest.approx(0.89) and right[5:].max() < 1e-6
    assert Y.quantized(np.array([60.0, 59.0]), (0, 2, 4, 7, 9), 48).tolist() == [60, 48]
    assert Y.described(50) == "10 Hz alpha → 500 Hz; 3 Hz delta → 150 Hz"
    assert Y.scale_hz(np.array([3.0]), Y.Sound())[0] < Y.scale_hz(np.array([10.0]), Y.Sound())[0]
