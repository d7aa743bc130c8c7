"""Cleaning by blocks against the matrix of a whole recording, and the report on references."""

import numpy as np
import pytest

from lanternfish.operators import spatial, unmixing
from lanternfish.operators.dsp import Filters

FS = 100.0
KINDS = {"Fp1": "eeg", "C3": "eeg", "C4": "eeg", "O1": "eeg", "EOG": "eog", "EMG": "emg", "EKG": "ekg"}


def scene(names, n=1500, seed=4):
    """Four brain channels with a common rhythm, an eye and a muscle that leak into them; big offsets; the last target is shorter."""
    rng = np.random.default_rng(seed)
    t = np.arange(n) / FS
    eye = np.cumsum(rng.normal(size=n)) * 3
    muscle = rng.laplace(size=n) * 6
    base = {"EOG": eye + 500, "EMG": muscle - 80, "EKG": np.sin(t * 9)}
    out = {}
    for k, x in enumerate(names):
        own = base[x] if x in base else 300 * k + rng.laplace(size=n) * 4 + 9 * np.sin(t * (30 + 11 * k)) + eye * 0.3 / (k + 1) + muscle * 0.1 * k
        out[x] = own[: n - 130] if x == "O1" else own
    return out


def plain(tracks, regression, ica, project):
    """All channels of one recording as one matrix."""
    eye = [x for x in tracks if KINDS[x] == "eog"] or [x for x in tracks if x.startswith("Fp")]
    refs = eye + [x for x in tracks if KINDS[x] == "emg"]
    targets = [x for x in tracks if KINDS[x] == "eeg" and x not in refs]
    n = min(len(tracks[x]) for x in targets + refs)
    high = Filters(remove_dc=False, lff=20, hff=0, notch60=False)
    x = np.array([tracks[k][:n] for k in targets])
    q = np.array([high.apply(tracks[k], FS)[:n] if KINDS[k] == "emg" else tracks[k][:n] for k in refs]).reshape(-1, n)
    if regression and len(q):
        x = spatial.regressed(x, q)
    if ica:
        x = spatial.without_components(x, q, [False] * len(x))
    if project:
        x = spatial.projected(x, q) if len(q) else spatial.common_average(x)
    return {k: np.concatenate([own, tracks[k][n:]]) for k, own in zip(targets, x, strict=True)} | {k: v for k, v in tracks.items() if k not in targets}


@pytest.mark.parametrize("names", [tuple(KINDS), ("Fp1", "C3", "C4", "O1", "EKG"), ("C3", "C4", "O1")])
@pytest.mark.parametrize("steps", [(True, False, False), (False, True, False), (False, False, True), (True, True, True)])
def test_blocks_give_what_the_whole_gives(spark, names, steps):
    scenes = {"a": scene(names), "b": scene(names, 700, 9)}
    rows = [(f"{r}{x}", i, float(v)) for r, own in scenes.items() for x, values in own.items() for i, v in enumerate(values)]
    channels = [(r, f"{r}{x}", k, x, KINDS[x]) for r, own in scenes.items() for k, x in enumerate(own)]
    samples = spark.createDataFrame(rows, "track string, i long, v double").repartition(5)
    out = unmixing.cleaned(samples, spark.createDataFrame(channels, "recording string, track string, ord int, label string, kind string"), FS, *steps, size=256)
    got = out.toPandas().sort_values(["track", "i"])
    for r, own in scenes.items():
        for x, want in plain(own, *steps).items():
            mine = got[got.track == f"{r}{x}"]
            assert mine.i.tolist() == list(range(len(want)))
            np.testing.assert_allclose(mine.v.to_numpy(), want, atol=2e-3, rtol=1e-5)


def test_short_and_lonely_channels_stay(spark):
    rows = [("e", i, float(i)) for i in range(50)] + [("s", i, 1.0) for i in range(8)] + [("x", i, 2.0) for i in range(60)]
    samples = spark.createDataFrame(rows, "track string, i long, v double")
    channels = spark.createDataFrame([("a", "e", 0, "EOG", "eog"), ("a", "s", 1, "C3", "eeg"), ("b", "x", 0, "C3", "eeg")], "recording string, track string, ord int, label string, kind string")
    got = {(r.track, r.i, r.v) for r in unmixing.cleaned(samples, channels, FS, True, True, True).collect()}
    assert got == set(rows)
    assert unmixing.cleaned(samples.limit(0), channels, FS).count() == 0


def test_report_on_references(spark):
    rows = [("a", 0, "EOG-L", "eog"), ("a", 1, "EMG", "emg"), ("a", 2, "Fp1", "eeg"), ("b", 1, "EEG Fp2-REF", "eeg"), ("b", 0, "fpz", "eeg"), ("b", 2, "AFp1", "eeg"), ("c", 0, "EMG", "emg"), ("c", 1, "Fp1", "eeg"), ("d", 0, "EMG", "emg"), ("e", 0, "C3", "eeg"), ("e", 1, None, None), ("f", 0, "E1", "eog")]
    got = {r.recording: r for r in unmixing.noise_references(spark.createDataFrame([(r, f"{r}{k}", k, x, y) for r, k, x, y in rows], "recording string, track string, ord int, label string, kind string")).collect()}
    assert got["a"].used == ["EOG-L", "EMG"] and got["a"].summary == "Using EOG-L and EMG as noise references."
    assert got["b"].ocular_proxies == ["fpz", "EEG Fp2-REF"] and got["b"].summary == "No EOG/EMG channels. Using fpz, EEG Fp2-REF as ocular proxies."
    assert got["c"].summary == "Using EMG as muscle references and Fp1 as ocular proxies."
    assert got["d"].summary == "Using EMG as muscle references. No EOG channel in this montage."
    assert got["e"].used == [] and got["e"].summary == "No EOG, EMG, or frontal ocular-proxy channels in this window."
    assert got["f"].summary == "Using E1 as ocular references. No EMG channel in this montage."
