"""Filters, spectra, spatial cleaning and detectors on constructed signals."""

import numpy as np

from lanternfish.operators import detectors as D
from lanternfish.operators import dsp, screening, spatial, spectral

FS = 200.0


def t(seconds, fs=FS):
    return np.arange(int(seconds * fs)) / fs


def track(x, label="Fp1-F7", kind="eeg", name="a", fs=FS, laterality="left"):
    return {"track": name, "label": label, "kind": kind, "fs": fs, "samples": np.asarray(x, float), "laterality": laterality}


def sine(hz, amp, seconds, fs=FS):
    return amp * np.sin(2 * np.pi * hz * t(seconds, fs))


def test_section_is_the_recursion():
    x = np.random.default_rng(1).normal(size=1000)
    for k in (dsp.lowpass(FS, 30), dsp.highpass(FS, 1), dsp.notch(FS, 60)):
        b0, b1, b2, a1, a2 = k
        s1 = s2 = 0.0
        want = []
        for v in x:
            y = b0 * v + s1
            s1, s2 = s2 + b1 * v - a1 * y, b2 * v - a2 * y
            want.append(y)
        assert np.allclose(dsp.section(x, k), want, atol=1e-6)


def test_filters_keep_and_remove():
    x = sine(10, 20, 10) + sine(60, 20, 10) + 100
    y = dsp.Filters().apply(x, FS)[400:-400]
    spectrum = spectral.power_spectrum(y, FS, 0)
    assert spectral.band_power(spectrum, 58, 62) < 0.01 * spectral.band_power(spectrum, 9, 11)
    assert abs(y.mean()) < 0.5
    for bad in (dsp.Filters(lff=200), dsp.Filters(lff=10, hff=5), dsp.Filters(bandpass=True, low=5, high=4)):
        try:
            bad.apply(x, FS)
        except ValueError:
            continue
        raise AssertionError("accepted")


def test_short_and_empty_tracks():
    assert len(dsp.Filters().apply(np.zeros(0), FS)) == 0
    assert len(dsp.Filters().apply(np.ones(5), FS)) == 5
    assert spectral.peak(np.ones(10), FS, 1, 10) is None
    assert D.spikes("a", np.zeros(3), FS) == []
    assert screening.measure(np.full(100, np.nan), FS) is None


def test_band_power_matches_direct_transform():
    x = np.random.default_rng(2).normal(size=300)
    d = x - x.mean()
    hz = np.arange(1, 151) * FS / 300
    power = [abs((d * np.exp(-2j * np.pi * k * np.arange(300) / 300)).sum()) ** 2 / 300**2 for k in range(1, 151)]
    assert np.isclose(spectral.band_powers(x, FS)["alpha"], sum(p for f, p in zip(hz, power) if 8 <= f < 13))


def test_decimation_empties_high_bands():
    assert spectral.band_powers(sine(20, 5, 30), FS)["beta"] == 0.0
    assert spectral.band_powers(sine(20, 5, 30), FS, 0)["beta"] > 5


def test_regression_leaves_the_brain():
    x, eye = sine(10, 20, 2), sine(2, 80, 2)
    out = spatial.regressed(np.array([x + 0.4 * eye]), eye[None])
    assert np.sqrt(np.mean((out[0] - x) ** 2)) < 1e-4


def test_ica_separates_and_repeats():
    rng = np.random.default_rng(3)
    blink = np.exp(-(((t(6) % 1) - 0.5) ** 2) / 0.005) * 100
    x = np.array([sine(10, 10, 6) + w * blink + rng.normal(size=1200) * 0.1 for w in (1.0, 0.6, 0.2)])
    x[1] += sine(6, 8, 6)
    x[2] += sine(17, 7, 6)
    a = spatial.without_components(x, blink[None], [False] * 3)
    assert np.array_equal(a, spatial.without_components(x, blink[None], [False] * 3))
    assert abs(spatial.correlated(a[0], blink)) < 0.3 < abs(spatial.correlated(x[0], blink))


def triangle(amp, half, n=1200, at=600):
    x = 0.25 * np.sin(2 * np.pi * 7 * np.arange(n) / FS) + 0.05 * np.sin(2 * np.pi * 11 * np.arange(n) / FS)
    for k in range(-half, half + 1):
        x[at + k] += amp * (1 - abs(k) / half)
    return x


def test_spike_is_found_and_vetoed_by_muscle():
    x = triangle(22, 5)
    found = D.morphologies([track(x)])
    assert len(found) == 1 and found[0]["type"] in ("spike", "sharp") and 0.4 <= found[0]["end"] - found[0]["start"] <= 10 and found[0]["start"] <= 3.0 <= found[0]["end"]
    hash_ = 12 * np.sin(2 * np.pi * 40 * t(6))
    assert D.muscle([track(hash_)])
    marks = [D.annotation("muscle", 2.5, 3.5, ["a"], 1, "")]
    assert D.vetoed(found, marks) == [] and D.vetoed(found, [marks[0] | {"tracks": ["b"]}]) == found


def test_heartbeats_only_on_heart_tracks():
    x = triangle(35, 6)
    assert D.heartbeats([track(x, "EKG", "ekg")]) and not D.heartbeats([track(x)])


def test_temporal_phenomena():
    assert {p["detector"] for p in D.phenomena([track(sine(10, 20, 8))])} >= {"rhythmic-activity"}
    on = (t(8) % 2) < 0.45
    assert [p["detector"] for p in D.phenomena([track(np.where(on, sine(12, 35, 8), 0))]) if p["detector"] == "burst-suppression"]
    assert not D.spindles(track(sine(13, 35, 4), "O1")) and D.spindles(track(np.where((t(4) > 1) & (t(4) < 3), sine(13, 35, 4) * np.sin(np.pi * (t(4) - 1) / 2), 0), "Cz"))


def test_periodic_fields_need_neighbours():
    x = np.zeros(2400)
    for k in range(10):
        a = 200 + k * 200
        x[a : a + 12] += 45 * np.exp(-35 * np.arange(12) / 200)
    both = [track(x, "Fp1", name="a"), track(x, "F3", name="b")]
    assert "periodic-activity" in {p["detector"] for p in D.phenomena(both)}
    apart = [track(x, "Fp1", name="a"), track(x, "O2", name="b")]
    assert "periodic-activity" not in {p["detector"] for p in D.phenomena(apart)}


def test_bunched_spikes_are_one_polyspike():
    at = lambda p, kind="spike": {"type": kind, "peak": p, "start": p - 0.02, "end": p + 0.02, "score": 0.5 + p / 100, "total": 20.0}
    made = D.polyspikes("a", [at(5.0), at(1.0), at(1.1), at(1.12, "sharp"), at(1.2), at(1.3), at(8.0)])
    assert [(round(e["start"], 2), e["tracks"], round(e["confidence"], 3)) for e in made] == [(0.85, ["a"], 0.511), (1.05, ["a"], 0.513)]
    assert made[0]["text"].startswith("2 spike-class peaks · 140 ms") and D.polyspikes("a", [at(1.0), at(2.0)]) == []


def test_blinks_are_frontal_and_outdo_posterior_tracks():
    pulse = np.interp(np.arange(1200), [550, 600, 650], [0, 60, 0])
    noise = np.random.default_rng(5).normal(size=1200)
    front, back = track(np.where(pulse > 0, pulse, noise), "F7"), track(noise, "O1", name="b")
    assert len(D.blinks([front, back])) == 1 and D.blinks([back]) == []
    assert D.blinks([front, back | {"samples": noise + 5 * pulse}]) == [] and len(D.blinks([front, back | {"samples": np.full(1200, np.nan)}])) == 1


def test_muscle_windows_with_gaps_use_what_they_have():
    x = 12 * np.sin(2 * np.pi * 40 * t(6))
    x[100:110] = np.nan
    assert D.muscle([track(x)])[0]["start"] == 0 and D.muscle([track(np.full(1200, np.nan))]) == [] and D.muscle([track(x[:5])]) == []


def test_neighbours():
    assert D.adjacent("Fp1", "F3-C3") and D.adjacent("T5", "P7") and not D.adjacent("Fp1", "O2") and not D.adjacent("C3", "F4")


def test_flat_channels_are_marked():
    made = screening.reviewed([track(np.zeros(2400))], 12.0)
    assert any("Flat or disconnected" in e["text"] or "flat disconnected" in e["text"] for e in made)


def test_slowing_and_repeatability():
    rows = [track(sine(2, 40, 8) + sine(20, 4, 8), "Fp1", name="a"), track(sine(10, 40, 8), "F4", name="b", laterality="right"), track(sine(10, 40, 8), "Cz", name="c", laterality="midline")]
    found, told = screening.screened(rows, [2.0])
    assert "focal-slowing" in {f["detector"] for f in found} and len(told) == len(screening.THRESHOLDS)
    assert screening.screened(rows, [2.0]) == (found, told)


def test_context_lengths():
    assert screening.context_lengths() == [2, 10, 30] and screening.context_lengths([0.1, 0.1, 999]) == [0.5, 60.0]


def test_phenomena_carry_their_own_artifact_probability(spark):
    """A 14 Hz rhythm and a 9 Hz one, on tracks that only differ in this, and fast activity."""
    import numpy as np

    from lanternfish.operators import screening

    t = np.arange(200 * 12) / 200.0
    rows = [(name, name, name, "left", "eeg", 200.0, (40 * np.sin(2 * np.pi * hz * t)).tolist(), k) for k, (name, hz) in enumerate((("T7", 9.0), ("T8", 14.0), ("O1", 30.0)))]
    df = spark.createDataFrame(rows, "recording string, track string, label string, laterality string, kind string, fs double, samples array<double>, ord int")
    for found in (screening.temporal(df).collect(), screening.findings(df).where("start is not null").collect()):
        seen = {(r.recording, r.detector): round(r.artifact, 2) for r in found}
        assert seen["T7", "rhythmic-activity"] == 0.15 and seen["T8", "rhythmic-activity"] == 0.35 and seen["O1", "fast-activity"] == 0.55


def test_findings_carry_ids_thresholds_and_polarity(spark):
    rows = [("r", name, name, side, "eeg", 200.0, (x + 5).tolist(), k) for k, (name, side, x) in enumerate((("F3", "left", sine(2, 40, 8) + sine(20, 4, 8)), ("F4", "right", sine(10, 40, 8)), ("Cz", "midline", np.zeros(1600))))]
    rows.append(("short", "Fp1", "Fp1", "left", "eeg", 200.0, [1.0, 2.0], 0))
    df = spark.createDataFrame(rows, "recording string, track string, label string, laterality string, kind string, fs double, samples array<double>, ord int")
    found, told = screening.findings(df).collect(), screening.evaluations(df).collect()
    assert {f.recording for f in found} == {"r"} and len({f.id for f in found}) == len(found)
    slow = next(f for f in found if f.detector == "focal-slowing")
    assert slow.tracks == ["F3"] and slow.id.startswith("ds-focal-slowing-") and slow.context == 30.0 and slow.polarity in ("positive", "mixed")
    assert [tuple(t) for t in slow.thresholds] == screening.THRESHOLDS["focal-slowing"]
    event = next(f for f in found if f.start is not None)
    assert event.context is None and event.id.endswith(f"-{round(event.start * 1000)}-{round(event.end * 1000)}")
    assert len(told) == 2 * len(screening.THRESHOLDS)
    for e in told:
        assert sorted(e.finding_ids) == sorted(f.id for f in found if (f.recording, f.detector) == (e.recording, e.detector)) and len(e.finding_ids) == e.findings
    assert {e.status for e in told if e.recording == "short" and e.detector not in ("hemispheric-asymmetry",)} == {"insufficient-data"}


def test_polarity_of_channels():
    assert [screening.polarity(s) for s in ([], ["positive"], ["positive", "mixed"], ["positive", "negative"], ["mixed"], ["negative", "unknown"])] == ["unknown", "positive", "positive", "mixed", "mixed", "unknown"]


def test_spectra_from_pieces_are_those_of_whole_tracks(spark, monkeypatch):
    """Tracks with gaps, of several rates and lengths, shorter than a window and longer than 1400 frames."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(spectral, "PIECE", 300)
    rng = np.random.default_rng(5)
    lengths, rates = {0: 1, 1: 257, 2: 5000, 3: 3001, 4: 100_000, 5: 5000, 6: 40}, {k: 50.0 if k == 4 else 200.0 if k != 3 else 400.0 for k in range(7)}
    tracks = {k: rng.standard_normal(n) for k, n in lengths.items()}
    tracks[5][77] = np.nan
    rows = [(k, 2 * i + i // 1000 * 5000, float(x)) for k, v in tracks.items() for i, x in enumerate(v)]
    samples = spark.createDataFrame(rows, "track long, i long, v double").where("i != 154 or track != 5").unionByName(spark.createDataFrame([(5, 154, None)], "track long, i long, v double"))
    named = spark.createDataFrame([(k, "left" if k < 5 else "right", f) for k, f in rates.items()] + [(9, "left", 200.0)], "track long, laterality string, fs double")
    counted = spectral.pieces(samples)
    plan = spectral.framed(named, counted)
    long = spectral.spectra(samples, counted, plan)
    got = long.groupBy("track", "t").agg(F.array_sort(F.collect_list(F.struct("f", "hz", "power"))).alias("p")).collect()
    made = {(r.track, r.t): r.p for r in got}
    seen = 0
    for k, x in tracks.items():
        fs = rates[k]
        win = {50.0: 256, 200.0: 512, 400.0: 1024}[fs]
        hop = win // 4 if (max(0, len(x) - win) // (win // 4)) + 1 <= 1400 else -(-(len(x) - win) // 1399)
        want = spectral.spectrogram(x, fs, win, hop, 45.0)
        assert len(want) <= 1400 and (k != 4 or hop > win // 4)
        for t, line in enumerate(want):
            assert np.array_equal([c.power for c in made[k, t]], line, equal_nan=True), (k, t)
            assert np.allclose([c.hz for c in made[k, t]], np.arange(len(line)) * fs / win)
        seen += len(want)
    assert len(made) == seen
    # One side alone is copied to the other; times that a track lacks go.
    ours = plan.where("track in (1, 2)")
    both = spectral.hemispheres(spectral.spectra(samples, counted, ours), ours).collect()
    cells = {(r.side, r.t, r.f): r.power for r in both}
    assert {t for _, t, _ in cells} == {0} and len(cells) == len(both) and all(cells["left", 0, f] == cells["right", 0, f] for f in range(100))
    a, b = (spectral.spectrogram(tracks[k], 200.0, 512, 128, 45.0)[0].astype(float) for k in (1, 2))
    assert np.isclose(cells["left", 0, 9], ((a[9] ** 1.35 + b[9] ** 1.35) / 2) ** (1 / 1.35))
