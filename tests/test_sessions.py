"""Sessions against a plain walk over windows, digests of a rerun, and annotations as one JSON array."""

import hashlib
import json
import math
from decimal import Decimal
from pathlib import Path

import pytest

from lanternfish.operators import sessions
from lanternfish.operators.dsp import Filters
from lanternfish.sources import annotations

FS, SIZE, SECONDS = 20.0, 8, 2.0
TRACKS = [(7, 1, "a", "B", "left", "eeg", ["B", "C"]), (3, 2, "a", "A", "right", "eeg", ["A"]), (5, 1, "b", "Z", "unknown", "ekg", ["Z"])]
SCHEMA = "track long, ord long, recording string, label string, laterality string, kind string, sources array<string>"


def value(t, i):
    return math.sin(i * (t + 1) / 9) * (1 + i // 40)


def rows(lengths):
    return [(t, i, value(t, i)) for t, n in lengths.items() for i in range(n)]


def plain(track, x, gain):
    """(region, window, start, end, hz, amplitude) of one track under the contour mapping."""
    span = int(FS * SECONDS)
    for r in range(0, len(x), span):
        own = x[r : r + span]
        scale = max(1e-12, *(abs(v) for v in own))
        for w in range(0, len(own), SIZE):
            part = own[w : w + SIZE]
            mean, rms = sum(part) / len(part), math.sqrt(sum(v * v for v in part) / len(part))
            yield r // span, w // SIZE, (r + w) / FS, (r + w + len(part)) / FS, 420 * 2 ** max(-1, min(1, mean / scale)), (0.07 + max(0, min(1, rms / scale)) * 0.23) * gain


def made(spark, lengths, controls=None, **kw):
    tracks = sessions.controlled(spark.createDataFrame(TRACKS, SCHEMA), controls)
    return sessions.documents(spark.createDataFrame(rows(lengths), "track long, i long, v double").repartition(5), tracks, FS, SIZE, SECONDS, **kw)


def test_sessions_follow_a_walk_over_windows(spark):
    lengths = {7: 100, 3: 41, 5: 1}
    controls = spark.createDataFrame([(7, 6.0, None, -2.0), (3, None, True, 0.5)], "track long, gain double, mute boolean, pan double")
    got = {(r.recording, r.region): (r.events, json.loads(r.document, parse_float=Decimal)) for r in made(spark, lengths, controls, montage="m").collect()}
    want = {}
    for t, ord_, recording, *_ in TRACKS:
        for region, window, *told in plain(t, [value(t, i) for i in range(lengths[t])], {7: 4.0, 3: 0.0, 5: 1.0}[t]):
            want.setdefault((recording, region), []).append((ord_, window, t, *told))
    assert got.keys() == want.keys()
    for key, (n, doc) in got.items():
        own = sorted(want[key])
        session = doc["session"]
        assert n == len(own) == len(session["events"]) == session["audit"]["eventCount"] and doc["montage"] == "m"
        for e, f, (_, window, t, a, b, hz, amplitude) in zip(session["events"], session["featureEvents"], own, strict=True):
            assert f["id"] == f"feature:{t}:{round(a * FS)}:{window}" and e["derivesFrom"] == [f["id"]] and f["source"]["trackId"] == t
            assert [float(x) for x in (e["time"]["start"], e["time"]["end"], e["frequencyHz"], e["amplitude"])] == pytest.approx([a, b, hz, amplitude], abs=1e-6)
            assert float(e["pan"]) == {7: -1.0, 3: 0.5, 5: 0.0}[t] and e["style"]["changes"] == ["no acoustic parameters changed"]
        assert 3 not in session["audit"]["audibleTrackIds"] and doc["reproduction"]["filters"] == ["none"]
    first = got["a", 0][1]
    assert [t["trackId"] for t in first["provenance"]["tracks"]] == [7, 3] and first["reproduction"]["interval"] == "0.00–2.00 s"
    # A track's digest is that of its windows' digests.
    texts = [",".join(str(round(value(7, i) * 1e6)) for i in range(w, min(w + SIZE, 40))) for w in range(0, 40, SIZE)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert first["provenance"]["tracks"][0]["sha256"] == sha("".join(map(sha, texts)))


def test_reruns_are_told_apart(spark):
    lengths = {7: 90, 3: 50, 5: 45}
    verdicts = lambda a, b: {(r.recording, r.region): r.verdict for r in sessions.compared(a, b).collect()}
    base = made(spark, lengths)
    assert set(verdicts(base, made(spark, lengths)).values()) == {"same"}
    shorter = verdicts(base, made(spark, lengths | {7: 79}))
    assert shorter == {("a", 0): "same", ("a", 1): "inputs", ("a", 2): "gone", ("b", 0): "same", ("b", 1): "same"}
    assert verdicts(made(spark, lengths | {7: 79}), base)["a", 2] == "new"
    assert set(verdicts(base, made(spark, lengths, mapping="rms-pulse-v1")).values()) == {"parameters"}
    loud = spark.createDataFrame([(5, 2.0, None, None)], "track long, gain double, mute boolean, pan double")
    assert verdicts(base, made(spark, lengths, loud)) == {("a", 0): "same", ("a", 1): "same", ("a", 2): "same", ("b", 0): "parameters", ("b", 1): "parameters"}
    assert verdicts(base, made(spark, lengths | {7: 79}, mapping="rms-pulse-v1"))["a", 1] == "both"


def test_sessions_of_nothing_and_of_bad_rows(spark):
    assert made(spark, {7: 1}).where("recording = 'b'").count() == 0
    empty = spark.createDataFrame([], "track long, i long, v double")
    tracks = sessions.controlled(spark.createDataFrame(TRACKS, SCHEMA))
    assert sessions.documents(empty, tracks, FS, SIZE, SECONDS).count() == 0
    for bad in (None, math.nan, math.inf):
        with pytest.raises(Exception, match="a sample isn't finite in track 7"):
            sessions.documents(spark.createDataFrame([(7, 0, bad)], "track long, i long, v double"), tracks, FS, SIZE, SECONDS).collect()
    wrong = spark.createDataFrame([(7, math.nan, None, None)], "track long, gain double, mute boolean, pan double")
    with pytest.raises(Exception, match="gain isn't finite for track 7"):
        made(spark, {7: 9}, wrong).collect()
    with pytest.raises(ValueError, match="unknown style"):
        made(spark, {7: 9}, style="loud")


def test_filters_in_words():
    assert sessions.filter_texts(Filters()) == ["DC offset removed", "LFF 1 Hz", "HFF 70 Hz", "60 Hz notch (zero-phase)"]
    assert sessions.filter_texts(Filters(remove_dc=False, lff=0, hff=0, bandpass=True, notch60=False)) == ["0.5–40 Hz bandpass (zero-phase)"]


def test_sessions_are_written_by_recording(spark, tmp_path):
    sessions.write(made(spark, {7: 90, 5: 45}), str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out")).collect()
    assert sorted((r.recording, json.loads(r.value)["recording"]) for r in back) == [("a", "a")] * 3 + [("b", "b")] * 2


EVENTS = [(k / 8, k / 8 + 1, "spike" if k % 3 else "note", f'say "{k}", {{x}}', [["Fz"], ["Fz", "Cz"], []][k % 3], "user", 0.5) for k in range(90)]
EVENTS += [EVENTS[5], EVENTS[5], EVENTS[0], (0.0, 1.0, "note", 'say "0"', None, "auto", None), (None, None, None, None, None, None, None)]
ANNOTATED = "start double, end double, type string, text string, tracks array<string>, source string, confidence double"


@pytest.mark.parametrize("rows_", [EVENTS, EVENTS[:1], []])
def test_annotations_as_one_array(spark, tmp_path, rows_):
    """The files one after another, in order of name, are one array of all events by start."""
    events = spark.createDataFrame(rows_, ANNOTATED).repartition(3)
    annotations.write_array(events, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted(Path(tmp_path / "out").glob("part-*")))
    got = json.loads(text)
    drop = lambda d: {k: v for k, v in d.items() if v is not None}
    want = [drop({"start": a, "end": b, "type": k, "text": t, "track": on[0] if on and len(on) == 1 else None, "source": s, "confidence": c, "tracks": on if on and len(on) > 1 else None}) for a, b, k, t, on, s, c in rows_]
    as_text = lambda d: json.dumps(d, sort_keys=True)
    assert sorted(map(as_text, got)) == sorted(map(as_text, want))
    starts = [d.get("start", -1.0) for d in got]
    assert starts == sorted(starts)
