"""EDF reading and writing, annotations, clocks and sound files."""

import json
import struct

import numpy as np
import pytest

from lanternfish.functions import scalars as S
from lanternfish.sources import annotations as N
from lanternfish.sources import edf


@pytest.fixture(scope="module")
def file(tmp_path_factory):
    x = np.arange(200) / 200
    raw = edf.build([(n, 100 * np.sin(2 * np.pi * (k + 3) * x)) for k, n in enumerate(("EEG Fp1", "EEG Fp2", "EEG T3"))], notes=[b"", b"+0.15\x150.5\x14Event\x14\0"])
    path = tmp_path_factory.mktemp("edf") / "a.edf"
    path.write_bytes(raw)
    return path, raw


def test_round_trip(spark, file):
    path, _ = file
    edf.register(spark)
    records = spark.read.format("edf").load(str(path))
    signals = edf.signals(spark, str(path))
    got = {(r.track, r.i): r.v for r in edf.samples(records, signals).collect()}
    assert len(got) == 600 and max(abs(got[1, i] - 100 * np.sin(2 * np.pi * 4 * i / 200)) for i in range(200)) < 0.06
    assert {(r.onset, r.duration, r.text) for r in edf.annotations(spark, str(path)).collect()} == {(0.15, 0.5, "Event")}
    head = edf.recordings(spark, str(path)).first()
    assert (head.record_count, head.is_edf_plus, head.identifier_warning) == (10, True, False)


def test_filters_reach_the_reader(spark, file):
    edf.register(spark)
    r = spark.read.format("edf").option("records", "2").load(str(file[0])).where("record_index >= 3 and record_index < 7 and signal_index = 1")
    assert sorted(x.record_index for x in r.collect()) == [3, 4, 5, 6]
    assert edf.records_between(spark.read.format("edf").load(str(file[0])), 0.1, 0.25, 0.2).select("record_index").distinct().count() == 2


@pytest.mark.parametrize("broken", [lambda b: b[:-1], lambda b: b[:20], lambda b: b[:192] + b"EDF+D" + b[197:], lambda b: b"1" + b[1:], lambda b: b[:236] + b"7       " + b[244:]])
def test_malformed_headers_are_refused(file, broken):
    raw = broken(file[1])
    with pytest.raises(edf.EdfError):
        edf.parse_header(raw, len(raw))


def test_open_record_count(file):
    raw = file[1][:236] + b"-1      " + file[1][244:]
    assert edf.parse_header(raw, len(raw)).record_count == 10


def test_tals():
    assert edf.parse_tals(b"+1.5\x152\x14a\x14b\x14\0+2\x14\x14\0\0") == [(1.5, 2.0, "a"), (1.5, 2.0, "b")]
    for bad in (b"1\x14a\x14\0", b"+1\x15-2\x14a\x14\0", b"+1\x14\xff\x14\0"):
        with pytest.raises(edf.EdfError):
            edf.parse_tals(bad)


def test_wav():
    raw = edf.wav(np.array([0, 1, 2.0]), np.array([0, -1, -0.5]), 44100)
    assert raw[:4] == b"RIFF" and struct.unpack("<6h", raw[44:]) == (0, 0, 32767, -32767, 32767, -16383)
    assert len(edf.wav(np.zeros(3), np.zeros(3), 8000, 24)) == 44 + 18


def test_annotations_import_all_or_nothing(spark, tmp_path):
    good = [{"id": "one", "start": 2, "end": 3, "type": "spike", "text": "brief", "track": "Fp1-F7", "source": "user", "confidence": 1}]
    path = tmp_path / "a.json"
    path.write_text(json.dumps(good))
    rows = N.read(spark, str(path), 10.0).collect()
    assert rows[0].tracks == ["Fp1-F7"] and rows[0].source == "file"
    for change in ({"end": 12}, {"type": "odd"}, {"text": "x" * 2001}, {"start": -1}, {"confidence": 2}):
        path.write_text(json.dumps([good[0], good[0] | {"id": "two"} | change]))
        with pytest.raises(ValueError, match="annotation 2"):
            N.read(spark, str(path), 10.0)
    path.write_text(json.dumps([good[0], good[0]]))
    with pytest.raises(ValueError, match="duplicate"):
        N.read(spark, str(path), 10.0)
    told = json.loads(N.exported(N.read(spark, str(_one(tmp_path, good)), 10.0)).first().value)
    assert told["track"] == "Fp1-F7" and "tracks" not in told


def _one(tmp_path, good):
    path = tmp_path / "b.json"
    path.write_text(json.dumps(good))
    return path


def test_history(spark):
    a, b = spark.range(1), spark.range(2)
    h = N.History(a)
    assert h.push(b) is b and h.undo() is a and h.redo() is b and h.redo() is b


def test_scalar_rules(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(
        S.snap_time(F.lit(11.865)).alias("snap"), S.snap_time(F.lit(float("nan"))).alias("nan"), S.fnv1a(F.lit("a")).alias("fnv"), S.fnv1a(F.lit("")).alias("empty"),
        S.format_clock(S.clock_at(S.parse_clock(F.lit("01.02.85"), F.lit("10.20.30")), F.lit(1.5))).alias("clock"), S.parse_clock(F.lit("31.02.20"), F.lit("10.20.30")).alias("bad"),
        S.velocity(F.lit(0)).alias("velocity"), S.scale_offset(F.lit(3.0)).alias("tie"), S.js_round(F.lit(-2.5)).alias("half"),
    ).first()
    assert (row.snap, row.nan, row.fnv, row.empty) == (11.87, 0.0, "e40c292c", "811c9dc5")
    assert (row.clock, row.bad, row.velocity, row.tie, row.half) == ("1985-02-01 10:20:31.500", None, 85 + 2654435761 % 43, 2, -2)


def test_rate_summary_breaks_ties_of_one_index(spark):
    """Of signals with one index the least rate counts, in whatever order rows come."""
    from lanternfish.sources.edf import rate_summary

    rows = [(r, i, u, False, fs) for r in ("a", "b") for i, u, fs in ((1, "uV", 256.0), (1, "uV", 128.0), (0, "mV", 64.0), (0, "mV", 32.0))] + [("c", 2, "mV", False, 9.0), ("c", 2, "mV", False, 8.0), ("c", 0, "uV", True, 1.0)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "recording string, signal_index int, unit string, is_annotation boolean, fs double").repartition(3)
        assert {r.recording: (r.primary, r.mixed, r.rates[0]) for r in rate_summary(df).collect()} == {"a": (128.0, True, 32.0), "b": (128.0, True, 32.0), "c": (8.0, True, 8.0)}
