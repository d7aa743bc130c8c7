"""Live voices: batch and stream against a loop over single sounds."""

import math
import random
from datetime import datetime, timedelta, timezone

import pytest

from lanternfish.operators import voices
from lanternfish.operators.voices import CONTROLS, Voice
from lanternfish.streaming import voices as live

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
BLOCKS = "track string, n long, at long, first long, samples array<double>"
CHANGES = "track string, at long, scale double, gain double, pan double, mute boolean, playing boolean"


def scene(seed=4, fs=200.0, tracks=3, blocks=9):
    """Blocks of many lengths, a gap, an empty one, one with a null; controls in between, two at one moment, one with nothing."""
    rng, rows, changes = random.Random(seed), [], []
    for t in range(tracks):
        first = 0
        for n in range(blocks):
            size = rng.choice([1, 40, 77, 130])
            v = [rng.uniform(-1.4, 1.4) for _ in range(size)]
            if (t, n) == (0, 4):
                first += 33
            if (t, n) == (1, 3):
                v = []
            if (t, n) == (1, 5):
                v[size // 2] = None
            if (t, n) == (2, 6):
                v[0] = math.nan
            rows.append((f"t{t}", n, round(first / fs * 1e6), first, v))
            first += len(v)
        at = [r[2] for r in rows if r[0] == f"t{t}"]
        changes += [(f"t{t}", at[2], None, 0.5, -0.7, None, None), (f"t{t}", at[3] - 1, 0.6, None, None, True, None), (f"t{t}", at[5], None, None, 0.4, False, None)]
        changes += [(f"t{t}", at[6], None, None, None, None, False), (f"t{t}", at[7], None, None, None, None, True), (f"t{t}", at[7], None, 2.0, None, None, None), (f"t{t}", at[8], None, None, None, None, None)]
    return rows, changes


def looped(rows, changes, s: Voice):
    """One sound after the other, as a player makes them."""
    out = {}
    glide, swell, floor, rise = voices.KINDS[s.kind]
    for track in sorted({r[0] for r in rows}):
        hz, loud, phase, opened = s.at_rest()
        held, end, last = dict(CONTROLS), None, None
        events = [(at, 0, -1, tuple((x is not None, x or 0) for x in f), f) for t, at, *f in changes if t == track] + [(at, 1, n, (), (first, v)) for t, n, at, first, v in rows if t == track]
        for _, block, n, _, what in sorted(events, key=lambda e: e[:4]):
            if not block:
                held |= {k: x for k, x in zip(CONTROLS, what, strict=True) if x is not None}
                continue
            first, v = what
            follows = end == first and last is not None and math.isfinite(last)
            start, stop = voices.places(first, len(v), follows, s)
            known = {first + k: x for k, x in enumerate(v)} | ({first - 1: last} if follows else {})
            quiet = not held["playing"] or not v or any(x is None or not math.isfinite(x) for x in known.values())
            left, right = [], []
            for j in range(start, stop):
                if quiet:
                    left.append(0.0), right.append(0.0)
                    continue
                p = j * s.step
                k = min(math.floor(p), first + len(v) - 1)
                x = known[k] if p - k < 1e-12 or k + 1 not in known else known[k] * (1 - (p - k)) + known[k + 1] * (p - k)
                x = max(-1.0, min(1.0, x * held["scale"]))
                up = x if s.negative_up else -x
                midi = s.root + (up * s.semitones if s.kind == "contour" else 0 if held["pan"] < -0.25 else 7 if held["pan"] > 0.25 else 3)
                hz += glide * (440 * 2 ** ((midi - 69) / 12) - hz)
                loud += swell * (floor + (1 - floor) * min(1, abs(x) * rise) - loud)
                phase += 2 * math.pi * hz / s.rate
                want = 0.0 if held["mute"] else 1.0
                opened += (1 - (1 - voices.OPENS) ** (1 / 128)) * (want - opened)
                wave = math.sin(phase) + (0.12 * math.sin(2 * phase) if s.kind == "pulse" else 0.18 * max(0, up) * math.sin(2 * phase) + 0.3 * max(0, -up) * math.sin(phase / 2))
                y = wave * loud * opened * held["gain"] * 0.7 * 0.7071
                left.append(y * (1 - held["pan"])), right.append(y * (1 + held["pan"]))
            out[track, n] = (start, hz, loud, left, right)
            end, last = first + len(v), v[-1] if v else None
    return out


def agree(got, want, tight=1e-8):
    got = {(r.track, r.n): (r.start, r.hz, r.loudness, r.left, r.right) for r in got}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k][0] == w[0] and len(got[k][3]) == len(w[3])
        for a, b in zip(got[k][1:3] + (*got[k][3], *got[k][4]), w[1:3] + (*w[3], *w[4]), strict=True):
            assert a == pytest.approx(b, abs=tight, rel=tight), k


@pytest.mark.parametrize("s", [Voice(200.0, 700.0), Voice(200.0, 700.0, kind="pulse"), Voice(200.0, 300.0, 3.1, negative_up=False)])
def test_blocks_are_the_loop(spark, s):
    rows, changes = scene()
    want = looped(rows, changes, s)
    got = voices.voiced(spark.createDataFrame(rows, BLOCKS).repartition(3), spark.createDataFrame(changes, CHANGES), s).collect()
    agree(got, want)
    assert any(max(map(abs, w[3]), default=0) > 0.05 for w in want.values())


def test_no_rows_no_controls(spark):
    s = Voice(200.0, 400.0, scale="pentatonic")
    none, blocks = spark.createDataFrame([], CHANGES), spark.createDataFrame([("a", 0, 0, 0, [0.1, 0.2]), ("b", 0, 0, 0, None)], BLOCKS)
    assert voices.voiced(spark.createDataFrame([], BLOCKS), none, s).count() == 0
    got = {r.track: r for r in voices.voiced(blocks, none, s).collect()}
    assert len(got["a"].left) == 2 and got["b"].left == [] and got["a"].left == got["a"].right


def test_blocks_join_as_one(spark):
    """Cut anywhere, a track sounds the same."""
    rng, s = random.Random(1), Voice(200.0, 900.0)
    v = [rng.uniform(-1, 1) for _ in range(400)]
    cuts = [0, 1, 90, 91, 333, 400]
    parts = [("cut", k, a, a, v[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))] + [("whole", 0, 0, 0, v)]
    got = voices.voiced(spark.createDataFrame(parts, BLOCKS), spark.createDataFrame([], CHANGES), s).orderBy("track", "n").collect()
    joined = [x for r in got if r.track == "cut" for x in r.left]
    assert joined == pytest.approx(got[-1].left, abs=1e-9) and len(joined) == math.floor(399 / s.step) + 1


def test_stream_equals_batch_and_drops_what_has_sounded(spark, tmp_path):
    """Rows come shuffled within a file; controls in files of their own; the end is pushed by one late row of each."""
    s = Voice(200.0, 700.0)
    rows, changes = scene(7, blocks=9)
    moment = lambda us: T0 + timedelta(microseconds=us)
    rng = random.Random(3)
    shapes = {"blocks": "track string, n long, ts timestamp, first long, samples array<double>", "controls": CHANGES.replace("at long", "ts timestamp")}
    data = {"blocks": [(r[0], r[1], moment(r[2]), *r[3:]) for r in rows], "controls": [(c[0], moment(c[1]), *c[2:]) for c in changes]}
    when = {"blocks": 2, "controls": 1}
    for name, own in data.items():
        own.sort(key=lambda r: r[when[name]])
        for k in range(4):
            part = own[len(own) * k // 4 : len(own) * (k + 1) // 4]
            rng.shuffle(part)
            spark.createDataFrame(part, shapes[name]).coalesce(1).write.parquet(str(tmp_path / name / f"{k}"))
    end = moment(600_000_000)
    spark.createDataFrame([("end", 0, end, 0, [0.0])], shapes["blocks"]).coalesce(1).write.parquet(str(tmp_path / "blocks" / "4"))
    spark.createDataFrame([("end", end, *[None] * 5)], shapes["controls"]).coalesce(1).write.parquet(str(tmp_path / "controls" / "4"))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    read = lambda name: spark.readStream.schema(shapes[name]).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name / "*"))
    try:
        query = live.voiced(read("blocks"), read("controls"), s, "1 second").writeStream.format("memory").queryName("voiced").outputMode("append").option("checkpointLocation", str(tmp_path / "at")).start()
        try:
            query.processAllAvailable()
            left = query.lastProgress["stateOperators"][0]["numRowsTotal"]
        finally:
            query.stop()
    finally:
        spark.conf.set(key, before)
    got = spark.sql("select * from voiced").collect()
    agree(got, looped(rows, changes, s))
    # One voice a track, and the two rows that moved the watermark.
    assert left <= 10 < len(rows) + len(changes)
