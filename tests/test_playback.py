"""Spikes on the playback clock: batch and stream against the cursor that walks both lists."""

import math
import random
from datetime import datetime, timedelta, timezone

from lanternfish.operators import playback
from lanternfish.streaming import taps as live

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def walked(spikes, ticks):
    """One cursor a track, as a player keeps it."""
    out = set()
    for track in {t for t, _ in spikes}:
        own, at = sorted(s for t, s in spikes if t == track), 0
        for tick in sorted(set(ticks)):
            while at < len(own) and own[at] < tick - playback.REACH:
                at += 1
            if at < len(own) and 0 <= tick - own[at] < playback.TAP:
                out.add((track, tick, own[at], round(math.exp(-55 * (tick - own[at]) / 1e6), 9)))
    return out


def scene(seed=2, n=120):
    rng = random.Random(seed)
    spikes = [(f"t{rng.randrange(3)}", rng.randrange(0, 4_000_000)) for _ in range(n)] + [("t0", 100_000), ("t0", 100_000), ("t1", 0), ("t2", 3_999_999)]
    ticks = [k * 7_500 for k in range(540)] + [145_000, 144_999, 150_000, 150_001]
    return spikes, sorted(set(ticks))


def test_taps_follow_the_cursor(spark):
    spikes, ticks = scene()
    got = playback.taps(spark.createDataFrame(spikes, "track string, spike long"), spark.createDataFrame([(t,) for t in ticks], "eeg long")).collect()
    assert {(r.track, r.eeg, r.spike, round(r.level, 9)) for r in got} == walked(spikes, ticks) and len(got) == len(walked(spikes, ticks))
    none = spark.createDataFrame([], "track string, spike long")
    assert playback.taps(none, spark.createDataFrame([(5,)], "eeg long")).count() == 0


def test_clock_of_a_speed(spark):
    at = spark.createDataFrame([(0,), (10_000,), (10_001,)], "at long")
    assert [r.eeg for r in playback.played(at, 2.0, 1.5).orderBy("at").collect()] == [2_000_000, 2_015_000, 2_015_001]


def test_stream_equals_batch_and_drops_its_state(spark, tmp_path):
    """Both sides in ten files each; the state left at the end is less than what has gone through."""
    spikes, ticks = scene(3, 400)
    moment = lambda us: T0 + timedelta(microseconds=us)
    for name, rows, schema in (("spikes", sorted((s, t) for t, s in spikes), "spike timestamp, track string"), ("clock", [(t,) for t in ticks], "tick timestamp")):
        for k in range(10):
            part = [(moment(r[0]), *r[1:]) for r in rows if k * 400_000 <= r[0] < (k + 1) * 400_000 or k == 9 and r[0] >= 4_000_000]
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / name / f"{k:02}"))
        # A row far ahead moves the watermark past everything.
        spark.createDataFrame([(moment(60_000_000), *("end" for _ in range(len(rows[0]) - 1)))], schema).coalesce(1).write.parquet(str(tmp_path / name / "10"))
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name / "*"))
    out = live.taps(read("spikes", "spike timestamp, track string"), read("clock", "tick timestamp"), "1 second")
    query = out.writeStream.format("memory").queryName("taps").outputMode("append").option("checkpointLocation", str(tmp_path / "at")).start()
    try:
        query.processAllAvailable()
        left = [o["numRowsTotal"] for o in query.lastProgress["stateOperators"]]
        most = max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"])
    finally:
        query.stop()
    us = lambda t: round((t.replace(tzinfo=timezone.utc) - T0).total_seconds() * 1e6)
    rows = spark.sql("select track, cast(tick as string) as tick, unix_micros(tick) as a, unix_micros(spike) as b, level from taps").collect()
    base = round(T0.timestamp() * 1e6)
    assert {(r.track, r.a - base, r.b - base, round(r.level, 9)) for r in rows} == walked(spikes, ticks) and len(rows) == len(walked(spikes, ticks))
    assert sum(left) < 10 and most < len(spikes) + len(ticks)
