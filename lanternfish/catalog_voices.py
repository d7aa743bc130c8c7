"""Registered queries on live voices."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanternfish.catalog import ORACLE, query, r6
from lanternfish.operators import chunks, voices
from lanternfish.plans import views as V

#: Blocks are short, so that each track of the test tables has several; four sounds a sample of voltage at half its speed.
BLOCK, VOICE = 500, voices.Voice(V.FS, 800.0, 2.0)
#: (track, at in microseconds, scale, gain, pan, mute, playing): all tracks scaled, one muted for a block, one louder on the right, one paused.
CHANGES = (
    *((t, 0, 0.03, None, None, None, None) for t in range(10)),
    (2, 2_500_000, None, None, None, True, None),
    (2, 5_000_000, None, None, -0.6, False, None),
    (3, 2_499_999, None, 2.0, 0.7, None, None),
    (4, 2_500_000, None, None, None, None, False),
    (4, 7_500_000, None, None, None, None, True),
)


def _sql() -> str:
    a, b, c = (f"{x!r}::double" for x in VOICE.shares)
    hz, loud, phase, opened = (f"{x!r}::double" for x in VOICE.at_rest())
    floor, rise = voices.KINDS["contour"][2:]
    cell = lambda x: "null" if x is None else str(x).lower()
    changes = ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in CHANGES)
    held = lambda k, v: f"coalesce(last_value({k} ignore nulls) over w, {v}) as {k}"
    rms = lambda side, sign: f"round(sqrt(coalesce(sum(power(y * {voices.SIDE} * (1 {sign} pan), 2)), 0) / count(*)), 6) as \"{side}\""
    return f""", c(track, due, scale, gain, pan, mute, playing) as (values {changes}),
h as (select track, i // {BLOCK} as n, min(i) as first, count(*) as size from signal group by all),
u as (select track, first * 5000 as due, 1 as block, n, first, size, null::double as scale, null::double as gain, null::double as pan, null::boolean as mute, null::boolean as playing from h
  union all select track, due, 0, null, null, null, scale, gain, pan, mute, playing from c),
k as (select track, block, n, first, size, {held("scale", "1")}, {held("gain", "1")}, {held("pan", "0")}, {held("mute", "false")}, {held("playing", "true")} from u
  window w as (partition by track order by due, block, n rows between unbounded preceding and current row)),
g as (select *, case when first = 0 then 0 else cast(floor((first - 1) / 0.5::double) as bigint) + 1 end as start, cast(floor((first + size - 1) / 0.5::double) as bigint) + 1 as stop from k where block = 1),
v as (select track, list(v order by i) as v from signal group by track),
j as (select g.*, unnest(range(start, stop)) as j from g),
x as (select j.*, least(1, greatest(-1, scale * case when j % 2 = 0 or j // 2 + 2 > len(v) then v[j // 2 + 1] else v[j // 2 + 1] * 0.5 + v[j // 2 + 2] * 0.5 end)) as x from j join v using (track)),
p as (select *, row_number() over (partition by track order by j) as m from x where playing),
l as materialized (select track, count(*) as total, list(440 * pow(2, ({VOICE.root} + x * {VOICE.semitones} - 69) / 12) order by m) as pitch, list({floor} + {1 - floor!r}::double * least(1, abs(x) * {rise}) order by m) as size, list(case when mute then 0 else 1 end order by m) as want from p group by track),
r as (select track, 0::bigint as m, {hz} as hz, {loud} as loud, {phase} as phase, {opened} as opened from l
  union all
  select r.track, r.m + 1, r.hz + {a} * (pitch[r.m + 1] - r.hz), r.loud + {b} * (size[r.m + 1] - r.loud), r.phase + 2 * pi() / {VOICE.rate} * (r.hz + {a} * (pitch[r.m + 1] - r.hz)), r.opened + {c} * (want[r.m + 1] - r.opened)
  from r join l on l.track = r.track where r.m < total),
y as (select x.*, r.m, r.hz, r.loud, (sin(phase) + 0.18 * greatest(0, x.x) * sin(2 * phase) + 0.3 * greatest(0, -x.x) * sin(phase / 2)) * r.loud * opened * x.gain * {voices.LOUD} as y
  from x left join p on p.track = x.track and p.j = x.j left join r on r.track = p.track and r.m = p.m),
s as (select track, n, start, count(*) as sounds, arg_max(hz, m) as hz, arg_max(loud, m) as loudness, {rms("left", "-")}, {rms("right", "+")} from y group by track, n, start)
select track, n, start, cast(sounds as integer) as sounds, round(coalesce(last_value(hz ignore nulls) over w, {hz}), 4) as hz, round(coalesce(last_value(loudness ignore nulls) over w, {loud}), 6) as loudness, "left", "right" from s
window w as (partition by track order by n rows between unbounded preceding and current row)"""


@query(_sql(), "signal")
def voiced_blocks(spark, sf_dir):
    """Each block of all tracks as sound under controls: where it starts, what pitch and loudness it ends on, how loud its sides are."""
    b = chunks.in_chunks(V.signal(spark, sf_dir), BLOCK).withColumn("first", F.col("chunk") * BLOCK)
    blocks = b.select("track", F.col("chunk").alias("n"), (F.col("first") * round(1e6 / V.FS)).alias("at"), "first", "samples")
    changes = spark.createDataFrame(CHANGES, "track long, at long, " + ", ".join(f"{k} {t}" for k, t in voices.CONTROL_TYPES.items()))
    loud = lambda side: F.sqrt(F.aggregate(side, F.lit(0.0), lambda s, x: s + x * x) / F.size(side)).alias(side)
    made = voices.voiced(blocks, changes, VOICE).select("track", "n", "start", F.size("left").alias("sounds"), F.round("hz", 4).alias("hz"), "loudness", loud("left"), loud("right"))
    return made.withColumns(r6("loudness", "left", "right"))


ORACLE["voiced_blocks"] = ORACLE["voiced_blocks"].replace("with ", "with recursive ", 1)
