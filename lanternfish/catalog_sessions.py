"""Registered queries on sessions and exports: nested documents, the comparison of two runs, one array of annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.catalog import query
from lanternfish.operators import montage as G
from lanternfish.operators import sessions
from lanternfish.plans import views as V
from lanternfish.sources import annotations

#: Regions are shorter than the longest, so that the test tables have several.
WINDOW, SECONDS = 50, 5.0
#: (track, gain, mute, pan): one loud and far left, one silent, one partly given.
CONTROLS = ((2, 9.0, False, -3.0), (3, None, True, None), (4, 0.5, None, 0.25))


def _tracks(spark) -> DataFrame:
    c = G.described(V.channels(spark))
    tracks = c.select(F.col("idx").alias("track"), F.col("idx").alias("ord"), F.concat(F.lit("r"), F.col("idx") % 2).alias("recording"), "label", "laterality", "kind", F.array("label").alias("sources"))
    return sessions.controlled(tracks, spark.createDataFrame(CONTROLS, "track long, gain double, mute boolean, pan double"))


def _documents(spark, samples: DataFrame) -> DataFrame:
    return sessions.documents(samples, _tracks(spark), V.FS, WINDOW, SECONDS, "rms-pulse-v1", "soft-v1")


SIDES = ["left", "right"] * 4 + ["midline", "unknown"]
ASKED = '{"filters": {"bandpass": false, "hff": 0.0, "high": 40.0, "lff": 0.0, "low": 0.5, "notch60": false, "remove_dc": false}, "mapping": "rms-pulse-v1", "montage": "original", "rate": 200.0, "seconds": 5.0, "style": "soft-v1", "window": 50}'


def _sql() -> str:
    d6 = lambda x: f"cast(round({x}, 6) as decimal(18,6))"
    size = "least(1, greatest(0, rms / scale))"
    sound = lambda by, wave: f"""id: 'map:' || fid, "type": 'tone-event-v1', "derivesFrom": [fid], "time": {{"start": a, "end": b}}, "frequencyHz": {d6(f"130 + 520 * {size}")}, "amplitude": {d6(f"(0.05 + {size} * 0.28) * (case when mute then 0 else gain end) * {by}")}, "pan": {d6("pan")}, "waveform": '{wave}'"""
    return f""", t as (select idx as track, 'r' || (idx % 2) as recording, label, {SIDES}[idx + 1] as side, case when idx = 9 then 'ekg' else 'eeg' end as kind,
  case idx when 2 then 4 when 4 then 0.5 else 1 end as gain, idx = 3 as mute, case idx when 2 then -1 when 4 then 0.25 else 0 end as pan from channels),
k as (select track, i // 1000 as region, i % 1000 // 50 as win, i, v, abs(v - lag(v) over (partition by track, i // 50 order by i)) as step from signal),
f as (select track, region, win, min(i) as first, max(i) + 1 as stop, count(*) as n, avg(v) as mean, sqrt(avg(v * v)) as rms, sum(coalesce(step, 0)) as line, max(abs(v)) as peak,
  sha256(string_agg(cast(cast(round(v * 1e6) as bigint) as varchar), ',' order by i)) as sha from k group by all),
g as (select *, greatest(max(peak) over (partition by track, region), 1e-12) as scale from f),
h as (select g.*, recording, label, side, kind, gain, mute, pan, 'feature:' || track || ':' || first || ':' || win as fid, {d6("first / 200.0::double")} as a, {d6("stop / 200.0::double")} as b from g join t using (track)),
e as (select recording, region, track, win, stop,
  {{id: fid, "type": 'feature-window-v1', "time": {{"start": a, "end": b}}, "source": {{"trackId": track, "channel": label, "laterality": side, "kind": kind, "sampleRate": {d6("200")}, "inputSampleStart": first, "inputSampleEndExclusive": stop, "sourceTimeStart": a, "sourceTimeEnd": b, "derivationSources": [label], "normalizationScale": {d6("scale")}, "windowSeconds": {d6("0.25")}}}, "features": {{"mean": {d6("mean")}, "rms": {d6("rms")}, "lineLength": {d6("line")}}}}} as feature,
  {{{sound("1", "pulse")}}} as mapped, {{{sound("0.72", "sine")}, "style": {{id: 'soft-v1', "version": '1.0.0', "changes": ['amplitude × 0.72', 'waveform → sine']}}}} as styled from h),
l as (select recording, region, count(*) as events, max(stop) as stop, list(feature order by track, win) as features, list(mapped order by track, win) as mapped, list(styled order by track, win) as styled from e group by all),
p as (select recording, region, track, any_value(label) as label, any_value(gain) as gain, any_value(mute) as mute, any_value(pan) as pan, cast(sum(n) as bigint) as n, sha256(string_agg(sha, '' order by win)) as sha from h group by all),
q as (select recording, region, list({{"trackId": track, "channel": label, "gain": {d6("gain")}, "mute": mute, "pan": {d6("pan")}, "samples": n, "sha256": sha}} order by track) as tracks, list(track order by track) filter (where not mute) as heard, list(label order by track) as labels, list(label order by track) filter (where not mute) as audible,
  sha256(string_agg(track || ':' || sha, ',' order by track)) as inputs_sha256,
  sha256('{ASKED}' || to_json(list({{"trackId": track, "gain": {d6("gain")}, "mute": mute, "pan": {d6("pan")}}} order by track))) as parameters_sha256 from p group by all),
r as (select *, sha256(cast(to_json(styled) as varchar)) as events_sha256, {d6("region * 5")} as a, {d6("stop / 200.0::double")} as b from l join q using (recording, region))
select recording, region, events, inputs_sha256, parameters_sha256, events_sha256, cast(to_json({{"recording": recording, "montage": 'original',
  "session": {{"region": {{"requestedStart": a, "requestedEnd": b, "start": a, "end": b, "truncatedToMaxSeconds": false}}, "mapping": {{id: 'rms-pulse-v1', "version": '1.0.0', "classification": 'X', "statement": '{sessions.STATEMENT}'}}, "style": 'soft-v1',
    "featureEvents": features, "mappedEvents": mapped, "events": styled, "audit": {{"eventCount": events, "audibleTrackIds": heard, "note": '{sessions.NOTE}'}}}},
  "reproduction": {{"channels": labels, "interval": cast(a as decimal(18,2)) || '–' || cast(b as decimal(18,2)) || ' s', "filters": ['none'], "audible": audible, "method": 'rms-pulse-v1@1.0.0 (Level X) + soft-v1@1.0.0 style'}},
  "provenance": {{"tracks": tracks, "parameters": '{ASKED}', "inputsSha256": inputs_sha256, "parametersSha256": parameters_sha256, "eventsSha256": events_sha256}}}}) as varchar) as document from r"""


@query(_sql(), "signal", "channels")
def session_documents(spark, sf_dir):
    """Sessions of two recordings of five tracks, by regions of 5 s."""
    return _documents(spark, V.signal(spark, sf_dir))


@query(
    """, s as (select 'r' || (track % 2) as recording, i // 1000 as region, track, i from signal)
select recording, region, case when bool_and(track % 2 = 1 and region = 0) then 'gone' when bool_or(track = 4 and i % 1700 = 3) then 'inputs' else 'same' end as verdict from s group by all""",
    "signal",
)
def session_rerun(spark, sf_dir):
    """A run against one in which a few samples of a track differ and one region is missing."""
    s = V.signal(spark, sf_dir)
    again = s.where("not (track % 2 = 1 and i < 1000)").withColumn("v", F.when((F.col("track") == 4) & (F.col("i") % 1700 == 3), F.col("v") + 1).otherwise(F.col("v")))
    return sessions.compared(_documents(spark, s), _documents(spark, again))


@query(
    """, j as (select cast(round("start", 6) as decimal(24,6)) as "start", cast(round("end", 6) as decimal(24,6)) as "end", type, text, track, source, cast(round(confidence, 6) as decimal(24,6)) as confidence from annotations),
o as (select "start", "end", cast(to_json({"start": "start", "end": "end", "type": type, "text": text, "track": cast(track as varchar), "source": source, "confidence": confidence}) as varchar) as value from j),
n as (select *, row_number() over (order by "start", "end", value) as k from o)
select cast(1 as integer) as part, cast("start" as double) as "start", cast("end" as double) as "end", case when k = 1 then '' else ',' end || value as line from n union all select unnest([0, 2]), null, null, unnest(['[', ']'])""",
    "annotations",
)
def annotation_array(spark, sf_dir):
    """All annotations as the lines of one JSON array."""
    lines = annotations.array_lines(V.annotations(spark, sf_dir).withColumn("tracks", F.array(F.col("track").cast("string"))))
    return lines.withColumns({x: F.col(x).cast("double") for x in ("start", "end")})
