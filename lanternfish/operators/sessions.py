"""Sessions: what a recording's tones were derived from, as nested documents whose digests let a rerun be compared.

A session is one region of at most 30 s of one recording, so the lists that it
gathers are bounded: windows of a region times tracks of a recording. Numbers are
written with six decimals and lists in order of track and window, so that equal
runs give equal texts wherever their rows were computed. Digests form a tree:
samples of a window, windows of a track, tracks of a session; a task that digests
samples holds one window.

Defined results: a recording without samples has no session; null or non-finite
samples, gains and pans end the job with a message; a track without controls has
gain 1, pan 0 and sounds.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfish.functions.scalars import is_finite
from lanternfish.operators import mapping as M
from lanternfish.operators import windows as W
from lanternfish.operators.dsp import Filters

# What a session says of itself.
VERSION = "1.0.0"
CLASS = "X"
STATEMENT = "Experimental mapping for listening and teaching; it does not detect seizures or other conditions."
NOTE = "Experimental event sonification. No diagnostic classification or alert is produced."
#: The longest region, in seconds.
LONGEST = 30.0


def fixed(x: Column) -> Column:
    """A number with six decimals; JSON shows all of them."""
    return F.round(x, 6).cast("decimal(18,6)")


def as_json(x: Column) -> Column:
    return F.to_json(x, {"ignoreNullFields": "false"})


def sha(x: Column) -> Column:
    return F.sha2(x, 256)


def controlled(tracks: DataFrame, controls: DataFrame | None = None) -> DataFrame:
    """tracks(track, …) with gain from 0 to 4, mute, and pan from -1 to 1, out of controls(track, gain, mute, pan)."""
    plain = {"gain": F.lit(1.0), "mute": F.lit(False), "pan": F.lit(0.0)}
    if controls is None:
        return tracks.withColumns(plain)
    both = tracks.join(controls.select("track", *plain), "track", "left")
    bad = lambda c: F.col(c).isNotNull() & ~is_finite(F.col(c))
    held = lambda c, low, high: F.when(bad(c), F.raise_error(F.concat(F.lit(f"{c} isn't finite for track "), F.col("track").cast("string")))).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(F.col(c), plain[c]))))
    return both.withColumns({"gain": held("gain", 0.0, 4.0), "mute": F.coalesce("mute", plain["mute"]), "pan": held("pan", -1.0, 1.0)})


def filter_texts(f: Filters) -> list[str]:
    """What filters do, in words."""
    told = [(f.remove_dc, "DC offset removed"), (f.lff > 0, f"LFF {f.lff:g} Hz"), (f.hff > 0, f"HFF {f.hff:g} Hz"), (f.bandpass, f"{f.low:g}–{f.high:g} Hz bandpass (zero-phase)"), (f.notch60, "60 Hz notch (zero-phase)")]
    return [text for on, text in told if on] or ["none"]


def digests(samples: DataFrame, fs: float, size: int, seconds: float) -> DataFrame:
    """(track, region, n, sha256) of all samples in millionths: of each window its text, of the region its windows' digests in order."""
    span = int(-(-min(seconds, LONGEST) * fs // 1))
    region = F.floor(F.col("i") / span)
    sound = F.when(is_finite(F.col("v")), F.round(F.col("v") * 1e6).cast("long")).otherwise(F.raise_error(F.concat(F.lit("a sample isn't finite in track "), F.col("track").cast("string"))))
    keyed = samples.select("track", region.alias("region"), F.floor((F.col("i") - region * span) / size).alias("window"), "i", sound.alias("u"))
    own = F.array_sort(F.collect_list(F.struct("i", "u")))
    windows = keyed.groupBy("track", "region", "window").agg(F.count("*").alias("n"), sha(F.array_join(F.transform(own, lambda r: r["u"].cast("string")), ",")).alias("sha"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("window", "sha"))), lambda r: r["sha"])
    return windows.groupBy("track", "region").agg(F.sum("n").alias("n"), sha(F.array_join(in_order, "")).alias("sha256"))


def events(features: DataFrame, tracks: DataFrame, fs: float, size: int, mapping: str, style: str) -> DataFrame:
    """(recording, region, ord, window, feature, mapped, styled): each window's evidence, its tone, and the tone in its style.

    features: of windows.region_features; tracks(track, ord, recording, label, laterality, kind, sources, gain, mute, pan).
    """
    f = features.join(tracks, "track")
    gain = F.when(F.col("mute"), 0.0).otherwise(F.col("gain"))
    f = f.withColumn("_feature", F.concat_ws(":", F.lit("feature"), F.col("track").cast("string"), F.col("sample_start").cast("string"), F.col("window").cast("string")))
    tone = M.mapped(f, mapping, gain, F.col("pan"))
    at = {x: fixed(F.col(f"sample_{x}") / fs) for x in ("start", "end")}
    source = F.struct(
        F.col("track").alias("trackId"), F.col("label").alias("channel"), "laterality", "kind", fixed(F.lit(float(fs))).alias("sampleRate"), F.col("sample_start").alias("inputSampleStart"), F.col("sample_end").alias("inputSampleEndExclusive"),
        at["start"].alias("sourceTimeStart"), at["end"].alias("sourceTimeEnd"), F.col("sources").alias("derivationSources"), fixed(F.col("scale")).alias("normalizationScale"), fixed(F.lit(size / fs)).alias("windowSeconds"),
    )
    time = F.struct(at["start"].alias("start"), at["end"].alias("end"))
    feature = F.struct(F.col("_feature").alias("id"), F.lit("feature-window-v1").alias("type"), time.alias("time"), source.alias("source"), F.struct(fixed(F.col("mean")).alias("mean"), fixed(F.col("rms")).alias("rms"), fixed(F.col("line_length")).alias("lineLength")).alias("features"))
    sounds = [F.concat(F.lit("map:"), "_feature").alias("id"), F.lit("tone-event-v1").alias("type"), F.array("_feature").alias("derivesFrom"), time.alias("time"), fixed(F.col("hz")).alias("frequencyHz"), fixed(F.col("amplitude")).alias("amplitude"), fixed(F.col("pan")).alias("pan"), F.col("wave").alias("waveform")]
    tone = M.styled(tone.withColumns({"feature": feature, "mapped": F.struct(*sounds)}), style)
    told = F.struct(F.lit(style).alias("id"), F.lit(VERSION).alias("version"), "changes").alias("style")
    return tone.select("recording", "region", "ord", "window", "sample_start", "sample_end", "feature", "mapped", F.struct(*sounds, told).alias("styled"))


def documents(samples: DataFrame, tracks: DataFrame, fs: float, size: int = 50, seconds: float = LONGEST, mapping: str = "contour-v1", style: str = "plain-v1", filters: Filters | None = None, montage: str = "original") -> DataFrame:
    """(recording, region, events, inputs_sha256, parameters_sha256, events_sha256, document) for each region of each recording.

    samples(track, i, v), after filters, which are only recorded here; tracks as for events, and unique in track. document: JSON with recording, montage, session, reproduction and provenance.
    """
    filters = filters or Filters(remove_dc=False, lff=0.0, hff=0.0, notch60=False)
    parameters = {"mapping": mapping, "style": style, "window": size, "seconds": min(seconds, LONGEST), "rate": fs, "filters": asdict(filters), "montage": montage}
    asked = json.dumps(parameters, sort_keys=True, ensure_ascii=False)
    made = events(W.region_features(samples, fs, size, seconds), tracks, fs, size, mapping, style)
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("ord", "window", c))), lambda r: r[c])
    told = made.groupBy("recording", "region").agg(F.count("*").alias("events"), F.min("sample_start").alias("a"), F.max("sample_end").alias("b"), *(listed(c).alias(c) for c in ("feature", "mapped", "styled")))
    inputs = digests(samples, fs, size, seconds).join(tracks, "track")
    per_track = F.struct("ord", F.struct(F.col("track").alias("trackId"), F.col("label").alias("channel"), fixed(F.col("gain")).alias("gain"), "mute", fixed(F.col("pan")).alias("pan"), F.col("n").alias("samples"), "sha256").alias("t"))
    inputs = inputs.groupBy("recording", "region").agg(F.transform(F.array_sort(F.collect_list(per_track)), lambda r: r["t"]).alias("tracks"))
    # Controls are part of what was asked, samples of what came in.
    levels = as_json(F.transform("tracks", lambda t: F.struct(t["trackId"].alias("trackId"), t["gain"].alias("gain"), t["mute"].alias("mute"), t["pan"].alias("pan"))))
    rows = told.join(inputs, ["recording", "region"]).withColumns({
        "inputs_sha256": sha(F.array_join(F.transform("tracks", lambda t: F.concat(t["trackId"].cast("string"), F.lit(":"), t["sha256"])), ",")),
        "parameters_sha256": sha(F.concat(F.lit(asked), levels)), "events_sha256": sha(as_json(F.col("styled"))),
        "start": fixed(F.col("region") * min(seconds, LONGEST)), "end": fixed(F.col("b") / fs), "heard": F.filter("tracks", lambda t: ~t["mute"]),
    })
    session = F.struct(
        F.struct(F.col("start").alias("requestedStart"), F.col("end").alias("requestedEnd"), "start", "end", F.lit(seconds > LONGEST).alias("truncatedToMaxSeconds")).alias("region"),
        F.struct(F.lit(mapping).alias("id"), F.lit(VERSION).alias("version"), F.lit(CLASS).alias("classification"), F.lit(STATEMENT).alias("statement")).alias("mapping"), F.lit(style).alias("style"),
        F.col("feature").alias("featureEvents"), F.col("mapped").alias("mappedEvents"), F.col("styled").alias("events"),
        F.struct(F.col("events").alias("eventCount"), F.transform("heard", lambda t: t["trackId"]).alias("audibleTrackIds"), F.lit(NOTE).alias("note")).alias("audit"),
    )
    two = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    reproduction = F.struct(
        F.transform("tracks", lambda t: t["channel"]).alias("channels"), F.concat(two("start"), F.lit("–"), two("end"), F.lit(" s")).alias("interval"), F.array(*map(F.lit, filter_texts(filters))).alias("filters"),
        F.transform("heard", lambda t: t["channel"]).alias("audible"), F.lit(f"{mapping}@{VERSION} (Level {CLASS}) + {style}@{VERSION} style").alias("method"),
    )
    provenance = F.struct("tracks", F.lit(asked).alias("parameters"), F.col("inputs_sha256").alias("inputsSha256"), F.col("parameters_sha256").alias("parametersSha256"), F.col("events_sha256").alias("eventsSha256"))
    whole = F.struct("recording", F.lit(montage).alias("montage"), session.alias("session"), reproduction.alias("reproduction"), provenance.alias("provenance"))
    return rows.select("recording", "region", "events", "inputs_sha256", "parameters_sha256", "events_sha256", as_json(whole).alias("document"))


def compared(first: DataFrame, second: DataFrame) -> DataFrame:
    """(recording, region, verdict) of two runs of documents().

    same; inputs, parameters or both (the reason that a rerun may differ); drift: the same inputs and parameters gave other
    events; gone or new: only the first or only the second run has it.
    """
    names = ("inputs_sha256", "parameters_sha256", "events_sha256")
    keys = ("recording", "region")
    a = first.select(*keys, *names, F.lit(True).alias("_a")).alias("a")
    b = second.select(*keys, *(F.col(n).alias(f"{n}_b") for n in names), F.lit(True).alias("_b")).alias("b")
    both = a.join(b, list(keys), "full")
    other = [F.col(n) != F.col(f"{n}_b") for n in names]
    verdict = F.when(F.col("_b").isNull(), "gone").when(F.col("_a").isNull(), "new").when(other[0] & other[1], "both").when(other[0], "inputs").when(other[1], "parameters").when(other[2], "drift").otherwise("same")
    return both.select(*keys, verdict.alias("verdict"))


def write(made: DataFrame, path: str) -> None:
    """A folder for each recording, a JSON object a line, one line a session."""
    made.select("recording", F.col("document").alias("value")).write.partitionBy("recording").text(path)
