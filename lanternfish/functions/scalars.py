"""Scalar rules shared by the operators, all as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(x: Column) -> Column:
    """Rounds halves up, also below zero."""
    return F.floor(x + F.lit(0.5))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def clamp(x: Column, low: float, high: float) -> Column:
    """x within bounds; the lower bound where x is null or not finite."""
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), F.when(is_finite(x), x).otherwise(F.lit(float(low)))))


def safe_ratio(a: Column, b: Column, fallback: float = 0.0) -> Column:
    return F.when(is_finite(a) & is_finite(b) & (b > 1e-12), a / b).otherwise(F.lit(float(fallback)))


def bounded_score(x: Column) -> Column:
    """x / (1 + x) for positive x, else 0."""
    return F.when(is_finite(x) & (x > 0), F.least(F.lit(1.0), x / (x + 1.0))).otherwise(F.lit(0.0))


def float32(x: Column) -> Column:
    """The value after a stage that stores single precision."""
    return x.cast("float").cast("double")


def fnv1a(s: Column) -> Column:
    """FNV-1a over UTF-16 units as eight hex digits. Units beyond one byte are taken whole, so the fold runs on UTF-16BE pairs."""
    raw = F.hex(F.encode(s, "UTF-16BE"))
    units = F.transform(F.sequence(F.lit(0), (F.length(raw) / 4).cast("int") - 1), lambda k: F.conv(F.substr(raw, k * 4 + 1, F.lit(4)), 16, 10).cast("long"))
    units = F.when(F.length(raw) == 0, F.array().cast("array<long>")).otherwise(units)
    # Fixed values of the hash: offset basis 2166136261 and prime 16777619.
    folded = F.aggregate(units, F.lit(2166136261), lambda h, u: (h.bitwiseXOR(u) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))
    return F.lower(F.lpad(F.hex(folded), 8, "0"))


def stable_id(kind: Column, start: Column, end: Column, track_ids: Column) -> Column:
    """type-startMs-endMs-hash; track ids count in sorted order."""
    a, b = js_round(start * 1000).cast("string"), js_round(end * 1000).cast("string")
    return F.concat_ws("-", kind, a, b, fnv1a(F.concat_ws("|", kind, a, b, F.array_join(F.array_sort(track_ids), ","))))


def import_id(position: Column, text: Column) -> Column:
    """file-n-hash in base 36, by position and content."""
    return F.concat(F.lit("file-"), position.cast("string"), F.lit("-"), F.lower(F.conv(fnv1a(text), 16, 36)))


def finding_id(detector: Column, channels: Column, context: Column) -> Column:
    told = F.concat_ws("|", detector, F.array_join(channels, ","), F.coalesce(context.cast("string"), F.lit("all")))
    return F.concat(F.lit("ds-"), detector, F.lit("-"), fnv1a(told))


def snap_time(x: Column, step: float = 0.01) -> Column:
    return F.when(is_finite(x), F.round(js_round(x / step) * step, 12)).otherwise(F.lit(0.0))


def bounded_span(start: Column, end: Column, least: float, total: Column | None = None, most: float = 10.0) -> Column:
    """A review span: at least ``least`` seconds, at most ``most``, centred on the event and inside the recording."""
    a = F.greatest(F.lit(0.0), F.when(is_finite(start), start).otherwise(0.0))
    b = F.when(is_finite(end), F.greatest(a, end)).otherwise(a)
    length = F.least(F.lit(float(most)), F.greatest(F.lit(float(least)), b - a))
    if total is None:
        return F.struct(a.alias("start"), (a + length).alias("end"))
    whole = F.greatest(F.lit(0.0), total)
    at = F.greatest(F.lit(0.0), F.least((a + b) / 2 - length / 2, whole - length))
    return F.struct(F.when(whole <= length, 0.0).otherwise(at).alias("start"), F.when(whole <= length, whole).otherwise(at + length).alias("end"))


def polarity(p05: Column, p95: Column) -> Column:
    up, down = F.greatest(F.lit(0.0), p95), F.greatest(F.lit(0.0), -p05)
    return F.when((up < 1e-9) & (down < 1e-9), "unknown").when(up > down * 1.25, "positive").when(down > up * 1.25, "negative").otherwise("mixed")


def band_of(hz: Column) -> Column:
    return F.when(hz < 4, "delta").when(hz < 8, "theta").when(hz < 13, "alpha").when(hz < 30, "beta").otherwise("gamma")


def midi_to_hz(m: Column) -> Column:
    return F.lit(440.0) * F.pow(F.lit(2.0), (m - 69) / 12)


def hz_to_midi(hz: Column) -> Column:
    return F.lit(69.0) + F.lit(12.0) * F.log2(hz / 440.0)


#: The pentatonic scale's degrees in semitones.
PENTATONIC = (0, 2, 4, 7, 9)


def nearest_degree(x: Column, candidates: Column) -> Column:
    """The candidate closest to x, the lower of two that are as close."""
    return F.array_min(F.transform(candidates, lambda c: F.struct(F.abs(c - x).alias("d"), c.alias("c"))))["c"]


def pentatonic_hz(hz: Column) -> Column:
    midi = hz_to_midi(F.greatest(hz, F.lit(1.0)))
    steps = F.array(*[F.lit(float(12 * o + d)) for o in range(-2, 13) for d in PENTATONIC])
    return midi_to_hz(nearest_degree(midi, steps))


def scale_offset(x: Column) -> Column:
    """Of the pentatonic offsets 0 to 40 the nearest."""
    return nearest_degree(x, F.array(*[F.lit(o) for o in range(41) if o % 12 in PENTATONIC]))


def velocity(i: Column) -> Column:
    """85 to 127 from the sample index, by a multiplicative hash of 32 bits."""
    return F.lit(85) + ((i.cast("long") + 1) * F.lit(2654435761)).bitwiseAND(F.lit(4294967295)) % 43


def quantize_midi(m: Column, degrees: tuple[int, ...] = PENTATONIC) -> Column:
    """The nearest degree within m's octave; a degree that is nearer across the octave's edge is taken without adding the octave."""
    octave, own = F.floor(m / 12), m - F.floor(m / 12) * 12
    near = F.array_min(F.transform(F.array(*map(F.lit, degrees)), lambda d: F.struct(F.least(F.abs(d - own), F.lit(12) - F.abs(d - own)).alias("e"), d.alias("d"))))["d"]
    return octave * 12 + near


def equal_power(pan: Column) -> tuple[Column, Column]:
    angle = (pan + 1) * F.pi() / 4
    return F.cos(angle), F.sin(angle)


def decibels(p: Column) -> Column:
    return F.lit(10.0) * F.log10(F.greatest(F.lit(1e-20), p))


def unit_of(db: Column, low: Column, high: Column) -> Column:
    return clamp((db - low) / (high - low), 0, 1)


#: Paper geometry: 96 px an inch, 30 mm of paper a second.
PX_PER_MM = 96 / 25.4
MM_PER_SECOND = 30.0


def pixels_per_uv(sensitivity: Column) -> Column:
    """Pixels for one microvolt at a sensitivity in microvolts a millimetre."""
    return F.lit(PX_PER_MM) / F.greatest(sensitivity, F.lit(1.0))


def clamp_sensitivity(x: Column) -> Column:
    return clamp(x, 1, 2000)


def snap_sensitivity(x: Column, presets: Column) -> Column:
    """The nearest preset, the first of two that are as near."""
    at = F.transform(presets, lambda p, k: F.struct(F.abs(p - x).alias("d"), k.alias("k"), p.alias("p")))
    return F.array_min(at)["p"]


def step_sensitivity(x: Column, presets: Column, up: bool) -> Column:
    beyond = F.filter(presets, (lambda p: p > x) if up else (lambda p: p < x))
    return F.coalesce(F.array_min(beyond) if up else F.array_max(beyond), x)


def parse_clock(date: Column, time: Column) -> Column:
    """A timestamp without zone from dd.mm.yy and hh.mm.ss; years from 85 on are in the 1900s; null unless both are strictly valid."""
    d = [F.regexp_extract(date, r"^(\d\d)\.(\d\d)\.(\d\d)$", k) for k in (1, 2, 3)]
    t = [F.regexp_extract(time, r"^(\d\d)\.(\d\d)\.(\d\d)$", k) for k in (1, 2, 3)]
    year = F.when(d[2].try_cast("int") >= 85, d[2].try_cast("int") + 1900).otherwise(d[2].try_cast("int") + 2000)
    ok = (d[0] != "") & (t[0] != "")
    return F.when(ok, F.try_to_timestamp(F.concat(year.cast("string"), F.lit("-"), d[1], F.lit("-"), d[0], F.lit(" "), F.concat_ws(":", *t)), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"))


def clock_at(start: Column, seconds: Column) -> Column:
    """start plus seconds to the millisecond; null for a negative or non-finite offset."""
    ms = js_round(seconds * 1000).cast("long")
    return F.when(is_finite(seconds) & (seconds >= 0), F.timestamp_add("MILLISECOND", ms, start))


def format_clock(at: Column) -> Column:
    ms = F.date_format(at, "SSS")
    return F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.when(ms == "000", "").otherwise(F.concat(F.lit("."), ms)))


def proportional(x: Column, total: Column, other: Column) -> Column:
    """x of total as the same share of other; 0 without a total."""
    return F.when(total > 0, x / total * other).otherwise(F.lit(0.0))
