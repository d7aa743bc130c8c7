"""What a reader sees: viewports, per-pixel traces, lanes, sensitivities, EKG scaling, colours.

Traces over many tracks are aggregates on (track, pixel) in the JVM; rules for one
viewport are plain functions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternfish.functions.scalars import decibels, is_finite, snap_sensitivity
from lanternfish.operators.aggregates import floor_percentile, upper_median

# Presets in microvolts a millimetre, shortest view, where the cursor stays when a view follows it.
SENSITIVITIES = (1, 2, 3, 5, 7, 9, 10, 15, 20, 30, 50, 70, 100, 150, 200, 300, 500, 1000, 2000)
SHORTEST = 0.5
USUAL = 10.0
ANCHOR = 0.3
NATIVE_SAMPLES = 65_536


def within(x: float, low: float, high: float) -> float:
    return min(high, max(low, x))


@dataclass(frozen=True)
class View:
    """A stretch of a recording of ``total`` seconds."""

    start: float
    seconds: float
    total: float

    @classmethod
    def of(cls, start: float, seconds: float, total: float) -> "View":
        total = max(0.0, total if math.isfinite(total) else 0.0)
        least = min(SHORTEST, total or SHORTEST)
        seconds = within(seconds if math.isfinite(seconds) else USUAL, least, max(total, least))
        return cls(within(start if math.isfinite(start) else 0.0, 0.0, max(0.0, total - seconds)), seconds, total)

    @classmethod
    def whole(cls, samples: int, fs: float) -> "View":
        """All of a recording: where samples / fs is rounded down, times fs it can fall a sample short, so the next double is its end."""
        seconds = samples / fs
        if seconds * fs < samples:
            seconds = math.nextafter(seconds, math.inf)
        return cls(0.0, seconds, seconds)

    @property
    def end(self) -> float:
        return self.start + self.seconds

    def moved(self, by: float) -> "View":
        return View.of(self.start + (by if math.isfinite(by) else 0.0), self.seconds, self.total)

    def resized(self, seconds: float) -> "View":
        return View.of(self.start, seconds, self.total)

    def zoomed(self, factor: float, anchor: float) -> "View":
        """The anchor stays where it is in the window."""
        share = within((anchor - self.start) / self.seconds, 0, 1) if self.seconds > 1e-9 else ANCHOR
        wide = View.of(0, self.seconds * max(1e-3, factor), self.total)
        return View.of(anchor - share * wide.seconds, wide.seconds, self.total)

    def following(self, at: float, share: float = ANCHOR) -> "View":
        return View.of(within(at, 0, self.total) - self.seconds * within(share, 0, 1), self.seconds, self.total)

    def showing(self, start: float, end: float) -> "View":
        """The same view if it holds the span, else one that starts near it."""
        a = within(start, 0, self.total)
        b = within(max(a, end), 0, self.total)
        if a >= self.start and b <= self.end:
            return self
        return View.of(a if b - a >= self.seconds else a - self.seconds * ANCHOR, self.seconds, self.total)

    def centred(self, start: float, end: float) -> "View":
        a = within(start, 0, self.total)
        return View.of((a + within(max(a, end), 0, self.total)) / 2 - self.seconds / 2, self.seconds, self.total)

    def holds(self, start: float, seconds: float, slack: float = 1e-6) -> bool:
        return start >= self.start - slack and start + seconds <= self.end + slack

    def prefetched(self, low_cut: float, ica: bool = False) -> "View":
        """With a margin that keeps filters' transients off the page: 3 / cutoff in 2 to 30 s, 4 s for ICA, a page at least."""
        margin = max(min(30.0, max(2.0, 3 / low_cut)) if low_cut > 0 else 2.0, 4.0 if ica else 0.0, self.seconds)
        a, b = max(0.0, self.start - margin), min(self.total, self.end + margin)
        return View(a, max(0.0, b - a), self.total)


def pixel_traces(samples: DataFrame, fs: float, view: View, pixels: int) -> DataFrame:
    """(track, pixel, n, first, last, low, high, low_at, high_at) of a viewport; a pixel holds one sample at least.

    With less than a sample a pixel, pixels share samples: each takes the one its left edge falls on.
    """
    p = F.explode(F.sequence(F.lit(0), F.lit(pixels - 1)))
    edge = lambda k: F.floor((view.start + k / pixels * view.seconds) * fs)
    bins = samples.sparkSession.range(1).select(p.alias("pixel")).select("pixel", edge(F.col("pixel")).alias("a"), edge(F.col("pixel") + 1).alias("b"))
    bins = bins.withColumn("b", F.greatest("b", F.col("a") + 1))
    if view.seconds * fs >= pixels:
        # Each sample lies in one bin; the rounding at edges is settled by the bins' own bounds.
        guess = F.floor((F.col("i") / fs - view.start) / view.seconds * pixels)
        near = samples.where((F.col("i") >= int(view.start * fs)) & (F.col("i") <= int(view.end * fs) + 1)).withColumn("pixel", F.explode(F.array(guess - 1, guess, guess + 1)))
        rows = near.join(F.broadcast(bins), "pixel").where((F.col("i") >= F.col("a")) & (F.col("i") < F.col("b")))
    else:
        rows = samples.join(F.broadcast(bins.withColumn("i", F.explode(F.sequence("a", F.col("b") - 1)))), "i")
    return rows.groupBy("track", "pixel").agg(F.count("*").alias("n"), F.min_by("v", "i").alias("first"), F.max_by("v", "i").alias("last"), F.min("v").alias("low"), F.max("v").alias("high"), F.min(F.struct("v", "i"))["i"].alias("low_at"), (-F.max(F.struct("v", (-F.col("i")).alias("m")))["m"]).alias("high_at"))


def native(samples: DataFrame, fs: float, view: View) -> DataFrame:
    """A viewport's own samples with one neighbour on either side."""
    return samples.where((F.col("i") >= math.ceil(view.start * fs) - 1) & (F.col("i") <= math.floor(view.end * fs) + 1))


def trace(samples: DataFrame, fs: float, view: View, pixels: int) -> DataFrame:
    """Native samples where they are few, else per-pixel extremes."""
    few = view.seconds * fs <= max(pixels, NATIVE_SAMPLES)
    return native(samples, fs, view) if few else pixel_traces(samples, fs, view, pixels)


def at_pixel_centres(samples: DataFrame, fs: float, view: View, pixels: int) -> DataFrame:
    """(track, pixel, v) between neighbouring samples at each pixel's centre; the ends hold."""
    ends = samples.groupBy("track").agg(F.max("i").alias("last"))
    at = (F.lit(view.start) + (F.col("pixel") + 0.5) / pixels * view.seconds) * fs
    grid = ends.withColumn("pixel", F.explode(F.sequence(F.lit(0), F.lit(pixels - 1)))).withColumn("x", F.least(F.col("last").cast("double"), F.greatest(F.lit(0.0), at)))
    grid = grid.withColumn("i", F.floor("x"))
    right = samples.select("track", (F.col("i") - 1).alias("i"), F.col("v").alias("w"))
    f = F.col("x") - F.col("i")
    return grid.join(samples, ["track", "i"]).join(right, ["track", "i"], "left").select("track", "pixel", (F.col("v") * (1 - f) + F.coalesce("w", "v") * f).alias("v"))


def overview(traces: DataFrame, lanes: DataFrame) -> DataFrame:
    """(group, pixel, low, high): the mean of the lanes' extremes by group of lanes."""
    return traces.join(F.broadcast(lanes), "track").groupBy("group", "pixel").agg(F.avg("low").alias("low"), F.avg("high").alias("high"))


def strided(samples: DataFrame, most: int) -> DataFrame:
    """Every floor(n / most)-th sample of each track."""
    n = samples.groupBy("track").agg(F.greatest(F.lit(1), F.floor(F.count("*") / most)).alias("step"))
    return samples.join(n, "track").where(F.col("i") % F.col("step") == 0).drop("step")


def ekg_profile(samples: DataFrame) -> DataFrame:
    """(track, baseline, peak, clip) from about 12 000 finite samples: a robust height, so that artifacts don't set the scale."""
    v = strided(samples, 12_000).where(is_finite(F.col("v")))
    base = v.groupBy("track").agg(upper_median(F.col("v")).alias("baseline"))
    d = F.abs(F.col("v") - F.col("baseline"))
    p75 = floor_percentile(d, 0.75)
    out = v.join(base, "track").groupBy("track", "baseline").agg(F.greatest(F.lit(1e-6), floor_percentile(d, 0.995) * 1.12, floor_percentile(d, 0.9) * 1.65, F.when(p75 > 1e-12, p75).otherwise(1.0) * 4).alias("peak"))
    return out.withColumn("clip", F.col("peak") * 1.45)


def ekg_value(v: Column, baseline: Column, clip: Column) -> Column:
    return F.greatest(-clip, F.least(clip, F.when(is_finite(v), v - baseline).otherwise(0.0)))


def fitted_sensitivity(samples: DataFrame, height_mm: float = 10.0) -> DataFrame:
    """(uv): the preset that fits the largest 97th percentile of magnitudes of EEG and eye tracks, peak to peak, into a height."""
    v = strided(samples.where("kind in ('eeg', 'eog')"), 6000)
    values = F.array_sort(F.collect_list(F.abs("v")))
    peaks = v.groupBy("track").agg(F.element_at(values, F.least(F.size(values), F.floor(F.size(values) * 0.97).cast("int") + 1)).alias("p"))
    wanted = F.least(F.lit(2000.0), F.greatest(F.lit(1.0), F.floor(F.coalesce(F.max("p"), F.lit(0.0)) * 2 / max(0.1, height_mm) + 0.5)))
    return peaks.agg(snap_sensitivity(wanted, F.array(*[F.lit(float(x)) for x in SENSITIVITIES])).alias("uv"))


def caliper(samples: DataFrame, fs: float, a: float, b: float) -> DataFrame:
    """(track, seconds, hz, uv) between two times: hz only in 0.2 to 80, the difference of the nearest samples."""
    i, j = (int(math.floor(x * fs + 0.5)) for x in (a, b))
    gap = abs(b - a)
    hz = 1 / gap if gap > 0 and 0.2 <= 1 / gap <= 80 else None
    ends = samples.where(F.col("i").isin(i, j)).groupBy("track").agg(F.max(F.when(F.col("i") == j, F.col("v"))).alias("y"), F.max(F.when(F.col("i") == i, F.col("v"))).alias("x"))
    return ends.select("track", F.lit(gap).alias("seconds"), F.lit(hz).cast("double").alias("hz"), (F.col("y") - F.col("x")).alias("uv"))


def lanes(tracks: DataFrame, height: float, gap: float) -> DataFrame:
    """(track, ord, group, top, bottom): lanes in order of kind and montage, with a gap where the group changes."""
    rank = F.when(F.col("kind") == "eeg", 0).when(F.col("kind") == "eog", 1).when(F.col("kind") == "emg", 2).when(F.col("kind") == "ekg", 4).otherwise(3)
    w = Window.orderBy("rank", "ord")  # a screen's lanes
    rows = tracks.withColumn("rank", rank)
    change = (F.lag("group").over(w).isNotNull() & (F.lag("group").over(w) != F.col("group"))).cast("double")
    rows = rows.withColumn("step", F.lit(float(height)) + change * gap)
    bottom = F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("track", "ord", "group", (bottom - height).alias("top"), bottom.alias("bottom"))


def hits(boxes: DataFrame, x: float, y: float, slack: float = 4.0) -> DataFrame:
    """Boxes(id, x0, x1, top, bottom, start, end) under a point, the narrowest first, then by start and id."""
    inside = (F.col("x0") - slack <= x) & (F.col("x1") + slack >= x) & (F.col("top") <= y) & (F.col("bottom") >= y)
    return boxes.where(inside).orderBy(F.col("end") - F.col("start"), "start", "id")


def ramp(unit: Column, stops: tuple[tuple[float, int, int, int], ...]) -> Column:
    """(r, g, b) between stops of a colour ramp."""
    x = F.least(F.lit(1.0), F.greatest(F.lit(0.0), unit))
    out = F
    for (p, *a), (q, *b) in zip(stops, stops[1:], strict=False):
        share = (x - p) / (q - p)
        out = out.when(x <= q, F.struct(*[F.floor(u + (v - u) * share + 0.5).cast("int").alias(n) for n, u, v in zip("rgb", a, b, strict=True)]))
    return out.otherwise(F.struct(*[F.lit(v).alias(n) for n, v in zip("rgb", stops[-1][1:], strict=True)]))


def shade(power: Column, low: Column, high: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (decibels(power) - low) / (high - low)))
