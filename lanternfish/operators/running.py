"""Centred windows at any time, from running totals in two levels, and the read-out under a cursor.

A track is cut into chunks. Running totals within a chunk are one window of a chunk's
samples; the chunks' totals are summed up the same way, level by level, until one
chunk holds them all. The total before a sample is then a look-up, and a window at any
time the difference of two: no window spans a track, and windows may overlap freely.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternfish.functions.scalars import band_of

CHUNK = 1024


def running(rows: DataFrame, values: Sequence[str], last: int, size: int = CHUNK) -> DataFrame:
    """rows(track, i, values) with the values replaced by their totals over the track up to i, where i <= last."""
    keyed = rows.withColumn("_c", F.floor(F.col("i") / size))
    w = Window.partitionBy("track", "_c").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    inner = keyed.withColumns({v: F.sum(v).over(w) for v in values})
    if last < size:
        return inner.drop("_c")
    totals = keyed.groupBy("track", "_c").agg(*(F.sum(v).alias(v) for v in values)).withColumnRenamed("_c", "i")
    upper = running(totals.withColumns({f"_own_{v}": F.col(v) for v in values}), values, last // size, size)
    offsets = upper.select("track", F.col("i").alias("_c"), *((F.col(v) - F.col(f"_own_{v}")).alias(f"_{v}") for v in values))
    out = inner.join(offsets, ["track", "_c"])
    return out.withColumns({v: F.col(v) + F.col(f"_{v}") for v in values}).drop("_c", *(f"_{v}" for v in values))


def totals(samples: DataFrame, size: int = CHUNK) -> DataFrame:
    """(track, i, n, squares, ups): of samples(track, i, v), i from 0 on without gaps, the totals before i, and one row more at the end.

    squares: of v squared; ups: of upward crossings of zero, counted at the sample after each.
    """
    keyed = samples.withColumn("_c", F.floor(F.col("i") / size))
    ends = keyed.groupBy("track", "_c").agg(F.max_by("v", "i").alias("_end")).withColumn("_c", F.col("_c") + 1)
    before = F.coalesce(F.lag("v").over(Window.partitionBy("track", "_c").orderBy("i")), F.col("_end"))
    up = F.coalesce((before <= 0) & (F.col("v") > 0), F.lit(False)).cast("long")
    rows = keyed.join(ends, ["track", "_c"], "left").select("track", "i", F.lit(1).cast("long").alias("n"), (F.col("v") * F.col("v")).alias("squares"), up.alias("ups"))
    last = samples.agg(F.max("i")).first()[0] or 0
    done = running(rows, ("n", "squares", "ups"), int(last), size).select("track", (F.col("i") + 1).alias("i"), "n", "squares", "ups")
    none = samples.where("i = 0").select("track", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("squares"), F.lit(0).cast("long").alias("ups"))
    return none.unionByName(done)


def _edges(t: Column, seconds: float, fs: float, n: Column) -> tuple[Column, Column]:
    """The samples [a, b) of a window of so many seconds around t."""
    a = F.greatest(F.lit(0), F.floor((t - seconds / 2) * fs))
    return a.cast("long"), F.least(n, F.floor((t + seconds / 2) * fs)).cast("long")


def centred(total: DataFrame, cursors: DataFrame, fs: float, hz_seconds: float = 1.0, rms_seconds: float = 0.25) -> DataFrame:
    """(track, t, hz, rms) of totals() at cursors(track, t): upward crossings over a window's duration, root mean square.

    hz is 0 where the window holds fewer than 8 samples, rms where it holds none. Four look-ups a cursor, each by (track, i).
    """
    ends = total.groupBy("track").agg(F.max("i").alias("_n"))
    a, b = _edges(F.col("t"), hz_seconds, fs, F.col("_n"))
    c, d = _edges(F.col("t"), rms_seconds, fs, F.col("_n"))
    out = cursors.select("track", "t").distinct().join(ends, "track").withColumns({"_a": a, "_b": b, "_c": c, "_d": d})
    # The first sample of a window has no one before it: crossings count from the second on.
    wanted = F.array(*(F.struct(F.lit(k).alias("k"), i.alias("i")) for k, i in (("a", F.col("_a") + 1), ("b", F.col("_b")), ("c", F.col("_c")), ("d", F.col("_d")))))
    asked = out.withColumn("_w", F.explode(wanted)).select("track", "t", "_a", "_b", "_c", "_d", "_w.k", "_w.i")
    found = asked.join(total.select("track", "i", "squares", "ups"), ["track", "i"], "left")
    pick = lambda k, v: F.max(F.when(F.col("k") == k, F.col(v)))
    at = found.groupBy("track", "t", "_a", "_b", "_c", "_d").agg(pick("a", "ups").alias("ua"), pick("b", "ups").alias("ub"), pick("c", "squares").alias("sc"), pick("d", "squares").alias("sd"))
    n, m = F.col("_b") - F.col("_a"), F.col("_d") - F.col("_c")
    hz = F.when(n < 8, 0.0).otherwise((F.col("ub") - F.col("ua")) / F.greatest(F.lit(1e-6), n / fs))
    rms = F.when(m <= 0, 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), F.col("sd") - F.col("sc")) / m))
    return at.select("track", "t", hz.alias("hz"), rms.alias("rms"))


def readout(total: DataFrame, times: DataFrame, fs: float, frames: DataFrame | None = None, win_seconds: float = 2.0, hop_seconds: float = 0.5) -> DataFrame:
    """(t, hz, band, uv) at times(t): means over the tracks of their crossings a second and root mean squares, and the rhythm's band.

    With frames(side, t, delta … gamma), of a summary's frame numbers, also left and right: the shares of the frame that each
    time belongs to.
    """
    tracks = total.where("i = 0").select("track").distinct()
    near = centred(total, times.select("t").distinct().crossJoin(tracks), fs)
    out = near.groupBy("t").agg(F.avg("hz").alias("hz"), F.avg("rms").alias("uv")).select("t", "hz", band_of(F.col("hz")).alias("band"), "uv")
    if frames is None:
        return out
    from lanternfish.operators.spectral import BANDS, frame_at

    count = frames.agg(F.max("t")).first()[0]
    side = lambda s: frames.where(F.col("side") == s).select(F.col("t").alias("_f"), F.struct(*BANDS).alias(s))
    out = out.withColumn("_f", frame_at(F.col("t"), win_seconds, hop_seconds, int(count or 0) + 1).cast("long"))
    return out.join(side("left"), "_f", "left").join(side("right"), "_f", "left").drop("_f")
