"""Window features over long-form samples(track, i, v): tumbling contexts, moving frames, runs, bins.

Each works on whole tracks by keys of (track, window), so no task needs more than
one window's samples, but for frames that follow a sample (lag, moving mean).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternfish.functions.scalars import is_finite, js_round, polarity, safe_ratio


def in_order(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("i")


def contexts(samples: DataFrame, fs: float, seconds: tuple[float, ...], least: int = 8) -> DataFrame:
    """samples with ctx and win: for each context length the tumbling window that a sample lies in; each sample once a length."""
    sizes = F.array(*[F.struct(F.lit(float(s)).alias("ctx"), F.lit(max(least, int(s * fs + 0.5))).cast("long").alias("size")) for s in seconds])
    out = samples.withColumn("c", F.explode(sizes))
    return out.select(*samples.columns, "c.ctx", F.floor(F.col("i") / F.col("c.size")).alias("win"))


def measures(windows: DataFrame, least: int = 8) -> DataFrame:
    """One row for each (track, ctx, win) of ``least`` finite samples or more: spread, extremes, jumps, longest flat run.

    The median comes first and is joined back, as deviations and thresholds depend on it.
    """
    keys = ["track", "ctx", "win"]
    finite = windows.where(is_finite(F.col("v")))
    centre = finite.groupBy(*keys).agg(F.count("*").alias("n"), F.median("v").alias("median"), F.avg("v").alias("mean"), F.percentile("v", F.lit(0.05)).alias("p05"), F.percentile("v", F.lit(0.95)).alias("p95"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms")).where(F.col("n") >= least)
    spread = finite.join(centre, keys).groupBy(*keys).agg(F.greatest(F.lit(1e-12), F.median(F.abs(F.col("v") - F.col("median"))) * 1.4826).alias("scale"))
    known = centre.join(spread, keys)
    step = F.abs(F.col("v") - F.lag("v").over(in_order(*keys)))
    moved = finite.withColumn("step", step).join(known.select(*keys, "scale"), keys)
    jumped = F.coalesce(F.col("step") > F.greatest(F.col("scale") * 8, F.lit(1e-9)), F.lit(False))
    broken = F.coalesce(F.col("step") > F.greatest(F.col("scale") * 0.02, F.lit(1e-9)), F.lit(True))
    islands = moved.withColumn("island", F.sum(broken.cast("int")).over(in_order(*keys))).groupBy(*keys, "island").agg(F.count("*").alias("run"), F.sum(jumped.cast("int")).alias("jumps"))
    runs = islands.groupBy(*keys).agg(F.max("run").alias("flat_run"), F.sum("jumps").alias("jumps"))
    out = known.join(runs, keys)
    return out.withColumns({
        "peak_to_peak": F.col("p95") - F.col("p05"), "polarity": polarity(F.col("p05"), F.col("p95")),
        "jump_ratio": safe_ratio(F.col("jumps").cast("double"), F.greatest(F.lit(1), F.col("n") - 1).cast("double")), "flat_ratio": F.col("flat_run") / F.col("n"),
    })


REPRESENTED = ("median", "scale", "p05", "p95", "rms", "peak_to_peak", "jump_ratio", "flat_ratio")


def representative(measured: DataFrame) -> DataFrame:
    """Of each track's longest context the median of each measure; polarity of the first window."""
    longest = measured.groupBy("track").agg(F.max("ctx").alias("ctx"))
    rows = measured.join(longest, ["track", "ctx"])
    return rows.groupBy("track", "ctx").agg(F.count("*").alias("windows"), js_round(F.avg("n")).cast("long").alias("n"), *(F.median(c).alias(c) for c in REPRESENTED), F.min_by("polarity", "win").alias("polarity"))


def cohort_flags(rep: DataFrame) -> DataFrame:
    """Representatives with the cohort's medians and three screening flags: suppressed, disconnected, outlying in amplitude."""
    cohort = rep.agg(F.median("scale").alias("cohort_scale"), F.median("rms").alias("cohort_rms"), F.median("peak_to_peak").alias("cohort_peak"))
    out = rep.crossJoin(F.broadcast(cohort))
    ratio = safe_ratio(F.col("peak_to_peak"), F.greatest(F.col("cohort_peak"), F.lit(1e-9)))
    return out.withColumns({"peak_ratio": ratio, "suppressed": (F.col("peak_to_peak") < 10) & (F.col("rms") < 5), "disconnected": (F.col("flat_ratio") >= 0.95) | (1 - F.col("jump_ratio") < 0.5), "outlying": ratio >= 4})


def robust_baseline(samples: DataFrame, size: int, most: int = 4096) -> DataFrame:
    """(track, bucket, n, center, scale): median and MAD of at most ``most`` evenly spaced samples of each bucket; none where the scale vanishes."""
    keyed = samples.withColumns({"bucket": F.floor(F.col("i") / size), "at": F.col("i") % size})
    whole = keyed.groupBy("track", "bucket").agg((F.max("at") + 1).alias("count"))
    # A bucket's k-th pick is round(k (count - 1) / (n - 1)): all samples if there are few, else those that are hit by some k.
    picked = keyed.join(whole, ["track", "bucket"])
    k = js_round(F.col("at") * (most - 1) / F.greatest(F.col("count") - 1, F.lit(1)))
    hit = js_round(k * (F.col("count") - 1) / (most - 1)) == F.col("at")
    picked = picked.where(((F.col("count") <= most) | hit) & is_finite(F.col("v")))
    centre = picked.groupBy("track", "bucket").agg(F.count("*").alias("n"), F.median("v").alias("center"))
    out = picked.join(centre, ["track", "bucket"]).groupBy("track", "bucket", "n", "center").agg((F.median(F.abs(F.col("v") - F.col("center"))) * 1.4826).alias("scale"))
    return out.where((F.col("n") >= 4) & (F.col("scale") > 1e-12))


def zero_cross_hz(samples: DataFrame, fs: float, size: int) -> DataFrame:
    """(track, bin, hz): upward crossings of zero over the bin's duration; the lag starts anew in each bin."""
    keyed = samples.withColumn("bin", F.floor(F.col("i") / size))
    before = F.lag("v").over(in_order("track", "bin"))
    return keyed.withColumn("up", F.coalesce((before <= 0) & (F.col("v") > 0), F.lit(False)).cast("int")).groupBy("track", "bin").agg((F.sum("up") * fs / F.count("*")).alias("hz"))


def moving_mean(samples: DataFrame, k: int) -> DataFrame:
    """v smoothed over k samples on either side, fewer at the edges."""
    return samples.withColumn("smooth", F.avg("v").over(in_order("track").rowsBetween(-k, k)))


def envelope(samples: DataFrame, size: int) -> DataFrame:
    """Of each bin the first, last, least and greatest value and where the extremes stand first."""
    keyed = samples.withColumn("bin", F.floor(F.col("i") / size))
    return keyed.groupBy("track", "bin").agg(F.count("*").alias("n"), F.min_by("v", "i").alias("first"), F.max_by("v", "i").alias("last"), F.min("v").alias("low"), F.max("v").alias("high"), F.min(F.struct("v", "i"))["i"].alias("low_at"), (-F.max(F.struct("v", (-F.col("i")).alias("m")))["m"]).alias("high_at"))


def features(samples: DataFrame, fs: float, size: int, start: float = 0.0, end: float = 30.0) -> DataFrame:
    """(track, window, sample_start, sample_end, mean, rms, line_length, scale) of windows of a region; scale: the region's largest magnitude."""
    first, last = int(-(-start * fs // 1)), int(-(-min(end, start + 30.0) * fs // 1))
    region = samples.where((F.col("i") >= first) & (F.col("i") < last))
    return _features(region.withColumn("window", F.floor((F.col("i") - first) / size)), "track")


def region_features(samples: DataFrame, fs: float, size: int, seconds: float = 30.0) -> DataFrame:
    """features() of all samples: (track, region, window, sample_start, …) by consecutive regions of at most 30 s; windows and scale are each region's own."""
    span = int(-(-min(seconds, 30.0) * fs // 1))
    keyed = samples.withColumn("region", F.floor(F.col("i") / span))
    return _features(keyed.withColumn("window", F.floor((F.col("i") - F.col("region") * span) / size)), "track", "region")


def _features(keyed: DataFrame, *keys: str) -> DataFrame:
    step = F.abs(F.col("v") - F.lag("v").over(in_order(*keys, "window")))
    out = keyed.withColumn("step", F.coalesce(step, F.lit(0.0))).groupBy(*keys, "window").agg(F.min("i").alias("sample_start"), (F.max("i") + 1).alias("sample_end"), F.avg("v").alias("mean"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"), F.sum("step").alias("line_length"), F.max(F.abs("v")).alias("peak"))
    scale = F.greatest(F.max("peak").over(Window.partitionBy(*keys)), F.lit(1e-12))
    return out.withColumn("scale", scale).drop("peak")


def flat_runs(samples: DataFrame, tolerance: float) -> DataFrame:
    """(track, flat_run): the longest run of samples whose steps stay within the tolerance."""
    step = F.abs(F.col("v") - F.lag("v").over(in_order("track")))
    islands = samples.withColumn("island", F.sum(F.coalesce(step > tolerance, F.lit(True)).cast("int")).over(in_order("track")))
    return islands.groupBy("track", "island").agg(F.count("*").alias("run")).groupBy("track").agg(F.max("run").alias("flat_run"))


def local_peaks(samples: DataFrame, centre: Column, least: Column) -> DataFrame:
    """Samples as far from the centre as both neighbours or farther, and at least ``least``."""
    w = in_order("track")
    far = F.abs(F.col("v") - centre)
    rows = samples.withColumns({"far": far, "p": F.lag(far).over(w), "q": F.lead(far).over(w)})
    return rows.where((F.col("far") >= least) & (F.col("far") >= F.col("p")) & (F.col("far") >= F.col("q"))).drop("p", "q")


def nearest_crossings(samples: DataFrame, centre: float, reach: int) -> DataFrame:
    """samples with left and right: the nearest index where the signal meets the centre, within reach on either side; null if none."""
    w = in_order("track")
    d, before = F.col("v") - centre, F.lag(F.col("v") - centre).over(w)
    rows = samples.withColumn("crossed", F.when((d * before <= 0) | (d == 0), F.col("i")))
    return rows.withColumns({"left": F.last("crossed", ignorenulls=True).over(w.rowsBetween(-reach, 0)), "right": F.first("crossed", ignorenulls=True).over(w.rowsBetween(1, reach))}).drop("crossed")


def after_going(samples: DataFrame, centre: float, scale: float, fs: float) -> DataFrame:
    """samples with after_going: whether the signal swings to the other side by two scales 70 to 500 ms later."""
    w = in_order("track").rowsBetween(int(0.07 * fs + 0.5), int(0.5 * fs + 0.5))
    d = F.col("v") - centre
    return samples.withColumn("after_going", F.coalesce(F.when(d < 0, F.max(d).over(w)).otherwise(F.max(-d).over(w)) >= 2 * scale, F.lit(False)))


def epochs(samples: DataFrame, size: int, stride: int) -> DataFrame:
    """(track, i, epoch, scaled): every stride-th sample of an epoch, scaled to 1..40 by the epoch's extremes; 20.5 where it is flat."""
    keyed = samples.withColumn("epoch", F.floor(F.col("i") / size))
    bounds = keyed.groupBy("track", "epoch").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    picked = keyed.where((F.col("i") % size) % stride == 0).join(bounds, ["track", "epoch"])
    span = F.col("high") - F.col("low")
    return picked.select("track", "i", "epoch", F.when(span > 1e-12, 1 + 39 * (F.col("v") - F.col("low")) / span).otherwise(20.5).alias("scaled"))
