"""Spectra of tracks: band powers, peaks, spectrograms and hemispheric summaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternfish.operators.dsp import decimated, single

#: Screening bands in Hz.
BANDS = {"delta": (1, 4), "theta": (4, 8), "alpha": (8, 13), "beta": (13, 30), "gamma": (30, 80)}
DFT_SAMPLES = 512
PEAK_SAMPLES = 1024


def power_spectrum(x: np.ndarray, fs: float, most: int = DFT_SAMPLES) -> tuple[np.ndarray, np.ndarray, float]:
    """(hz, power, effective rate) of at most ``most`` decimated samples less their mean, bins 1 to n / 2; power over n squared.

    Decimation lowers the effective rate, so bands beyond half of it hold nothing. most=0 keeps all samples.
    """
    data = decimated(x, most) if most else x
    n = len(data)
    rate = fs * n / len(x)
    spectrum = np.fft.rfft(data - data.mean())[1 : n // 2 + 1]
    return np.arange(1, n // 2 + 1) * rate / n, np.abs(spectrum) ** 2 / n**2, rate


def band_power(spectrum: tuple[np.ndarray, np.ndarray, float], low: float, high: float) -> float:
    hz, power, rate = spectrum
    upper = min(high, rate / 2)
    return float(power[(hz >= low) & (hz < upper)].sum()) if upper > low else 0.0


def band_powers(x: np.ndarray, fs: float, most: int = DFT_SAMPLES) -> dict[str, float]:
    if len(x) < 4 or fs <= 0:
        return dict.fromkeys(BANDS, 0.0)
    spectrum = power_spectrum(x, fs, most)
    return {b: band_power(spectrum, *edges) for b, edges in BANDS.items()}


def peak(x: np.ndarray, fs: float, low: float, high: float) -> dict | None:
    """The strongest bin of a Hann-tapered, decimated spectrum in a band: its frequency, the share of power near it, the
    signal's correlation with itself one cycle later, and cycles."""
    if len(x) < 32 or fs <= 0 or high <= low:
        return None
    data = decimated(x, PEAK_SAMPLES)
    n = len(data)
    rate = fs * n / len(x)
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / max(1, n - 1))
    hz = np.arange(1, n // 2 + 1) * rate / n
    power = np.abs(np.fft.rfft((data - data.mean()) * taper)[1 : n // 2 + 1]) ** 2
    seen = (hz >= max(0.5, low / 2)) & (hz <= min(rate / 2, max(40, high)))
    hz, power = hz[seen], power[seen]
    total = power[(hz >= 0.5) & (hz <= 40)].sum()
    inside = (hz >= low) & (hz <= high)
    if not inside.any() or total <= 1e-12:
        return None
    at = np.flatnonzero(inside)[power[inside].argmax()]
    f = float(hz[at])
    near = power[np.abs(hz - f) <= max(0.5, f * 0.12)].sum()
    lag = max(1, int(fs / f + 0.5))
    d = x - x.mean()
    base = (d[:-lag] ** 2).sum() if lag < len(d) else 0.0
    own = float((d[:-lag] * d[lag:]).sum() / base) if base > 0 else 0.0
    return {"hz": f, "concentration": float(min(1.0, near / total)), "autocorrelation": max(-1.0, min(1.0, own)), "cycles": len(x) / fs * f}


def power_of_two(n: int) -> int:
    return 1 << max(1, int(n - 1).bit_length())


def spectrogram(x: np.ndarray, fs: float, win: int, hop: int, top: float) -> np.ndarray:
    """(time, frequency) one-sided power density of detrended, Hann-tapered frames; short tracks give one padded frame."""
    count = max(1, max(0, len(x) - win) // max(1, hop) + 1)
    padded = np.concatenate([x, np.zeros(max(0, (count - 1) * hop + win - len(x)))])
    return frame_powers(np.lib.stride_tricks.sliding_window_view(padded, win)[:: max(1, hop)][:count], fs, top)


def frame_powers(frames: np.ndarray, fs: float, top: float) -> np.ndarray:
    """(frame, frequency) power density of frames of samples, a frame a row."""
    count, win = frames.shape
    n = power_of_two(win)
    bins = max(2, int(top * n / fs) + 1)
    at = np.arange(win) - (win - 1) / 2
    level = frames.mean(axis=1, keepdims=True)
    slope = (frames - level) @ at / max(1.0, (at * at).sum())
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(win) / max(1, win - 1))
    power = np.abs(np.fft.rfft(single((frames - level - slope[:, None] * at) * taper), n)) ** 2
    power = power[:, : n // 2]  # the bin at half the rate isn't used
    power[:, 1:-1] *= 2
    out = np.zeros((count, bins))
    out[:, : min(bins, power.shape[1])] = power[:, :bins]
    return single(out / max(1e-12, fs * (taper**2).sum()))


#: Samples of a piece of a track, and frames that a worker transforms at once.
PIECE, AT_ONCE = 4096, 256


def pieces(samples: DataFrame) -> DataFrame:
    """(track, piece, n): how many of samples(track, i, v) each piece of a track holds; a row for PIECE samples."""
    return samples.groupBy("track", F.floor(F.col("i") / PIECE).alias("piece")).agg(F.count("*").alias("n"))


def framed(tracks: DataFrame, counted: DataFrame) -> DataFrame:
    """tracks(track, fs, …) that have samples, with n, win, hop and frames: windows of about two seconds in 256 to 1024 samples, at most 1400 frames."""
    wide = F.floor(F.col("fs") * 2 + 0.5)
    plan = tracks.join(counted.groupBy("track").agg(F.sum("n").alias("n")), "track")
    plan = plan.withColumn("win", F.when(wide <= 256, 256).when(wide <= 512, 512).otherwise(1024).cast("long"))
    rest = F.greatest(F.lit(0), F.col("n") - F.col("win"))
    quarter = F.floor(F.col("win") / 4)
    plan = plan.withColumn("hop", F.when(F.floor(rest / quarter) + 1 > 1400, F.greatest(quarter, F.ceil(rest / 1399))).otherwise(quarter))
    return plan.withColumn("frames", F.floor(rest / F.col("hop")) + 1)


def spectra(samples: DataFrame, counted: DataFrame, plan: DataFrame, top: float = 45.0) -> DataFrame:
    """(track, side, t, f, hz, power) of the tracks of a plan (framed(), with laterality) from samples(track, i, v) and its pieces().

    Samples are put in order by pieces, and each frame is put together from the stretches that pieces have of it. So no
    task or worker holds a track, and the frames of a track are at most 1400 whatever its length.
    """
    begin = F.coalesce(F.sum("n").over(Window.partitionBy("track").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counted.select("track", "piece", begin.alias("begin"))
    use = F.broadcast(plan.select("track", F.col("laterality").alias("side"), "fs", "win", "hop", "frames"))
    keyed = samples.join(F.broadcast(plan.select("track")), "track", "left_semi").withColumn("piece", F.floor(F.col("i") / PIECE))
    held = keyed.groupBy("track", "piece").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda r: r["v"]).alias("v"))
    own = held.join(placed, ["track", "piece"]).join(use, "track")
    first = F.greatest(F.lit(0), F.ceil((F.col("begin") - F.col("win") + 1) / F.col("hop")))
    last = F.least(F.col("frames") - 1, F.floor((F.col("begin") + F.size("v") - 1) / F.col("hop")))
    met = own.withColumns({"first": first, "last": last}).where("first <= last").withColumn("t", F.explode(F.sequence("first", "last")))
    at = F.col("t") * F.col("hop") - F.col("begin")
    a, b = F.greatest(F.lit(0), at), F.least(F.size("v"), at + F.col("win"))
    stretch = F.struct("begin", F.slice("v", (a + 1).cast("int"), (b - a).cast("int")).alias("v"))
    frames = met.groupBy("track", "side", "fs", "win", "t").agg(F.flatten(F.transform(F.array_sort(F.collect_list(stretch)), lambda r: r["v"])).alias("v"))

    def work(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(k, AT_ONCE)
                made: list = [None] * part.num_rows
                rates = list(zip(part.column("fs").to_pylist(), part.column("win").to_pylist(), strict=True))
                for fs, win in set(rates):
                    rows = [r for r, x in enumerate(rates) if x == (fs, win)]
                    x = np.zeros((len(rows), win))
                    for k_, r in enumerate(rows):
                        v = part.column("v")[r].values.to_numpy(zero_copy_only=False)
                        x[k_, : len(v)] = v
                    for r, p in zip(rows, frame_powers(x, fs, top), strict=True):
                        made[r] = p.astype(np.float64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("track", "side", "fs", "win", "t")), pa.array(made, pa.list_(pa.float64()))], ["track", "side", "fs", "win", "t", "power"])

    schema = T.StructType([*(frames.schema[c] for c in ("track", "side", "fs", "win", "t")), T.StructField("power", T.ArrayType(T.DoubleType()))])
    long = frames.mapInArrow(work, schema).select("track", "side", "t", "fs", "win", F.posexplode("power").alias("f", "power"))
    return long.select("track", "side", "t", F.col("f").cast("long").alias("f"), (F.col("f") * F.col("fs") / F.col("win")).alias("hz"), "power")


def chosen_for_summary(tracks: DataFrame, limit: int = 8) -> DataFrame:
    """At most ``limit`` tracks of each side, evenly spaced in order."""
    ranked = tracks.withColumns({"_k": F.row_number().over(Window.partitionBy("laterality").orderBy("ord")) - 1, "_n": F.count("*").over(Window.partitionBy("laterality"))})
    picks = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / (limit - 1)))
    return ranked.where((F.col("_n") <= limit) | F.array_contains(picks, F.col("_k").cast("long"))).drop("_k", "_n")


def hemispheres(long: DataFrame, plan: DataFrame) -> DataFrame:
    """(side, t, f, hz, power): the generalised mean over a plan's tracks; times that some track of a side lacks go; a side without tracks copies the other.

    Which sides and times there are is known from the plan, a row a track, so spectra are made once.
    """
    from lanternfish.operators.aggregates import generalised_mean

    ends = plan.where("laterality in ('left', 'right')").groupBy(F.col("laterality").alias("side")).agg((F.min("frames") - 1).alias("m"))
    ends = ends.withColumn("alone", F.count("*").over(Window.partitionBy(F.lit(0))) == 1)  # two rows at most
    met = long.join(F.broadcast(ends), "side").where("t <= m")
    out = met.groupBy("side", "t", "f", "alone").agg(F.max("hz").alias("hz"), generalised_mean(F.greatest(F.col("power"), F.lit(0.0))).alias("power"))
    sides = F.when(F.col("alone"), F.array(F.lit("left"), F.lit("right"))).otherwise(F.array("side"))
    return out.select(F.explode(sides).alias("side"), "t", "f", "hz", "power")


def decibel_range(out: DataFrame, most: int = 4000) -> DataFrame:
    """(db_min, db_max): of about ``most`` evenly spaced cells the values at 5 and 98 in 100 by floor index, 12 to 54 dB apart."""
    from lanternfish.functions.scalars import decibels

    size = out.agg(F.greatest(F.lit(1), F.floor(F.count("*") / most)).alias("step"), (F.max("f") + 1).alias("width"))
    cells = out.crossJoin(F.broadcast(size)).where((F.col("t") * F.col("width") + F.col("f")) % F.col("step") == 0)
    held = cells.agg(F.array_sort(F.collect_list(decibels(F.col("power")))).alias("v"))  # most or so values
    at = lambda p: F.element_at("v", (F.floor(F.size("v") * p) + 1).cast("int"))
    return held.select(F.least(at(0.98) - 12, F.greatest(at(0.98) - 54, at(0.05))).alias("db_min"), at(0.98).alias("db_max"))


def column_bands(out: DataFrame) -> DataFrame:
    """(side, t, delta … gamma, peak_hz, total) of each frame: shares of power by band from bin 1 on, the strongest bin."""
    edges = [("delta", 0, 4), ("theta", 4, 8), ("alpha", 8, 13), ("beta", 13, 30), ("gamma", 30, 1e9)]
    used = out.where("f > 0")
    total = F.sum("power")
    shares = [F.when(total > 0, F.sum(F.when((F.col("hz") >= a) & (F.col("hz") < b), F.col("power")).otherwise(0.0)) / total).otherwise(0.0).alias(n) for n, a, b in edges]
    return used.groupBy("side", "t").agg(total.alias("total"), *shares, F.max(F.struct("power", (-F.col("f")).alias("m"), "hz"))["hz"].alias("peak_hz"))


def frame_at(t, win_seconds: float, hop_seconds: float, frames: int):
    """The frame that a time belongs to: from the middle of the first window on, clamped."""
    return F.least(F.lit(frames - 1), F.greatest(F.lit(0), F.floor((F.greatest(t, F.lit(0.0)) - win_seconds / 2) / max(1e-6, hop_seconds))))


def regridded(frames: DataFrame, times: int, bins: int) -> DataFrame:
    """frames(side, t, power array) on a grid of times x bins: the nearest bin by share of the range, the last frame for times past it.

    A frame's bins are picked by place within its array; frames meet their times by an equi-join on the frame that each takes.
    """
    last = frames.groupBy("side").agg(F.max("t").alias("_last"))
    grid = last.select("side", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long"))).alias("_t"), "_last").select("side", "_t", F.least("_last", "_t").alias("t"))
    # Bins by the rounding of JavaScript: halves go up. The frame stands in a struct, so that it is made once, not for each bin.
    at = lambda n, f: F.least(n - 1, F.floor(f / max(1, bins - 1) * (n - 1) + 0.5)).cast("int")
    held = F.array(F.struct(F.col("power").alias("p")))
    power = F.transform(held, lambda h: F.when(F.size(h["p"]) == bins, h["p"]).otherwise(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda f: F.get(h["p"], at(F.size(h["p"]), f)))))[0]
    return grid.join(frames.select("side", "t", power.alias("power")), ["side", "t"]).select("side", F.col("_t").alias("t"), "power")
