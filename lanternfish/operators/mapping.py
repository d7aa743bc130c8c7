"""Feature windows to tone events, styles and sampled sound, with what each was derived from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfish.functions.scalars import equal_power, pentatonic_hz, scale_offset, velocity
from lanternfish.operators.windows import epochs

#: Fixed value: the loudest sample.
CEILING = 0.89
STYLES = ("plain-v1", "soft-v1", "pentatonic-v1", "loui-neutral-v1", "loui-soft-v1")


def mapped(features: DataFrame, mapping: str = "contour-v1", gain: Column | None = None, pan: Column | None = None) -> DataFrame:
    """features(track, window, mean, rms, scale, …) with hz, amplitude, pan and wave."""
    if mapping not in ("contour-v1", "rms-pulse-v1"):
        raise ValueError(f"unknown mapping {mapping}")
    contour = mapping == "contour-v1"
    size = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("rms") / F.col("scale")))
    signed = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("mean") / F.col("scale")))
    hz = F.lit(420.0) * F.pow(F.lit(2.0), signed) if contour else F.lit(130.0) + 520.0 * size
    amplitude = (0.07 + size * 0.23) if contour else (0.05 + size * 0.28)
    gain = F.lit(1.0) if gain is None else F.least(F.lit(4.0), F.greatest(F.lit(0.0), gain))
    pan = F.lit(0.0) if pan is None else F.least(F.lit(1.0), F.greatest(F.lit(-1.0), pan))
    return features.withColumns({"hz": hz, "amplitude": amplitude * gain, "pan": pan, "wave": F.lit("sine" if contour else "pulse"), "mapping": F.lit(mapping)})


def styled(events: DataFrame, style: str) -> DataFrame:
    """events with a style applied and changes: what it altered."""
    if style not in STYLES:
        raise ValueError(f"unknown style {style}")
    told = {"plain-v1": ["no acoustic parameters changed"], "loui-neutral-v1": ["no downstream style applied"], "pentatonic-v1": ["frequency quantized to C-major pentatonic"], "soft-v1": ["amplitude × 0.72", "waveform → sine"], "loui-soft-v1": ["amplitude × 0.72", "soft second harmonic added; mapped pitch unchanged"]}[style]
    out = events.withColumn("changes", F.array(*map(F.lit, told)))
    if style == "pentatonic-v1":
        out = out.withColumn("hz", pentatonic_hz(F.col("hz")))
    if style in ("soft-v1", "loui-soft-v1"):
        out = out.withColumns({"amplitude": F.col("amplitude") * 0.72, "wave": F.lit("sine" if style == "soft-v1" else "soft-sine")})
    return out


def scale_events(samples: DataFrame, size: int = 2560, stride: int = 20) -> DataFrame:
    """(track, i, epoch, offset, velocity): samples at 256 Hz as pentatonic offsets by ten-second epochs, with a loudness from the index."""
    picked = epochs(samples, size, stride)
    return picked.select("track", "i", "epoch", scale_offset(F.col("scaled")).alias("offset"), velocity(F.col("i")).alias("velocity"))


def rendered(events: DataFrame, rate: int, start: float = 0.0, end: float = 30.0) -> DataFrame:
    """(i, left, right): events(start, end, hz, amplitude, pan, wave) as sound, each a tone under half a sine, summed and kept under 0.89."""
    mixed = _mixed(events.withColumns({"start": F.col("start") - start, "end": F.col("end") - start}), rate, end - start, "i")
    peak = mixed.agg(F.coalesce(F.max(F.greatest(F.abs("left"), F.abs("right"))), F.lit(0.0)).alias("peak"))
    return _limited(mixed.crossJoin(F.broadcast(peak)), "i")


def rendered_regions(events: DataFrame, rate: int, seconds: float = 30.0) -> DataFrame:
    """(region, i, left, right): rendered() of each region's events, with i and the peak its own.

    Events are dealt by region to a number of tasks that adaptive execution keeps, as they are few bytes next to their sound.
    A task adds up one region after the other in two arrays, and its at most 30 s bound what the task holds, however many
    regions it gets.
    """
    seconds = min(seconds, 30.0)
    at = {x: F.col(x) - F.col("region") * seconds for x in ("start", "end")}
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    gl, gr = equal_power(F.col("pan"))
    sounding = _placed(events.withColumns(at), rate, seconds).select("region", "a", "b", "hz", (gl * F.col("amplitude")).alias("gl"), (gr * F.col("amplitude")).alias("gr"), "wave")
    length = int(-(-seconds * rate // 1))

    def work(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, heard, sound = np.zeros(length, bool), np.zeros(length, bool), np.zeros((2, length))
        for batch in batches:
            for a, b, hz, left, right, wave in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "hz", "gl", "gr", "wave")), strict=True):
                held[a:b] = True
                if hz is None or left is None or right is None:  # no sound, as a sum passes over nulls
                    continue
                heard[a:b] = True
                shaped = _tone(hz, wave, b - a, rate)
                sound[0, a:b] += shaped * left
                sound[1, a:b] += shaped * right
        peak = np.abs(sound).max(initial=0.0)
        if not peak <= CEILING:
            sound *= CEILING / peak
        i = np.flatnonzero(held)
        for k in range(0, len(i), 65_536):
            own = i[k : k + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(own), pa.int64()), pa.array(own, pa.int64()), *(pa.array(x[own], pa.float64(), mask=~heard[own]) for x in sound)], ["region", "i", "left", "right"])

    return sounding.repartition(parts, "region").groupBy("region").applyInArrow(work, "region long, i long, left double, right double")


def _tone(hz: float, wave: str | None, n: int, rate: int) -> np.ndarray:
    """n samples of a tone under half a sine, as _mixed() makes it."""
    k = np.arange(n)
    phase = 2 * np.pi * hz * (k / rate)
    tone = np.sin(phase)
    if wave == "pulse":
        tone = np.where(tone >= 0, 1.0, -1.0)
    elif wave == "soft-sine":
        tone += 0.18 * np.sin(phase * 2)
    return tone * np.sin(np.pi * k / max(1, n - 1))


def _placed(events: DataFrame, rate: int, seconds: float) -> DataFrame:
    """events with a and b, the first sample and the one after the last between 0 and seconds; those without any go."""
    length = int(-(-seconds * rate // 1))
    return events.withColumns({"a": F.greatest(F.lit(0), F.floor(F.col("start") * rate)), "b": F.least(F.lit(length), F.ceil(F.col("end") * rate))}).where("a < b")


def _mixed(events: DataFrame, rate: int, seconds: float, *keys: str) -> DataFrame:
    """(*keys, left, right): the sum of tones from 0 to seconds."""
    at = _placed(events, rate, seconds)
    tones = at.withColumn("i", F.explode(F.sequence(F.col("a"), F.col("b") - 1)))
    k = F.col("i") - F.col("a")
    phase = 2 * F.pi() * F.col("hz") * (k / rate)
    tone = F.when(F.col("wave") == "pulse", F.when(F.sin(phase) >= 0, 1.0).otherwise(-1.0)).when(F.col("wave") == "soft-sine", F.sin(phase) + 0.18 * F.sin(phase * 2)).otherwise(F.sin(phase))
    sound = tone * F.sin(F.pi() * k / F.greatest(F.lit(1), F.col("b") - F.col("a") - 1)) * F.col("amplitude")
    gl, gr = equal_power(F.col("pan"))
    return tones.groupBy(*keys).agg(F.sum(sound * gl).alias("left"), F.sum(sound * gr).alias("right"))


def _limited(mixed: DataFrame, *keys: str) -> DataFrame:
    gain = F.when(F.col("peak") > CEILING, F.lit(CEILING) / F.col("peak")).otherwise(1.0)
    return mixed.select(*keys, (F.col("left") * gain).alias("left"), (F.col("right") * gain).alias("right"))
