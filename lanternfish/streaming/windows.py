"""Event-time windows and a stateful refractory rule over streams of samples or events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feature_windows(stream: DataFrame, seconds: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """(track, start, end, n, mean, rms, low, high) of tumbling windows of stream(track, ts, v); rows later than the watermark are dropped."""
    w = F.window("ts", seconds)
    out = stream.withWatermark("ts", late).groupBy("track", w.alias("w")).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"), F.min("v").alias("low"), F.max("v").alias("high"))
    return out.select("track", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "rms", "low", "high")


def sliding_windows(stream: DataFrame, seconds: str = "6 seconds", hop: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    out = stream.withWatermark("ts", late).groupBy("track", F.window("ts", seconds, hop).alias("w")).agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    return out.select("track", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean")


def refractory(stream: DataFrame, seconds: float = 0.2) -> DataFrame:
    """Of stream(track, peak, score) in arrival order, what the batch fold keeps: state is the last kept event of a track.

    An event is final when a later one lies beyond the refractory time; until then a higher score takes its place.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        out = []
        for peak, score in pd.concat(batches).sort_values(["peak", "score"], ascending=[True, False])[["peak", "score"]].itertuples(index=False):
            if last is None or peak - last[0] >= seconds:
                if last is not None:
                    out.append((*key, *last))
                last = (float(peak), float(score))
            elif score > last[1]:
                last = (float(peak), float(score))
        state.update(last)
        yield pd.DataFrame(out, columns=["track", "peak", "score"])

    return stream.groupBy("track").applyInPandasWithState(fold, "track string, peak double, score double", "peak double, score double", "append", "NoTimeout")
