"""Taps of a live recording: spikes joined to the playback clock as both streams arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.operators.playback import REACH, TAP, level


def taps(spikes: DataFrame, clock: DataFrame, late: str = "10 seconds", reach: int = REACH, tap: int = TAP) -> DataFrame:
    """(track, tick, spike, lag, level) of streams spikes(track, spike) and clock(tick), both of timestamps: playback.taps, live.

    An interval join within buckets of the reach, over which the state is spread: a tick meets the spikes of at most the reach before it, so a spike is dropped when the clock's watermark has
    passed it by the reach, and a tick when the spikes' watermark has passed it. Ticks and spikes later than ``late`` are
    dropped; a tick's earliest spike is final, and its row comes, when the watermark passes the tick.
    """
    bucket = F.floor(F.unix_micros("spike") / reach)
    s = spikes.select("track", "spike", F.explode(F.array(bucket, bucket + 1)).alias("_s")).withWatermark("spike", late)
    c = clock.select("tick", F.floor(F.unix_micros("tick") / reach).alias("_c")).withWatermark("tick", late)
    within = F.expr(f"_s = _c and tick >= spike and tick <= spike + interval {reach} microseconds")
    # A window of one microsecond is the tick itself, in the form that lets the aggregate's state go with the watermark.
    first = s.join(c, within).groupBy("track", F.window("tick", "1 microsecond").alias("w")).agg(F.min("spike").alias("spike"))
    out = first.select("track", F.col("w.start").alias("tick"), "spike")
    lag = F.timestamp_diff("MICROSECOND", F.col("spike"), F.col("tick"))
    return out.withColumn("lag", lag).where(F.col("lag") < tap).withColumn("level", level(F.col("lag")))
