"""Spikes on the playback clock: which tap sounds at each tick of a recording that is played.

A tick looks at the earliest spike of a track that is no older than the cursor's
reach; it taps if that spike has begun and is younger than the tap's length, and
fades from the spike on. So a spike hides the next one until it is out of reach.
Times are whole microseconds, so that no window's edge depends on rounding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How far back the cursor looks and how long a tap is, in microseconds, and the tap's decay a second.
REACH, TAP, DECAY = 50_000, 45_000, 55.0


def micros(seconds: Column) -> Column:
    return F.round(seconds * 1e6).cast("long")


def level(lag: Column) -> Column:
    """The tap's level after so many microseconds."""
    return F.exp(lag / 1e6 * -DECAY)


def played(ticks: DataFrame, start: float = 0.0, speed: float = 1.0) -> DataFrame:
    """ticks(at, microseconds of playback) with eeg, the recording's time then."""
    return ticks.withColumn("eeg", F.lit(round(start * 1e6)).cast("long") + F.floor(F.col("at") * speed).cast("long"))


def taps(spikes: DataFrame, ticks: DataFrame, reach: int = REACH, tap: int = TAP) -> DataFrame:
    """(track, eeg, spike, lag, level) of spikes(track, spike) at ticks(eeg): one row where a track taps at a tick.

    Both sides meet in buckets of the reach: a tick in its own, a spike in its own and the next one. A tick within the reach
    after a spike, or just before the earliest spike ahead, is in one of them; what lies ahead never taps.
    """
    bucket = F.floor(F.col("spike") / reach)
    near = spikes.select("track", "spike", F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
    clock = ticks.select("eeg", F.floor(F.col("eeg") / reach).alias("bucket"))
    lag = F.col("eeg") - F.col("spike")
    first = near.join(clock, "bucket").where((lag >= 0) & (lag <= reach)).groupBy("track", "eeg").agg(F.min("spike").alias("spike"))
    return first.withColumn("lag", lag).where(F.col("lag") < tap).withColumn("level", level(F.col("lag")))
