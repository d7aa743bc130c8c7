"""Aggregates with the reference's own rules for medians, percentiles and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def floor_percentile(x: Column, p: float) -> Column:
    """The sorted value at floor(p (n - 1)): no interpolation. Buffers a group's values."""
    values = F.array_sort(F.collect_list(x))
    return F.element_at(values, (F.floor(F.lit(p) * (F.size(values) - 1)) + 1).cast("int"))


def upper_median(x: Column) -> Column:
    values = F.array_sort(F.collect_list(x))
    return F.element_at(values, (F.floor(F.size(values) / 2) + 1).cast("int"))


def percentile_abs(x: Column, p: float) -> Column:
    """Of magnitudes; 1 for an empty or vanishing group."""
    at = floor_percentile(F.abs(x), p)
    return F.coalesce(F.when(at > 1e-12, at), F.lit(1.0))


def robust_scale(samples: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, center, scale) of 16 values or more: MAD, or a tenth of the largest deviation where most values are one."""
    centre = samples.groupBy(*keys).agg(F.count("v").alias("n"), F.median("v").alias("center")).where(F.col("n") >= 16)
    d = F.abs(F.col("v") - F.col("center"))
    out = samples.join(centre, list(keys)).groupBy(*keys, "n", "center").agg((F.median(d) * 1.4826).alias("mad"), F.max(d).alias("most"))
    scale = F.when(F.col("mad") > 1e-9, F.col("mad")).otherwise(F.col("most") / 10)
    return out.select(*keys, "n", "center", scale.alias("scale")).where(F.col("scale") > 1e-9)


def correlation(a: Column, b: Column) -> Column:
    """Pearson's; 0 for fewer than four pairs or a constant side."""
    enough = (F.count("*") >= 4) & (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0)
    return F.when(enough, F.corr(a, b)).otherwise(0.0)


def excess_kurtosis(x: Column) -> Column:
    return F.when((F.count(x) >= 8) & (F.stddev_pop(x) > 0), F.kurtosis(x)).otherwise(0.0)


def generalised_mean(x: Column, power: float = 1.35) -> Column:
    return F.pow(F.avg(F.pow(x, power)), 1 / power)


def dc_offsets(samples: DataFrame) -> DataFrame:
    """(track, offset): the mean over the whole recording."""
    return samples.groupBy("track").agg(F.avg("v").alias("offset"))


def without_dc(samples: DataFrame) -> DataFrame:
    """samples less their track's mean; the means are one row a track."""
    return samples.join(dc_offsets(samples), "track").select("track", "i", (F.col("v") - F.col("offset")).alias("v"))


def interval_stats(events: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, interval, cv) of event times t: the median gap and the gaps' spread around their mean over it."""
    from pyspark.sql import Window

    gap = F.col("t") - F.lag("t").over(Window.partitionBy(*keys).orderBy("t", "id"))
    out = events.withColumn("gap", gap).groupBy(*keys).agg(F.count("gap").alias("n"), F.median("gap").alias("interval"), F.stddev_pop("gap").alias("sd"))
    return out.select(*keys, "n", "interval", F.when(F.col("interval") > 0, F.col("sd") / F.col("interval")).alias("cv"))
