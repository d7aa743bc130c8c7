"""A pyramid of extremes over samples, so that any viewport's columns are read from a few of its bins.

Level 0 holds bins of ``base`` samples, each level above pairs of bins of the one
below. Several levels are built by one aggregation, from rows of the lowest of them,
so that a build moves each sample's bin once. A pixel column that covers samples
[a, b) is then the union of aligned bins, at most two of each level, and of fewer
than two bases of samples at its edges: what is read grows with the pixels, not with
the samples under them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfish.operators.display import View

#: Levels that one aggregation builds, and samples of a bin of level 0.
AT_ONCE, BASE = 6, 16
STATE = ("n", "start", "first", "stop", "last", "low", "low_at", "high", "high_at")


def _merged() -> list[Column]:
    """STATE of a group of rows that have it: the first extreme of equal ones counts."""
    low, high = F.min(F.struct("low", "low_at")), F.max(F.struct("high", (-F.col("high_at")).alias("m")))
    return [F.sum("n").alias("n"), F.min("start").alias("start"), F.min_by("first", "start").alias("first"), F.max("stop").alias("stop"), F.max_by("last", "stop").alias("last"), low["low"].alias("low"), low["low_at"].alias("low_at"), high["high"].alias("high"), (-high["m"]).alias("high_at")]


def _single(samples: DataFrame, *more: str) -> DataFrame:
    """Samples as bins of one."""
    i, v = F.col("i"), F.col("v")
    return samples.select("track", *more, F.lit(1).cast("long").alias("n"), *(x.alias(c) for c, x in zip(STATE[1:], (i, v, i, v, v, i, v, i), strict=True)))


def build(samples: DataFrame, base: int = BASE) -> DataFrame:
    """(track, level, bin, n, start, first, stop, last, low, low_at, high, high_at) of samples(track, i, v), up to the level of one bin."""
    last = samples.agg(F.max("i")).first()[0]
    bins = _single(samples, "i").withColumn("bin", F.floor(F.col("i") / base)).groupBy("track", "bin").agg(*_merged())
    out = below = bins.withColumn("level", F.lit(0))
    top = max(0, (int(last or 0) // base).bit_length())
    for done in range(0, top, AT_ONCE):
        levels = F.explode(F.sequence(F.lit(1), F.lit(min(AT_ONCE, top - done))))
        made = below.drop("level").withColumn("up", levels).withColumn("bin", F.expr("shiftright(bin, up)")).groupBy("track", "up", "bin").agg(*_merged())
        made = made.withColumn("level", F.col("up") + done).drop("up")
        out = out.unionByName(made)
        below = made.where(F.col("level") == done + AT_ONCE)
    return out.select("track", "level", "bin", *STATE)


def spans(fs: float, view: View, pixels: int, total: int) -> list[tuple[int, int, int]]:
    """(pixel, a, b): the samples that each pixel covers, one at least, within the track's total; pixels past the end are left out."""
    edge = lambda k: int((view.start + k / pixels * view.seconds) * fs // 1)
    cut = [(p, max(0, edge(p)), min(total, edge(p + 1))) for p in range(pixels)]
    return [(p, a, min(total, max(b, a + 1))) for p, a, b in cut if a < total]


def cover(a: int, b: int, base: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """[a, b) as aligned bins (level, bin) and as runs of samples [x, y) at its edges."""
    first, last = -(-a // base), b // base
    if first >= last:
        return [], [(a, b)]
    runs = [(x, y) for x, y in ((a, first * base), (last * base, b)) if x < y]
    nodes, level = [], 0
    while first < last:
        if first & 1:
            nodes.append((level, first))
            first += 1
        if last & 1:
            last -= 1
            nodes.append((level, last))
        first, last, level = first >> 1, last >> 1, level + 1
    return nodes, runs


def columns(pyramid: DataFrame, samples: DataFrame, fs: float, view: View, pixels: int, total: int, base: int = BASE) -> DataFrame:
    """(track, pixel, n, start, first, stop, last, low, low_at, high, high_at) of a viewport of tracks of total samples.

    The lists of bins and edge samples have some tens of entries a pixel, whatever the tracks' length, and filter the scans.
    """
    spark = pyramid.sparkSession
    nodes, edges = [], []
    for p, a, b in spans(fs, view, pixels, total):
        own, runs = cover(a, b, base)
        nodes += [(p, level, bin_) for level, bin_ in own]
        edges += [(p, i) for x, y in runs for i in range(x, y)]
    bins = spark.createDataFrame(nodes, "pixel int, level int, bin long")
    ends = spark.createDataFrame(edges, "pixel int, i long")
    span = lambda rows, k: (min((r[k] for r in rows), default=0), max((r[k] for r in rows), default=-1))
    # Ranges that a scan can use; the join picks the rows.
    coarse = pyramid.where(F.col("level").between(*span(nodes, 1)))
    fine = samples.where(F.col("i").between(*span(edges, 1)))
    upper = coarse.join(F.broadcast(bins), ["level", "bin"]).select("track", "pixel", *STATE)
    lower = _single(fine.join(F.broadcast(ends), "i"), "pixel")
    return upper.unionByName(lower).groupBy("track", "pixel").agg(*_merged())


def geometry(cols: DataFrame, pixels: int, width: float) -> DataFrame:
    """columns() with the places that a plot of this width needs.

    x, x1: the column's edges; low_x, high_x: where its extremes lie between them, by their samples' places; low_from, high_from:
    the line from the first value to the last one there, from which a whisker goes to the extreme (null where it lies on it).
    """
    step = width / pixels if width > 0 else 0.0
    x = F.col("pixel") * F.lit(step)
    share = lambda at: (F.col(at) - F.col("start")) / F.greatest(F.lit(1), F.col("stop") - F.col("start"))
    on_line = lambda at: F.col("first") + (F.col("last") - F.col("first")) * (share(at) if step else F.lit(0.0))
    out = cols.withColumns({"x": x, "x1": x + step, "low_x": x + share("low_at") * step, "high_x": x + share("high_at") * step})
    whisker = lambda c: F.when(F.abs(F.col(c) - on_line(f"{c}_at")) > 1e-7, on_line(f"{c}_at"))
    return out.withColumns({"low_from": whisker("low"), "high_from": whisker("high")})


def ordered_points(shaped: DataFrame) -> DataFrame:
    """(track, pixel, k, x, value): the polyline of each column, first value, extremes in their samples' order, last value."""
    point = lambda px, value: F.struct(F.col(px).alias("x"), F.col(value).alias("value"))
    low, high = point("low_x", "low"), point("high_x", "high")
    inner = F.when(F.col("low_at") <= F.col("high_at"), F.array(low, high)).otherwise(F.array(high, low))
    flat = (F.col("low_at") == F.col("start")) & (F.col("high_at") == F.col("start"))
    line = F.concat(F.array(point("x", "first")), F.when(flat, F.array().cast("array<struct<x:double,value:double>>")).otherwise(inner), F.array(point("x1", "last")))
    return shaped.select("track", "pixel", F.posexplode(line).alias("k", "p")).select("track", "pixel", "k", "p.x", "p.value")


def covered(samples: DataFrame, cols: DataFrame, fs: float, view: View, pixels: int, total: int, slack: float = 1e-6) -> DataFrame:
    """(track, seen, outside, covers): whether each sample of the viewport lies within the column it belongs to, and none is missed."""
    spark = samples.sparkSession
    cut = spans(fs, view, pixels, total)
    # A sample that narrow pixels share is seen in the first of them, which starts where the one before ends.
    place = spark.createDataFrame([(*own, before) for own, before in zip(cut, [0, *(b for _, _, b in cut)], strict=False)], "pixel int, a long, b long, before long")
    a, b = max(0, int(view.start * fs // 1)), min(total, int((view.start + view.seconds) * fs // 1))
    step = view.seconds / pixels * fs
    guess = F.floor((F.col("i") - view.start * fs) / step).cast("int")
    # Rounding can put a sample one pixel off, and narrow pixels share samples.
    reach = max(1, int(1 / step) + 1) if step else 1
    near = samples.where(F.col("i").between(a, b - 1)).withColumn("pixel", F.explode(F.sequence(guess - reach, guess + reach)))
    found = near.join(F.broadcast(place), "pixel").where((F.col("i") >= F.col("a")) & (F.col("i") < F.col("b")))
    # Samples without a track are a track of their own.
    found = found.join(cols.select(F.col("track").alias("own"), F.col("pixel").alias("column"), "low", "high"), (F.col("pixel") == F.col("column")) & F.col("track").eqNullSafe(F.col("own")))
    bad = (F.col("v") < F.col("low") - slack) | (F.col("v") > F.col("high") + slack)
    out = found.groupBy(F.col("track").alias("own")).agg(F.count_if(F.col("i") >= F.col("before")).alias("seen"), F.count_if(bad).alias("outside"))
    wanted = samples.where(F.col("i").between(a, b - 1)).groupBy("track").agg(F.count("*").alias("wanted"))
    return wanted.join(out, F.col("track").eqNullSafe(F.col("own")), "left").select("track", F.coalesce("seen", F.lit(0)).alias("seen"), F.coalesce("outside", F.lit(0)).alias("outside"), ((F.coalesce("seen", F.lit(0)) == F.col("wanted")) & (F.coalesce("outside", F.lit(0)) == 0)).alias("covers"))
