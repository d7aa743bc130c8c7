"""From a recording's channels to what a reader sees: derive, filter, cut into pages, sum up by pixel.

A segment is filtered whole, in chunks whose state is carried on. A page is filtered
by itself with a margin that keeps the filters' transients off it, and loses the mean
of the whole recording, so that the baseline does not jump from page to page; all
pages of a recording are made at once, one group of samples for each track and page.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternfish.operators import chunks as C
from lanternfish.operators.display import View
from lanternfish.operators.dsp import Filters
from lanternfish.operators.montage import derived


def rated(montage: DataFrame, channels: DataFrame) -> DataFrame:
    """montage's available derivations with fs, the rate of their sources; sources of different rates are an error that names the derivation."""
    rate = lambda source, name: channels.select(F.col("idx").alias(source), F.col("fs").alias(name))
    use = montage.where("available").join(rate("source_a", "_fa"), "source_a", "left").join(rate("source_b", "_fb"), "source_b", "left")
    differ = F.col("source_b").isNotNull() & ~F.col("_fa").eqNullSafe(F.col("_fb"))
    fs = F.when(differ, F.raise_error(F.concat(F.lit("derivation source rates differ: "), F.col("id"))).cast("double")).otherwise(F.col("_fa"))
    return use.withColumn("fs", fs).drop("_fa", "_fb")


def raw(samples: DataFrame, montage: DataFrame, channels: DataFrame) -> DataFrame:
    """(track, i, v, fs) of the available derivations, unfiltered."""
    use = rated(montage, channels)
    return derived(samples, use).join(F.broadcast(use.select(F.col("id").alias("track"), "fs")), "track").select("track", "i", "v", "fs")


def by_rate(tracks: DataFrame, one) -> DataFrame:
    """one(rows without fs, rate) for each rate, of which a recording has a few, put together."""
    out = None
    for fs in sorted(r.fs for r in tracks.select("fs").distinct().collect()):
        made = one(tracks.where(F.col("fs") == fs).drop("fs"), fs).withColumn("fs", F.lit(fs))
        out = made if out is None else out.unionByName(made)
    return out if out is not None else tracks


def segment(samples: DataFrame, montage: DataFrame, channels: DataFrame, filters: Filters = Filters(), size: int = C.CHUNK) -> DataFrame:
    """(track, i, v, fs): derived and filtered over the whole of samples(track, i, v)."""
    return by_rate(raw(samples, montage, channels), lambda rows, fs: C.out_of_chunks(C.filtered(C.in_chunks(rows, size), filters, fs), size))


def dc_offsets(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy("track").agg(F.avg("v").alias("offset"))


def window(tracks: DataFrame, view: View, filters: Filters = Filters(), size: int = C.CHUNK, cleaned=None) -> DataFrame:
    """(track, i, v, fs) of raw tracks over a view and its margin, filtered from rest at the margin's edges, less the recording's mean.

    cleaned: what to do with the filtered rows as a whole, if anything.
    """
    plan = view.prefetched(filters.lff)

    def one(rows, fs):
        first, last = int(plan.start * fs // 1), int(-(-plan.end * fs // 1))
        cut = rows.where((F.col("i") >= first) & (F.col("i") < last)).withColumn("i", F.col("i") - first)
        done = C.out_of_chunks(C.filtered(C.in_chunks(cut, size), filters, fs, dc_offsets(rows)), size)
        return done.withColumn("i", F.col("i") + first)

    out = by_rate(tracks, one)
    return cleaned(out) if cleaned else out


def pages(tracks: DataFrame, fs: float, seconds: float, filters: Filters = Filters()) -> DataFrame:
    """(track, page, i, v): every page of tracks(track, i, v), each filtered with its own margin, as window() does for one view.

    A sample goes to the pages whose margin reaches it; a task holds one page and its margin of a track.
    """
    last = tracks.agg(F.max("i")).first()[0]
    total = (int(last) + 1) / fs if last is not None else 0.0
    margin = View(0.0, seconds, float("inf")).prefetched(filters.lff).end - seconds
    t = F.col("i") / fs
    first, final = F.greatest(F.lit(0), F.floor((t - margin) / seconds) - 1), F.least(F.lit(max(0, int(-(-total // seconds)) - 1)), F.floor((t + margin) / seconds))
    start, end = F.greatest(F.lit(0.0), F.col("page") * seconds - margin), F.least(F.lit(total), (F.col("page") + 1) * seconds + margin)
    near = tracks.withColumn("page", F.explode(F.sequence(first, final))).where((F.col("i") >= F.floor(start * fs)) & (F.col("i") < F.ceil(end * fs)))
    held = near.groupBy("track", "page").agg(F.min("i").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda r: r["v"]).alias("samples"))
    filters.check(fs)

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            columns = batch.to_pydict()
            done = [filters.apply(np.array(x, np.float64), fs, o).tolist() for x, o in zip(columns["samples"], columns["offset"], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("track", "page", "first")), pa.array(done, pa.list_(pa.float64()))], ["track", "page", "first", "samples"])

    schema = T.StructType([held.schema["track"], held.schema["page"], held.schema["first"], T.StructField("samples", T.ArrayType(T.DoubleType()))])
    filtered = held.join(dc_offsets(tracks), "track").select("track", "page", "first", "samples", "offset").mapInArrow(work, schema)
    rows = filtered.select("track", "page", "first", F.posexplode("samples").alias("at", "v")).select("track", "page", (F.col("first") + F.col("at")).alias("i"), "v")
    return rows.where(F.floor(F.col("i") / fs / seconds) == F.col("page"))
