"""Tracks in array form and the bridge between it and long form; per-track work in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_arrays(samples: DataFrame) -> DataFrame:
    """(track, samples): one row a track. A track of an hour at 250 Hz is 7 MB; longer ones should come in chunks with a halo."""
    return samples.groupBy("track").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda r: r["v"]).alias("samples"))


def to_samples(tracks: DataFrame) -> DataFrame:
    return tracks.select("track", F.posexplode("samples").alias("i", "v")).withColumn("i", F.col("i").cast("long"))


def chunked(samples: DataFrame, size: int, halo: int) -> DataFrame:
    """(track, chunk, first, samples): pieces of size samples with a halo on either side, for filters whose transients fit in it."""
    chunk = F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("i") - halo) / size)), F.floor((F.col("i") + halo) / size)))
    keyed = samples.withColumn("chunk", chunk)
    return keyed.groupBy("track", "chunk").agg(F.min("i").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda r: r["v"]).alias("samples"))


def mapped(tracks: DataFrame, fn: Callable[[np.ndarray, float], np.ndarray], column: str = "samples") -> DataFrame:
    """tracks with fn(samples, fs) in place of samples; fs is a column or 1. Rows are independent, so nothing is shuffled."""
    rated = "fs" in tracks.columns
    schema = T.StructType([f if f.name != column else T.StructField(column, T.ArrayType(T.DoubleType())) for f in tracks.schema.fields])

    def work(batches):
        for batch in batches:
            at = batch.schema.get_field_index(column)
            rates = batch.column("fs").to_pylist() if rated else [1.0] * batch.num_rows
            out = [None if x is None else fn(np.array(x, np.float64), r).tolist() for x, r in zip(batch.column(at).to_pylist(), rates, strict=True)]
            yield pa.RecordBatch.from_arrays([c if k != at else pa.array(out, pa.list_(pa.float64())) for k, c in enumerate(batch.columns)], batch.schema.names)

    return tracks.mapInArrow(work, schema)


def rows_of(tracks: DataFrame, fn: Callable[[dict], list[dict]], schema: T.StructType) -> DataFrame:
    """All rows that fn gives for each track, a dict of its columns with samples as an array."""
    target = pa.schema([pa.field(f.name, arrow_type(f.dataType)) for f in schema.fields])

    def work(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                out += fn(row | {"samples": np.array(row["samples"] or [], np.float64)})
            yield from pa.Table.from_pylist(out, target).to_batches()

    return tracks.mapInArrow(work, schema)


def arrow_type(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)
