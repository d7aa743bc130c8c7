"""Tracks and annotations made from the test tables, since these hold no recording.

Each view has a SQL twin in SQL, so that queries and their oracles start from the
same rows. A track's index is counted without a window over all of its samples:
whole vectors are numbered, and a sample's place in its vector is added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FS = 200.0
#: Ten channels for the embeddings' ten labels.
CHANNELS = ("Fp1", "Fp2", "F3", "F4", "C3", "C4", "O1", "O2", "Cz", "EKG")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signal(spark: SparkSession, sf_dir: str, *ties: str) -> DataFrame:
    """(track, i, v): one dense track for each label of the embeddings, at 200 Hz; vectors of one vec_id come in order of the ties, if given."""
    e = table(spark, sf_dir, "embeddings")
    at = (F.row_number().over(Window.partitionBy("label").orderBy("vec_id", *ties)) - 1).cast("long")
    numbered = e.select(F.col("label").cast("long").alias("track"), at.alias("k"), "embedding")
    long = numbered.select("track", "k", F.size("embedding").alias("n"), F.posexplode("embedding").alias("pos", "x"))
    return long.select("track", (F.col("k") * F.col("n") + F.col("pos")).alias("i"), (F.col("x").cast("double") * 100).alias("v"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track, samples): each embedding as one short track at 64 Hz."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("track"), F.transform("embedding", lambda x: x.cast("double") * 100).alias("samples"))


def event_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track, i, v): the events' values by type, in order of time."""
    e = table(spark, sf_dir, "events")
    i = (F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id")) - 1).cast("long")
    return e.select(F.col("event_type").alias("track"), i.alias("i"), F.col("value").alias("v"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, start, end, track, type, source, confidence, text): events as intervals."""
    e = table(spark, sf_dir, "events")
    first = e.agg(F.min("ts").alias("t0"))
    seconds = F.timestamp_diff("MICROSECOND", F.col("t0"), F.col("ts")) / 1e6
    return e.crossJoin(F.broadcast(first)).select(
        F.col("event_id").alias("id"), seconds.alias("start"), (seconds + F.col("value") / 10).alias("end"), (F.col("user_id") % 10).alias("track"),
        F.col("event_type").alias("type"), F.element_at(F.array(*map(F.lit, ("user", "file", "auto"))), (F.col("user_id") % 3 + 1).cast("int")).alias("source"),
        (F.col("value") / (F.col("value") + 1)).alias("confidence"), F.col("props").alias("text"),
    )


def channels(spark: SparkSession) -> DataFrame:
    """(idx, label, unit, fs): a static list of ten."""
    return spark.createDataFrame([(k, f"EEG {x}-REF" if x != "EKG" else "EKG", "uV", FS) for k, x in enumerate(CHANNELS)], "idx long, label string, unit string, fs double")


SQL = {
    "signal": """signal as (
  select track, k * n + pos as i, x * 100 as v from (
    select cast(label as bigint) as track, row_number() over (partition by label order by vec_id) - 1 as k, len(embedding) as n,
      cast(unnest(embedding) as double) as x, generate_subscripts(embedding, 1) - 1 as pos from embeddings))""",
    "vectors": """vectors as (select vec_id as track, list_transform(embedding, lambda x: cast(x as double) * 100) as samples from embeddings)""",
    "event_signal": """event_signal as (
  select event_type as track, row_number() over (partition by event_type order by ts, event_id) - 1 as i, value as v from events)""",
    "annotations": """annotations as (
  select event_id as id, date_diff('microsecond', t0, ts) / 1e6 as start, date_diff('microsecond', t0, ts) / 1e6 + value / 10 as "end",
    user_id % 10 as track, event_type as type, case user_id % 3 when 0 then 'user' when 1 then 'file' else 'auto' end as source,
    value / (value + 1) as confidence, props as text
  from events, (select min(ts) as t0 from events))""",
    "channels": "channels as (select * from (values "
    + ", ".join(f"(cast({k} as bigint), '{'EEG ' + x + '-REF' if x != 'EKG' else 'EKG'}', 'uV', 200.0::double)" for k, x in enumerate(CHANNELS))
    + ") t(idx, label, unit, fs))",
}
