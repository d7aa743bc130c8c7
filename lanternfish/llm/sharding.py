"""Sharding by a two-pass external shuffle, in DataFrame functions alone.

First pass: records go to buckets by a seeded hash, as many as keep a bucket
within one task's memory. Second pass: each bucket is put in order and shuffled
(Fisher-Yates, seeded). Buckets follow each other, and the rows are dealt to the
shards in turn, so the counts of shards differ by one at most (the law `rows`).

Reruns agree: buckets stand at fixed partitions, in a fixed order, before the
seeded shuffle. Equal texts share no bucket unless their rows are equal in
doc_id, size and checksum too; rows equal in all of these count as one entry
with a number until buckets are made, so that they fill no task.

Defined results: a null text has size 8 and the checksum of an empty text; null
doc_ids are records like others; an empty table gives no rows; other columns are
not read by ``assign`` and written as they are by ``write_shards``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternfish.llm.common import parts

#: Records that a bucket holds, about; 24 bytes each in one array.
BUCKET_ROWS = 20_000


def records(df: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))


def assign(df: DataFrame, shards: int = 24, seed: int = 29, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of df(doc_id, text)."""
    spark = df.sparkSession
    rows = records(df)
    total = df.select(F.lit(1).alias("one")).count()
    n = max(1, -(-total // bucket_rows), min(parts(spark), total))
    keys = ["doc_id", "size", "text_crc32"]
    # Equal rows as one entry, numbered so that no bucket gets more than bucket_rows of them at once.
    entries = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    entries = entries.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / bucket_rows))))
    entries = entries.withColumn("n", F.least(F.lit(bucket_rows), F.col("n") - F.col("piece") * bucket_rows).cast("int"))
    entries = entries.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), *keys, "piece"), F.lit(n)))
    entries = entries.repartition(max(parts(spark), 1), "bucket")
    held = entries.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct(*keys, "piece", "n"))).alias("held"))
    held = held.withColumn("held", F.flatten(F.transform("held", lambda x: F.array_repeat(F.struct(*(x[k].alias(k) for k in keys)), x["n"]))))
    # The shuffle draws from one generator for each partition: rows must come to it in a fixed order.
    dealt = held.sortWithinPartitions("bucket").withColumn("held", F.shuffle("held", F.lit(seed)))
    # The buckets' sizes alone, once more from the narrow entries, give where each begins.
    sizes = entries.groupBy("bucket").agg(F.sum("n").alias("c"))
    begins = sizes.select("bucket", (F.sum("c").over(Window.orderBy("bucket")) - F.col("c")).alias("begin"))
    out = dealt.join(begins, "bucket").select("begin", F.posexplode("held").alias("at", "r"))
    rank = F.col("begin") + F.col("at")
    return out.select("r.*", F.lit("rows").alias("law"), (rank % shards).cast("int").alias("shard"), F.floor(rank / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(df: DataFrame, path: str, shards: int = 24, seed: int = 29) -> None:
    """Writes df's rows under path, one folder shard=k for each shard, in order of slot; columns as they are, then slot.

    Where df has columns of these names, the new ones get underscores after theirs. Rows equal in doc_id and text share their
    places in any order.
    """
    names = [f"_x{i}" for i in range(len(df.columns))]
    at = dict(zip(df.columns, names, strict=True))
    plan = assign(df, shards, seed)
    inner = df.toDF(*names).alias("d")
    text = F.coalesce(F.col(at["text"]), F.lit(""))
    keyed = inner.withColumns({"_id": F.col(at["doc_id"]).cast("long"), "_size": (F.octet_length(text) + 8).cast("long"), "_crc": F.crc32(F.encode(text, "UTF-8"))})
    turn = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
    keyed = keyed.withColumn("_t", turn("_id", "_size", "_crc")).alias("d")
    plan = plan.withColumn("_t", F.row_number().over(Window.partitionBy("doc_id", "size", "text_crc32").orderBy("shard", "slot"))).alias("p")
    both = keyed.join(plan, F.col("d._id").eqNullSafe(F.col("p.doc_id")) & (F.col("d._size") == F.col("p.size")) & (F.col("d._crc") == F.col("p.text_crc32")) & (F.col("d._t") == F.col("p._t")))
    shard, slot = (next(n for n in (c + "_" * k for k in range(99)) if n not in df.columns) for c in ("shard", "slot"))
    out = both.select(*(F.col(f"d.{x}").alias(c) for c, x in at.items()), F.col("p.shard").alias(shard), F.col("p.slot").alias(slot))
    out.repartition(shards, shard).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
