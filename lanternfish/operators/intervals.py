"""Interval events: overlap vetoes, merging, quotas, dedupe, search, navigation, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternfish.functions.scalars import js_round

MORPHOLOGIES = ("spike", "sharp", "polyspike", "spike-wave")
ARTIFACTS = ("blink", "muscle", "qrs")
BUCKET_SECONDS = 30


def spans_buckets(start: str, end: str, seconds: float) -> Column:
    """The buckets that an interval touches: an overlap join becomes an equi-join on them."""
    return F.sequence(F.floor(F.col(start) / seconds), F.floor(F.col(end) / seconds))


def veto(events: DataFrame, artifacts: DataFrame, seconds: float = BUCKET_SECONDS) -> DataFrame:
    """events(id, start, end, track) that overlap no artifact(start, end, track) of the same track; ends that only touch don't count."""
    a = artifacts.select(F.col("track").alias("t"), F.col("start").alias("a0"), F.col("end").alias("a1"), F.explode(spans_buckets("start", "end", seconds)).alias("b"))
    e = events.select("id", "start", "end", "track", F.explode(spans_buckets("start", "end", seconds)).alias("b"))
    hit = e.join(a, (F.col("track") == F.col("t")) & (e["b"] == a["b"]) & (F.col("start") < F.col("a1")) & (F.col("a0") < F.col("end")), "left_semi")
    return events.join(hit.select("id").distinct(), "id", "left_anti")


def first_of_key(events: DataFrame, *order: str) -> DataFrame:
    """The first event of each type, start and end to the millisecond, and track."""
    key = ["type", js_round(F.col("start") * 1000), js_round(F.col("end") * 1000), "track"]
    return events.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def top_of_buckets(events: DataFrame, per_bucket: int, per_type: int, total: int, seconds: float = BUCKET_SECONDS) -> DataFrame:
    """By confidence, then start and id: so many of each type and bucket, of these so many of each type, of these so many in all."""
    order = [F.desc("confidence"), "start", "id"]
    out = events.withColumn("bucket", F.floor(F.col("start") / seconds))
    out = out.withColumn("_r", F.row_number().over(Window.partitionBy("type", "bucket").orderBy(*order))).where(F.col("_r") <= per_bucket)
    out = out.withColumn("_r", F.row_number().over(Window.partitionBy("type").orderBy(*order))).where(F.col("_r") <= per_type).drop("_r")
    return out.orderBy(*order).limit(total)


def merged(events: DataFrame, gap: float = 0.25) -> DataFrame:
    """Runs of one type on one track whose next start is at most ``gap`` after the latest end so far, as one interval."""
    w = Window.partitionBy("type", "track").orderBy("start", "end", "id")
    latest = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("start") > latest + gap, F.lit(True)).cast("int")
    islands = events.withColumn("_new", new).withColumn("island", F.sum("_new").over(w))
    return islands.groupBy("type", "track", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("confidence").alias("confidence"), F.count("*").alias("n"))


def quota(events: DataFrame, per_bucket: int = 8, per_track: int = 3, seconds: float = BUCKET_SECONDS) -> DataFrame:
    """Greedy: by confidence, an event is kept while its bucket has room and each of its tracks has; the choice depends on earlier ones, so a bucket is folded in order.

    A bucket is folded as one array inside the JVM; its state is the ids kept and a count for each track.
    """
    row = F.struct((-F.col("confidence")).alias("c"), "start", "id", "tracks")
    held = events.withColumn("bucket", F.floor(F.col("start") / seconds)).groupBy("bucket").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    empty = F.struct(F.array().cast("array<string>").alias("ids"), F.array().cast("array<string>").alias("used"))

    def step(acc, r):
        room = (F.size(acc["ids"]) < per_bucket) & ~F.exists(r["tracks"], lambda t: F.size(F.filter(acc["used"], lambda u: u == t)) >= per_track)
        return F.when(room, F.struct(F.concat(acc["ids"], F.array(r["id"].cast("string"))).alias("ids"), F.concat(acc["used"], r["tracks"]).alias("used"))).otherwise(acc)

    kept = held.select(F.explode(F.aggregate("rows", empty, step)["ids"]).alias("id"))
    return events.join(kept.withColumn("id", F.col("id").cast(events.schema["id"].dataType)), "id", "left_semi")


def refractory(events: DataFrame, seconds: float = 0.2) -> DataFrame:
    """Greedy in order of peak on each track: an event closer than this to the last kept goes, but takes its place if it scores higher."""
    row = F.struct("peak", (-F.col("score")).alias("s"), "id")
    # After a gap of this length nothing depends on what was kept before: the events between two gaps are folded by themselves.
    gap = F.col("peak") - F.lag("peak").over(Window.partitionBy("track").orderBy("peak")) >= seconds
    islands = events.withColumn("_i", F.sum(F.coalesce(gap, F.lit(True)).cast("int")).over(Window.partitionBy("track").orderBy("peak").rowsBetween(Window.unboundedPreceding, 0)))
    held = islands.groupBy("track", "_i").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    kind = "array<struct<peak:double,s:double,id:bigint>>"

    def step(kept, r):
        last = F.try_element_at(kept, F.lit(-1))
        return F.when(last.isNull() | (r["peak"] - last["peak"] >= seconds), F.concat(kept, F.array(r))).when(r["s"] < last["s"], F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(r))).otherwise(kept)

    kept = held.select("track", F.explode(F.aggregate("rows", F.array().cast(kind), step)).alias("r"))
    return kept.select("track", F.col("r.id").alias("id"), F.col("r.peak").alias("peak"), (-F.col("r.s")).alias("score"))


def search(events: DataFrame, text: str, show_auto: bool = True, source: str | None = None) -> DataFrame:
    """Events whose type, text or track holds the words, letters of either case alike; no wildcards."""
    told = F.lower(F.concat_ws(" ", "type", "text", F.col("track").cast("string")))
    out = events.where(F.contains(told, F.lit(text.strip().lower())))
    if not show_auto:
        out = out.where("source <> 'auto'")
    return out.where(F.col("source") == source) if source else out


def neighbours(events: DataFrame) -> DataFrame:
    """Each track's events with the ids before and after; the last leads to the first, the first back to the last."""
    w = Window.partitionBy("track").orderBy("start", "id")
    ends = Window.partitionBy("track")
    first, last = F.min(F.struct("start", "id")).over(ends)["id"], F.max(F.struct("start", "id")).over(ends)["id"]
    return events.select("track", "id", F.coalesce(F.lead("id").over(w), first).alias("next_id"), F.coalesce(F.lag("id").over(w), last).alias("previous_id"))


TYPES = ("spike", "sharp", "polyspike", "spike-wave", "periodic", "alpha", "spindle", "slow", "burst-suppression", "triphasic", "blink", "muscle", "qrs", "comment")


def problems(rows: DataFrame, duration: float, types: tuple[str, ...] = TYPES, tracks: DataFrame | None = None) -> DataFrame:
    """rows(idx, id, start, end, type, text, confidence[, track]) with problem: the first rule that an imported annotation breaks, or null."""
    rows = rows.withColumn("_same", F.count("*").over(Window.partitionBy("id")))
    known = F.lit(True)
    if tracks is not None:
        rows = rows.join(F.broadcast(tracks.select(F.col("track").alias("_t")).distinct()), F.col("track") == F.col("_t"), "left")
        known = F.col("track").isNull() | F.col("_t").isNotNull()
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rules = [
        (~finite("start") | (F.col("start") < 0), "start"), (~finite("end") | (F.col("end") < F.col("start")) | (F.col("end") > duration), "end"), (F.col("type").isNull() | ~F.col("type").isin(*types), "type"),
        (F.length("text") > 2000, "text"), (~known, "track"), (F.col("confidence").isNotNull() & (~finite("confidence") | ~F.col("confidence").between(0, 1)), "confidence"), (F.col("id").isNull() | (F.col("id").cast("string") == ""), "id"), (F.col("_same") > 1, "duplicate"),
    ]
    out = F
    for test, name in rules:
        out = out.when(F.coalesce(test, F.lit(False)), name)
    return rows.withColumn("problem", out.otherwise(F.lit(None).cast("string"))).drop("_same", "_t")


def validated(rows: DataFrame, duration: float, **how) -> DataFrame:
    """The rows if all are valid; else the query fails, naming the first bad row (from 1). Checked once over the whole import."""
    checked = problems(rows, duration, **how)
    bad = checked.where("problem is not null").agg(F.min(F.struct("idx", "problem")).alias("b")).first()["b"]
    if bad:
        raise ValueError(f"annotation {bad['idx'] + 1}: invalid {bad['problem']}")
    return checked.drop("problem")


def overlapping_lanes(events: DataFrame, lanes: DataFrame, start: float, end: float) -> DataFrame:
    """Events of a viewport on their lanes, clipped; those without tracks on all lanes."""
    seen = events.where((F.col("end") >= start) & (F.col("start") <= end))
    every = lanes.agg(F.collect_set("track").alias("all"))  # a screen's lanes, tens of rows
    spread = seen.crossJoin(F.broadcast(every)).withColumn("track", F.explode(F.coalesce("tracks", "all"))).drop("all", "tracks")
    return spread.join(F.broadcast(lanes), "track").withColumns({"x0": F.greatest("start", F.lit(start)), "x1": F.least("end", F.lit(end))})
