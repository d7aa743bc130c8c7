"""Annotations as JSON: a strict reader, and the exported form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.operators.intervals import validated

SCHEMA = "id string, start double, end double, type string, text string, track string, tracks array<string>, source string, confidence double"


def read(spark: SparkSession, path: str, duration: float) -> DataFrame:
    """A JSON array, all or nothing: anything malformed or against the rules fails the import. A list of tracks goes before a single one; neither means all."""
    from pyspark.sql import Window

    rows = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    rows = rows.withColumns({"confidence": F.coalesce("confidence", F.lit(1.0)), "idx": F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) - 1})
    return validated(rows, duration).withColumn("tracks", track_list(F.col("tracks"), F.col("track"))).withColumn("source", F.lit("file")).drop("track", "idx")


def track_list(tracks, track):
    return F.when(F.size(tracks) > 0, tracks).when(track.isNotNull(), F.array(track))


def exported(events: DataFrame, *keys: str) -> DataFrame:
    """One JSON text for each event, after the keys; one track as track, several as tracks, none as neither."""
    one = F.when(F.size("tracks") == 1, F.col("tracks")[0])
    many = F.when(F.size("tracks") > 1, F.col("tracks"))
    return events.select(*keys, F.to_json(F.struct("start", "end", "type", "text", one.alias("track"), "source", "confidence", many.alias("tracks"))).alias("value"))


def write(events: DataFrame, path: str) -> None:
    """A folder with one JSON object a line, in order of start."""
    exported(events.orderBy("start", "end")).write.text(path)


def array_lines(events: DataFrame) -> DataFrame:
    """(part, start, end, line): lines that in this order are one JSON array; equal events keep their number.

    Parts 0 and 2 are the brackets. Times and confidence have six decimals. The first element alone has no comma before it;
    it is found as the least (start, end, text of the object), one row.
    """
    fixed = {x: F.round(x, 6).cast("decimal(24,6)") for x in ("start", "end", "confidence")}
    rows = exported(events.withColumns(fixed), "start", "end").groupBy("start", "end", "value").count()
    first = rows.agg(F.min(F.struct("start", "end", "value")).alias("_first"))
    lead = rows.crossJoin(F.broadcast(first)).withColumn("_lead", F.struct("start", "end", "value") == F.col("_first"))
    copies = F.transform(F.sequence(F.lit(1), F.col("count")), lambda k: F.concat(F.when(F.col("_lead") & (k == 1), "").otherwise(","), "value"))
    lines = lead.select(F.lit(1).alias("part"), "start", "end", F.explode(copies).alias("line"))
    ends = events.sparkSession.createDataFrame([(0, "["), (2, "]")], "part int, line string")
    return lines.unionByName(ends.select("part", *(F.lit(None).cast("decimal(24,6)").alias(x) for x in ("start", "end")), "line"))


def write_array(events: DataFrame, path: str) -> None:
    """A folder of text files whose concatenation in order of name is one JSON array, dealt by ranges of start."""
    # "{" sorts after ",": the element without a comma comes last among lines of its start and end, unless its comma is left out of the order.
    order = ("part", "start", "end", F.ltrim(F.lit(","), "line"), F.col("line").startswith(","))
    array_lines(events).repartitionByRange(*order).sortWithinPartitions(*order).select(F.col("line").alias("value")).write.text(path)


def edited(events: DataFrame, changes: DataFrame) -> DataFrame:
    """events with changes(id, text, type, start, end) applied to rows of the user only."""
    c = changes.select("id", *(F.col(x).alias(f"_{x}") for x in ("text", "type", "start", "end")))
    own = F.col("source") == "user"
    return events.join(c, "id", "left").withColumns({x: F.when(own, F.coalesce(f"_{x}", x)).otherwise(F.col(x)) for x in ("text", "type", "start", "end")}).drop("_text", "_type", "_start", "_end")


def removed(events: DataFrame, ids: DataFrame) -> DataFrame:
    return events.join(ids.select("id").withColumn("_gone", F.lit(True)), "id", "left").where((F.col("source") != "user") | F.col("_gone").isNull()).drop("_gone")


class History:
    """The last fifty states of a set of events; states are lazy, so a step costs nothing until it is read."""

    def __init__(self, events: DataFrame, depth: int = 50):
        self.past, self.now, self.ahead, self.depth = [], events, [], depth

    def push(self, events: DataFrame) -> DataFrame:
        self.past = [*self.past, self.now][-self.depth :]
        self.now, self.ahead = events, []
        return events

    def undo(self) -> DataFrame:
        if self.past:
            self.ahead.append(self.now)
            self.now = self.past.pop()
        return self.now

    def redo(self) -> DataFrame:
        if self.ahead:
            self.past.append(self.now)
            self.now = self.ahead.pop()
        return self.now
