"""Removal of lines that many documents share, in DataFrame functions alone.

Texts are split at line feeds and the lines exploded. A line's key is the line
stripped of blanks at both ends with A-Z in lower case; it is known by 128 bits of
its hash. Distinct documents are counted for each key, in two steps, so that a line
of a third of all documents is counted in all tasks first. Keys of enough
documents go back to the lines: those so frequent that there can only be a bounded
number of them by broadcast, all others by a shuffle, where each is a small part of
the rows. What is left is put together again by position, within the row of its
document.

Only hashes and positions are moved by line; each text is moved once, to the list of
its dropped positions.

Defined results: a null or empty text is one empty line; a document is what shares
one doc_id, and rows without doc_id are together one document, before all others;
rows of the largest doc_id that hold a line keep all of that line's copies; repeated
rows are decided alike and give a row each; an empty table gives no rows; columns
other than doc_id and text are not read unless they are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfish.llm.common import stored

#: What is stripped from a line's ends.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A key in at least one of so many lines is sent by broadcast: there are no more than so many of them.
HEAVY = 50_000


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case; lower() alone would change other letters too."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def identified(df: DataFrame) -> DataFrame:
    """df as _id, _text and the text's hash and length, which with _id tell rows of different texts apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return df.select(F.col("doc_id").cast("long").alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_hash"), F.octet_length(text).alias("_bytes"))


def keyed_lines(df: DataFrame, min_chars: int) -> DataFrame:
    """_id, _hash, _bytes, _at and the key's hash (_k, _l) of each line whose key has at least min_chars code points."""
    lines = identified(df).select("_id", "_hash", "_bytes", F.posexplode(F.split("_text", "\n", -1)).alias("_at", "_line"))
    keys = lines.withColumn("_line", line_key(F.col("_line"))).where(F.char_length("_line") >= min_chars)
    return keys.select("_id", "_hash", "_bytes", "_at", F.xxhash64("_line").alias("_k"), F.xxhash64(F.lit("second"), "_line").alias("_l"))


def common_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """_k, _l, _docs and _last (the largest _id) of the keys found in at least min_docs documents."""
    holders = lines.select("_k", "_l", "_id").distinct()
    return holders.groupBy("_k", "_l").agg(F.count("*").alias("_docs"), F.max("_id").alias("_last")).where(F.col("_docs") >= min_docs)


def doomed_lines(lines: DataFrame, common: DataFrame) -> DataFrame:
    """_id, _hash, _bytes, _at of the lines that go."""
    bound = F.lit(max(1, lines.count() // HEAVY))
    heavy, light = common.where(F.col("_docs") >= bound), common.where(F.col("_docs") < bound)
    found = lines.join(F.broadcast(heavy.select("_k", "_l", "_last", F.lit(True).alias("_heavy"))), ["_k", "_l"], "left")
    rest = found.where("_heavy is null").drop("_last", "_heavy").join(light, ["_k", "_l"])
    both = found.where("_heavy").select("_id", "_hash", "_bytes", "_at", "_last").unionByName(rest.select("_id", "_hash", "_bytes", "_at", "_last"))
    return both.where(~F.col("_id").eqNullSafe(F.col("_last"))).select("_id", "_hash", "_bytes", "_at")


def without(lines: Column, gone: Column) -> Column:
    """The array without the elements at the ascending positions gone, in time that follows both lengths.

    What lies between two positions is one slice. The arrays stand in a struct, as an expression within a function over
    elements would be evaluated anew for each of them.
    """
    held = F.array(F.struct(lines.alias("l"), F.concat(F.array(F.lit(-1)), gone).alias("from"), F.concat(gone, F.array(F.size(lines))).alias("to")))
    return F.transform(held, lambda h: F.flatten(F.zip_with(h["from"], h["to"], lambda a, b: F.slice(h["l"], a + 2, b - a - 1))))[0]


def drop_common_lines(df: DataFrame, min_chars: int = 20, min_docs: int = 3, keep: bool = False) -> DataFrame:
    """doc_id, text of the lines left, n_lines (before) and n_dropped of each row of df(doc_id, text).

    With keep, all of df's columns come first as they are but for text; where df has n_lines or n_dropped, the new ones get
    underscores after their names.
    """
    lines = stored(keyed_lines(df, min_chars), "lines")
    common = stored(common_keys(lines, min_docs), "common-lines")
    gone = doomed_lines(lines, common).groupBy("_id", "_hash", "_bytes").agg(F.array_sort(F.collect_set("_at")).alias("_gone"))
    names = [f"_x{i}" for i in range(len(df.columns))] if keep else []
    source = df.toDF(*names) if keep else df
    at = dict(zip(df.columns, names, strict=True)) if keep else {"doc_id": "doc_id", "text": "text"}
    text = F.coalesce(F.col(at["text"]), F.lit(""))
    rows = source.select(*names, F.col(at["doc_id"]).cast("long").alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_hash"), F.octet_length(text).alias("_bytes")).alias("d")
    same = F.col("d._id").eqNullSafe(F.col("g._id")) & (F.col("d._hash") == F.col("g._hash")) & (F.col("d._bytes") == F.col("g._bytes"))
    both = rows.join(gone.hint("shuffle_hash").alias("g"), same, "left").select(*names, "d._id", "_text", "_gone")
    split = F.split("_text", "\n", -1)
    left = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(without(split, F.col("_gone")), "\n"))
    counts = [F.size(split).cast("long"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long")]
    if not keep:
        return both.select(F.col("_id").alias("doc_id"), left.alias("text"), counts[0].alias("n_lines"), counts[1].alias("n_dropped"))
    free = [next(n for n in (c + "_" * k for k in range(99)) if n not in df.columns) for c in ("n_lines", "n_dropped")]
    return both.select(*((left if c == "text" else F.col(x)).alias(c) for c, x in at.items()), *(x.alias(c) for c, x in zip(free, counts, strict=True)))


ORACLE = r"""
with d as (
  select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents
), l as (
  select r, doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as pos from d
), k as (
  select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l
), c as (
  select key, max(doc_id) as last from k where length(key) >= 20 group by key
  having count(distinct doc_id) + cast(bool_or(doc_id is null) as integer) >= 3
), m as (
  select k.*, c.key is not null and k.doc_id is distinct from c.last as gone from k left join c on k.key = c.key
)
select any_value(doc_id) as doc_id, count(*) as n_lines, cast(count(*) filter (where gone) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by r
"""
