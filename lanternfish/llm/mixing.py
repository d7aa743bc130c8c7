"""Mixing sources to target weights by systematic sampling.

Sources in order of code points (a null source last) weigh 3, 1, 2 and so on
again; together they share a budget of words. No source gets more than a limit
of times its size: what is over goes to the others by weight. Within a source a
document's expected copies, target / size of the source, are summed up in a
fixed order, one offset is added, and a copy comes with each integer crossed.

The order is by size class (bits of the size), then by runs of doc_id, then by
size, so each class is taken in proportion. Sums over (source, class, run) are
made first and then added up; only their documents are ordered within one task,
so that no source, however large, is ordered by one task.

Defined results: a null text has size 0; a null doc_id comes first in its run;
repeated rows are documents of their own; sources of size 0 take nothing and have
target 0; an empty table gives no rows; columns other than doc_id, text and source
are returned unchanged by ``mixed_documents`` and not read by ``take``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (3, 1, 2)
RUNS = 4096


def targets(sizes: DataFrame, share: float = 1.5, limit: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) of sizes(source, source_size), one row for each source.

    Sources fill up in order of limit / weight: those that reach their limit are a prefix of that order, and the rest share by
    weight what these leave.
    """
    listed = sizes.withColumn("i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("i") % len(weights) + 1).cast("int")).cast("long")
    listed = listed.withColumn("w", weight)
    order = Window.orderBy(F.col("source_size") / F.col("w"), "i")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = listed.withColumns({
        "total": F.sum("source_size").over(everything),
        "full": F.coalesce(F.sum("source_size").over(before), F.lit(0)),
        "wb": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)),
    })
    left = F.lit(share) * F.col("total") - F.lit(limit) * F.col("full")
    capped = F.lit(limit) * F.col("source_size") * F.col("wb") <= left * F.col("w")
    filled = filled.withColumn("capped", capped)
    # Of those not capped, the first in order tells what is left for all of them.
    first = F.min(F.when(~F.col("capped"), F.struct(F.col("full").alias("full"), F.col("wb").alias("wb"), F.col("total").alias("total")))).over(everything)
    filled = filled.withColumn("f", first)
    shared = (F.lit(share) * F.col("f.total") - F.lit(limit) * F.col("f.full")) / F.col("f.wb") * F.col("w")
    return filled.select("source", "source_size", F.when(F.col("capped"), F.lit(limit) * F.col("source_size")).otherwise(shared).cast("double").alias("target"))


def offset(source: Column, seed: int) -> Column:
    """The source's offset, at least 0 and less than 1, the same in each run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def copies(df: DataFrame, share: float = 1.5, limit: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 17) -> DataFrame:
    """df with size, source_size, target and copies; df has doc_id, source, size, and others that are passed on."""
    span = df.agg(F.coalesce(F.floor((F.max("doc_id") - F.min("doc_id")) / RUNS), F.lit(0)).alias("w"), F.coalesce(F.min("doc_id"), F.lit(0)).alias("m")).first()
    run = F.coalesce(F.floor((F.col("doc_id") - F.lit(span["m"])) / F.lit(max(65536, span["w"] + 1))), F.lit(-1))
    df = df.withColumns({"_class": F.length(F.bin("size")), "_run": run})
    group = ["source", "_class", "_run"]
    counts = df.groupBy(*group).agg(F.count("*").alias("_n"), F.sum("size").alias("_size"))
    sizes = counts.groupBy("source").agg(F.sum("_size").alias("source_size"))
    goals = targets(sizes, share, limit, weights)
    before = Window.partitionBy("source").orderBy("_class", "_run").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n", "_size")
    same = lambda a, b, keys: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    groups = counts.alias("c").join(goals.alias("g"), same("c", "g", ["source"])).select("c.*", "g.source_size", "g.target")
    inner = Window.partitionBy(*group).orderBy("size", "doc_id")
    ranked = df.withColumn("_k", F.row_number().over(inner))
    out = ranked.alias("d").join(groups.alias("g"), same("d", "g", group)).select("d.*", "g.source_size", "g.target", "g._before")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    k = F.col("_before") + F.col("_k")
    u = offset(F.col("source"), seed)
    return out.withColumn("copies", (F.floor(k * rate + u) - F.floor((k - 1) * rate + u)).cast("long")).drop("_class", "_run", "_k", "_before")


def sized(df: DataFrame) -> DataFrame:
    return df.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def take(df: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken of df(doc_id, text, source); see copies() for the parameters."""
    narrow = sized(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"))).select("doc_id", "source", "size")
    made = copies(narrow, **how)
    return made.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(df: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of df as often as it is taken, columns as they were."""
    names = [f"_x{i}" for i in range(len(df.columns))]
    inner = df.toDF(*names)
    at = {c: x for c, x in zip(df.columns, names, strict=True)}
    rows = inner.withColumns({"doc_id": F.col(at["doc_id"]).cast("long"), "text": F.col(at["text"]), "source": F.col(at["source"]).cast("string")})
    made = copies(sized(rows).drop("text"), **how).where("copies > 0")
    return made.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*(F.col(x).alias(c) for c, x in at.items()))


ORACLE = """
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+')) as bigint) as size from documents
), s as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as i from d group by source
), w as (
  select *, case i % 3 when 0 then 3 when 1 then 1 else 2 end as w from s
), f as (
  select *, cast(sum(source_size) over () as bigint) as total,
    cast(coalesce(sum(source_size) over (order by source_size / w, i rows between unbounded preceding and 1 preceding), 0) as bigint) as filled,
    cast(sum(w) over () - coalesce(sum(w) over (order by source_size / w, i rows between unbounded preceding and 1 preceding), 0) as bigint) as wb
  from w
), c as (
  select *, 2.0::double * source_size * wb <= (1.5::double * total - 2.0::double * filled) * w as capped from f
), m as (
  select min(filled) filter (not capped) as filled, max(wb) filter (not capped) as wb from c
), g as (
  select source, source_size, case when capped then 2.0::double * source_size
    else (1.5::double * total - 2.0::double * m.filled) / m.wb * w end as target,
    cast(('0x' || substr(md5('17:' || coalesce(source, '')), 1, 8)) as bigint) / 4294967296.0::double as u
  from c, m
), span as (
  select coalesce(min(doc_id), 0) as least, greatest(65536, coalesce((max(doc_id) - min(doc_id)) // 4096, 0) + 1) as width from d
), r as (
  select d.*, row_number() over (partition by source order by
      case when size = 0 then 1 else length(bin(size)) end, coalesce((doc_id - least) // width, -1), size, doc_id nulls first) as k
  from d, span
), t as (
  select r.doc_id, r.size, g.source_size, g.target, g.u, r.k, case when g.source_size > 0 then g.target / g.source_size else 0 end as rate
  from r join g on r.source is not distinct from g.source
)
select doc_id, size, source_size, target, cast((floor(k * rate + u) - floor((k - 1) * rate + u)) * size as bigint) as taken from t
"""
