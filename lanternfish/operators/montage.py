"""Montages: electrode pairs resolved to channels by aliases, and derived signals.

Pair tables and channel lists are small by nature (tens of rows), so they are
broadcast; samples are joined on (track, i).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanternfish.functions import labels

# The chains of the longitudinal and the transverse montage, in reading order.
LONGITUDINAL = (
    ("Fp1", "F7"), ("F7", "T3"), ("T3", "T5"), ("T5", "O1"), ("Fp1", "F3"), ("F3", "C3"), ("C3", "P3"), ("P3", "O1"), ("Fz", "Cz"), ("Cz", "Pz"),
    ("Fp2", "F4"), ("F4", "C4"), ("C4", "P4"), ("P4", "O2"), ("Fp2", "F8"), ("F8", "T4"), ("T4", "T6"), ("T6", "O2"),
)
TRANSVERSE = (
    ("F7", "Fp1"), ("Fp1", "Fp2"), ("Fp2", "F8"), ("F7", "F3"), ("F3", "Fz"), ("Fz", "F4"), ("F4", "F8"), ("T3", "C3"), ("C3", "Cz"), ("Cz", "C4"),
    ("C4", "T4"), ("T5", "P3"), ("P3", "Pz"), ("Pz", "P4"), ("P4", "T6"), ("T5", "O1"), ("O1", "O2"), ("O2", "T6"),
)
NAMED = {"double-banana": ("banana", LONGITUDINAL), "transverse": ("trans", TRANSVERSE)}


def pair_table(spark: SparkSession, pairs) -> DataFrame:
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "ord long, a string, b string")


def described(channels: DataFrame) -> DataFrame:
    """channels(idx, label, unit, fs) with canonical, laterality, kind, is_eeg."""
    c, key = F.col("label"), F.col("_key")
    named = channels.withColumn("canonical", labels.canonical(c)).withColumn("_key", F.upper("canonical"))
    return named.withColumns({"laterality": labels.laterality(c, key), "kind": labels.kind(c, F.col("unit"), key)}).withColumn("is_eeg", F.col("kind") == "eeg").drop("_key")


def resolved(names: DataFrame, channels: DataFrame) -> DataFrame:
    """(name, idx, fs): for each of names(name) the channel that shares an alias; a channel's own key beats its other aliases, then the first channel wins."""
    known = channels.select("idx", "fs", F.posexplode(labels.alias_keys(F.col("label"))).alias("rank", "key"))
    wanted = names.select("name", F.posexplode(labels.alias_keys(F.col("name"))).alias("turn", "key"))
    hits = wanted.join(F.broadcast(known), "key")
    best = Window.partitionBy("name").orderBy("turn", (F.col("rank") > 0).cast("int"), "idx")
    return hits.withColumn("r", F.row_number().over(best)).where("r = 1").select("name", "idx", "fs")


def pairs_montage(pairs: DataFrame, channels: DataFrame, prefix: str) -> DataFrame:
    """(ord, id, label, source_a, source_b, laterality, kind, fs, available, missing) for pairs(ord, a, b)."""
    names = pairs.select(F.col("a").alias("name")).union(pairs.select("b")).distinct()
    found = resolved(names, channels)
    side = lambda c: F.broadcast(found.select(F.col("name").alias(c), F.col("idx").alias(f"i{c}"), F.col("fs").alias(f"f{c}")))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    same = F.col("ia").isNull() | F.col("ib").isNull() | (F.col("fa") == F.col("fb"))
    missing = F.array_compact(F.array(F.when(F.col("ia").isNull(), F.col("a")), F.when(F.col("ib").isNull(), F.col("b")), F.when(~same, F.lit("matching sample rates"))))
    return both.select(
        "ord", F.concat(F.lit(f"{prefix}:"), "a", F.lit("-"), "b").alias("id"), F.concat("a", F.lit("–"), "b").alias("label"), F.coalesce("ia", F.lit(-1)).alias("source_a"), F.coalesce("ib", F.lit(-1)).alias("source_b"),
        labels.pair_laterality(F.col("a"), F.col("b")).alias("laterality"), F.lit("eeg").alias("kind"), F.col("fa").alias("fs"), (F.size(missing) == 0).alias("available"), missing.alias("missing"),
    )


def original_montage(channels: DataFrame) -> DataFrame:
    """One derivation of one source for each EEG channel."""
    own = described(channels).where("is_eeg")
    return own.select(F.col("idx").alias("ord"), F.concat(F.lit("ref:"), F.col("idx").cast("string")).alias("id"), F.when(F.col("canonical") == "", F.col("label")).otherwise(F.col("canonical")).alias("label"), F.col("idx").alias("source_a"), F.lit(None).cast("long").alias("source_b"), "laterality", "kind", "fs", F.lit(True).alias("available"), F.array().cast("array<string>").alias("missing"))


def auxiliary(channels: DataFrame) -> DataFrame:
    """Derivations of what isn't EEG: the first left and right eye channels as one, other eye, muscle and extra channels alone, the first two heart channels as one."""
    c = described(channels).withColumn("side", labels.eyelid_side(F.col("label")))
    first = Window.partitionBy("kind", "side").orderBy("idx")
    c = c.withColumns({"turn": F.row_number().over(first), "beat": F.row_number().over(Window.partitionBy("kind").orderBy("idx")), "beats": F.count("*").over(Window.partitionBy("kind"))})
    one = lambda rows, ord_, label: rows.select(F.lit(ord_).alias("o"), F.col("idx").alias("ord"), F.concat_ws(":", F.lit("aux"), "kind", F.col("idx").cast("string")).alias("id"), label.alias("label"), F.col("idx").alias("source_a"), F.lit(None).cast("long").alias("source_b"), "laterality", "kind", "fs", F.lit(True).alias("available"), F.array().cast("array<string>").alias("missing"))

    def joined(a, b, o, id_, label, kind):
        same = F.col("x.fs") == F.col("y.fs")
        return a.alias("x").crossJoin(b.alias("y")).select(F.lit(o).alias("o"), F.lit(0).cast("long").alias("ord"), F.lit(id_).alias("id"), F.lit(label).alias("label"), F.col("x.idx").alias("source_a"), F.col("y.idx").alias("source_b"), F.lit("midline").alias("laterality"), F.lit(kind).alias("kind"), F.col("x.fs").alias("fs"), same.alias("available"), F.when(same, F.array().cast("array<string>")).otherwise(F.array(F.lit("matching sample rates"))).alias("missing"))

    eye = c.where("kind = 'eog'")
    left, right = (eye.where((F.col("side") == s) & (F.col("turn") == 1)) for s in ("left", "right"))
    pair = joined(left, right, 0, "aux:eog-l-r", "EOG L–R", "eog")
    used = pair.select(F.explode(F.array("source_a", "source_b")).alias("idx"))
    heart = c.where("kind = 'ekg'")
    label = lambda k: labels.aux_label(F.lit(k), F.col("canonical"))
    out = pair.unionByName(one(eye.join(used, "idx", "left_anti"), 1, label("eog"))).unionByName(one(c.where("kind = 'emg'"), 2, label("emg"))).unionByName(one(c.where("kind = 'extra'"), 3, F.col("canonical")))
    out = out.unionByName(joined(heart.where("beat = 1"), heart.where("beat = 2"), 4, "aux:ekg", "EKG", "ekg")).unionByName(one(heart.where("beats = 1"), 4, label("ekg")))
    return out.orderBy("o", "ord").drop("o")


def derived(samples: DataFrame, montage: DataFrame) -> DataFrame:
    """(track, i, v) of available derivations from samples(track, i, v) by channel index: a alone, or a less b sample by sample in single precision."""
    use = montage.where("available").select(F.col("id").alias("track"), "source_a", "source_b")
    a = samples.join(F.broadcast(use), samples["track"] == use["source_a"]).select(use["track"].alias("t"), "source_b", "i", F.col("v").alias("va"))
    alone = a.where("source_b is null").select(F.col("t").alias("track"), "i", F.col("va").alias("v"))
    b = samples.select(F.col("track").alias("source_b"), "i", F.col("v").alias("vb"))
    both = a.where("source_b is not null").join(b, ["source_b", "i"]).select(F.col("t").alias("track"), "i", (F.col("va") - F.col("vb")).cast("float").cast("double").alias("v"))
    return alone.unionByName(both)


def common_average(samples: DataFrame) -> DataFrame:
    """samples less the mean of all tracks at the same index."""
    return samples.join(samples.groupBy("i").agg(F.avg("v").alias("m"), F.count("*").alias("n")), "i").select("track", "i", F.when(F.col("n") >= 2, F.col("v") - F.col("m")).otherwise(F.col("v")).alias("v"))


def regressed(samples: DataFrame, reference: DataFrame) -> DataFrame:
    """samples less their least-squares share of one reference(i, r); the track's mean stays."""
    both = samples.join(reference, "i", "left")
    fit = both.where("r is not null").groupBy("track").agg(F.covar_pop("v", "r").alias("c"), F.var_pop("r").alias("q"), F.avg("r").alias("m"))
    b = F.when(F.col("q") > 1e-12, F.col("c") / F.col("q")).otherwise(0.0)
    return both.join(fit, "track").select("track", "i", (F.col("v") - F.coalesce(b * (F.col("r") - F.col("m")), F.lit(0.0))).alias("v"))


def audible(controls: DataFrame) -> DataFrame:
    """Tracks that sound: not muted, and only soloed ones if any is."""
    return controls.crossJoin(F.broadcast(controls.agg(F.coalesce(F.max("solo"), F.lit(False)).alias("any_solo")))).where(~F.col("mute") & (~F.col("any_solo") | F.col("solo"))).select("track")


def stereo_mix(samples: DataFrame, controls: DataFrame) -> DataFrame:
    """(i, left, right): samples times gain and equal-power pan gains, summed over tracks; tracks without a row play as they are."""
    from lanternfish.functions.scalars import equal_power

    both = samples.join(F.broadcast(controls), "track", "left").where(~F.coalesce("mute", F.lit(False)))
    gl, gr = equal_power(F.coalesce(F.col("pan"), F.lit(0.0)))
    v = F.col("v") * F.coalesce("gain", F.lit(1.0))
    return both.groupBy("i").agg(F.sum(v * gl).alias("left"), F.sum(v * gr).alias("right"))
