"""Cleaning across channels in blocks of time: moments are summed over blocks, one small map follows for a recording, and each block goes through it.

All steps of spatial.cleaned (regression, components, projection, common average)
are affine in a moment's samples, and all that they are fitted on are means and
covariances, and for the components at most 8192 columns besides. So no task holds
a recording: a block holds its channels times ``size`` samples, a model channels
squared. The list of channels and the blocks are tables in the shared folder,
as several jobs read them; so samples are sorted into blocks once.

Defined results: channels of one recording share a rate and are dense in i from 0;
what lies beyond the shortest channel, channels of at most 8 samples and references
stay as they are; a recording without targets stays whole; a recording without
references gets the common average only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternfish.operators import chunks, spatial
from lanternfish.operators.dsp import Filters, single
from lanternfish.sources.edf_writer import scratch

#: Samples of a channel in a block.
SIZE = 1024
FLOATS = pa.list_(pa.float64())
#: Muscle channels count above 20 Hz.
MUSCLE = Filters(remove_dc=False, lff=20.0, hff=0.0, notch60=False)


def ocular_proxy(label: Column) -> Column:
    """Whether a channel at the frontal poles can stand for an eye channel."""
    return F.coalesce(label.rlike(r"(?i)\bfp[12z]\b|^\s*fp[12z]"), F.lit(False))


def roles(channels: DataFrame) -> DataFrame:
    """channels(recording, track, ord, label, kind) with role: eye, muscle, target, or null. Frontal poles are eye channels where a recording has none."""
    eog = F.max((F.col("kind") == "eog").cast("int")).over(Window.partitionBy("recording"))
    eye = (F.col("kind") == "eog") | ((F.coalesce(eog, F.lit(0)) == 0) & (F.col("kind") == "eeg") & ocular_proxy(F.col("label")))
    return channels.withColumn("role", F.when(eye, "eye").when(F.col("kind") == "emg", "muscle").when(F.col("kind") == "eeg", "target"))


def noise_references(channels: DataFrame) -> DataFrame:
    """(recording, eog, emg, ocular_proxies, used, summary): the labels that serve as references, in order of ord, and a sentence on them."""
    role = F.when(F.col("kind") == "eog", "eog").when(F.col("role") == "eye", "ocular_proxies").when(F.col("role") == "muscle", "emg")
    of = lambda c: F.transform(F.array_sort(F.collect_list(F.when(role == c, F.struct("ord", "label")))), lambda r: r["label"]).alias(c)
    rows = roles(channels).groupBy("recording").agg(of("eog"), of("emg"), of("ocular_proxies"))
    some = {c: F.size(c) > 0 for c in ("eog", "emg", "ocular_proxies")}
    named = {c: F.array_join(c, ", ") for c in some}
    # The sentences.
    summary = (
        F.when(some["eog"] & some["emg"], F.concat(F.lit("Using "), named["eog"], F.lit(" and "), named["emg"], F.lit(" as noise references.")))
        .when(some["eog"], F.concat(F.lit("Using "), named["eog"], F.lit(" as ocular references. No EMG channel in this montage.")))
        .when(some["emg"] & some["ocular_proxies"], F.concat(F.lit("Using "), named["emg"], F.lit(" as muscle references and "), named["ocular_proxies"], F.lit(" as ocular proxies.")))
        .when(some["emg"], F.concat(F.lit("Using "), named["emg"], F.lit(" as muscle references. No EOG channel in this montage.")))
        .when(some["ocular_proxies"], F.concat(F.lit("No EOG/EMG channels. Using "), named["ocular_proxies"], F.lit(" as ocular proxies.")))
        .otherwise("No EOG, EMG, or frontal ocular-proxy channels in this window.")
    )
    return rows.withColumns({"used": F.concat("eog", "emg", "ocular_proxies"), "summary": summary})


def matrix(values, channels: int) -> np.ndarray:
    return np.asarray(values, np.float64).reshape(channels, -1)


def fitted(n: int, mean: np.ndarray, cov: np.ndarray, c: int, fit: np.ndarray, regression: bool, ica: bool, project: bool) -> tuple[np.ndarray, np.ndarray]:
    """(map, offset) of the first c rows out of all rows, from n columns' means and covariances; fit: some of the columns."""
    refs = len(mean) - c
    own = np.hstack([np.eye(c), np.zeros((c, refs))])
    offset = np.zeros(c)

    def through(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal own, offset
        own, offset = a @ own, a @ offset + b

    def moments() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return own @ cov @ own.T, own @ cov[:, c:], own @ mean + offset

    if regression and refs and n >= 16 and np.linalg.matrix_rank(cov[c:, c:]) == refs:
        share = np.linalg.solve(cov[c:, c:], cov[c:, :c]).T
        own[:, c:] -= share
        offset += share @ mean[c:]
    if ica and c > 1 and n >= 32 and n >= 4 * c:
        spread, shared, middle = moments()
        white = spatial.whitening(spread)
        if white is not None:
            d = own @ fit + (offset - middle)[:, None]
            found = spatial.deflated(white[0] @ d, d[0, 0])
            if found is not None and refs:
                down, mixing = found @ white[0], white[1] @ np.linalg.inv(found)
                size = np.sqrt(np.outer(np.maximum(np.diag(down @ spread @ down.T), 0), np.diag(cov)[c:]))
                follows = np.abs(down @ shared) >= spatial.REJECT_CORRELATION * size
                keep = ~(follows & (size * n > 1e-12)).any(axis=1)
                if not keep.all():
                    a = mixing[:, keep] @ down[keep]
                    through(a, middle - a @ middle)
    if project and n >= 16:
        if not refs and c > 1:
            through(np.eye(c) - 1 / c, np.zeros(c))
        for k in range(refs):
            spread, shared, _ = moments()
            energy = cov[c + k, c + k]
            if energy * n < 1e-12:
                continue
            pattern = shared[:, k] / energy
            norm, size = np.linalg.norm(pattern), np.sqrt(np.maximum(np.diag(spread), 0) * energy)
            near = np.where(size * n > 1e-12, np.abs(shared[:, k]) / np.where(size > 0, size, 1), 0)
            if norm >= 1e-12 and near.max() >= spatial.PATTERN_CORRELATION:
                w = pattern / norm
                through(np.eye(c) - np.outer(w, w), np.zeros(c))
    return own, offset


def stored(rows: DataFrame, name: str) -> DataFrame:
    """rows as a table in the shared folder."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def cleaned(samples: DataFrame, channels: DataFrame, fs: float, regression: bool = True, ica: bool = False, project: bool = False, size: int = SIZE) -> DataFrame:
    """(track, i, v) of samples(track, i, v) with the targets of each recording cleaned; channels(recording, track, ord, label, kind), track unique."""
    counts = samples.groupBy("track").agg(F.count("*").alias("n"), F.avg("v").alias("shift")).where("n > 8")
    used = roles(channels).where("role is not null").join(counts, "track")
    in_recording = Window.partitionBy("recording")
    # Targets come first, then eye channels, then muscle channels.
    place = F.struct(F.when(F.col("role") == "target", 0).when(F.col("role") == "eye", 1).otherwise(2), "ord", "track")
    used = used.withColumns({"least": F.min("n").over(in_recording), "c": F.sum((F.col("role") == "target").cast("int")).over(in_recording), "row": F.row_number().over(in_recording.orderBy(place)) - 1}).where("c > 0")
    used = stored(used.select("recording", "track", "role", "least", "c", "row", "shift"), "channels")
    inputs = samples.join(used.where("role <> 'muscle'").select("track"), "track")
    # A look at the list of channels spares the filter's passes where nothing is to be filtered.
    if not channels.where("kind = 'emg'").isEmpty():
        muscle = samples.join(used.where("role = 'muscle'").select("track"), "track")
        inputs = inputs.unionByName(chunks.out_of_chunks(chunks.filtered(chunks.in_chunks(muscle, size), MUSCLE, fs), size))
    inputs = inputs.join(used, "track").where("i < least")
    value = F.transform(F.array_sort(F.collect_list(F.struct("row", "i", "v"))), lambda r: r["v"])
    first = {"c": F.first("c"), "rows": F.max("row") + 1, "shift": F.transform(F.array_sort(F.collect_set(F.struct("row", "shift"))), lambda r: r["shift"]), "tracks": F.transform(F.array_sort(F.collect_set(F.struct("row", "track"))), lambda r: r["track"])}
    blocks = inputs.groupBy("recording", F.floor(F.col("i") / size).alias("block")).agg(*(x.alias(k) for k, x in first.items()), value.alias("x"))
    blocks = stored(blocks, "blocks")

    def products(batches):
        for batch in batches:
            out = {k: [] for k in ("recording", "a", "b", "s")}
            for r in batch.to_pylist():
                x = matrix(r["x"], r["rows"]) - np.array(r["shift"])[:, None]
                x = np.vstack([x, np.ones(x.shape[1])])  # the last row makes sums and the number of columns
                a, b = np.triu_indices(len(x))
                out["recording"] += [r["recording"]] * len(a)
                out["a"].append(a)
                out["b"].append(b)
                out["s"].append((x @ x.T)[a, b])
            if out["a"]:
                yield pa.RecordBatch.from_pydict({"recording": out["recording"], **{k: np.concatenate(out[k]) for k in ("a", "b", "s")}})

    kind = dict(samples.dtypes)["track"]
    name = dict(channels.dtypes)["recording"]
    moments = blocks.select("recording", "rows", "shift", "x").mapInArrow(products, f"recording {name}, a long, b long, s double").groupBy("recording", "a", "b").agg(F.sum("s").alias("s"))
    moments = moments.groupBy("recording").agg(F.transform(F.array_sort(F.collect_list(F.struct("a", "b", "s"))), lambda r: r["s"]).alias("m"))
    held = ("c", "rows", "shift")
    if ica:
        stride = F.greatest(F.lit(1), F.ceil(F.col("least") / spatial.FIT_COLUMNS))
        sampled = inputs.where(F.col("i") % stride == 0).groupBy("recording").agg(*(first[k].alias(k) for k in held), value.alias("fit"))
    else:
        sampled = used.groupBy("recording").agg(*(first[k].alias(k) for k in held)).withColumn("fit", F.array().cast("array<double>"))

    def model(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                rows = r["rows"]
                upper = np.zeros((rows + 1, rows + 1))
                upper[np.triu_indices(rows + 1)] = r["m"]
                n = round(upper[-1, -1])
                moved = upper[:-1, -1] / n
                product = upper[:-1, :-1] + np.triu(upper[:-1, :-1], 1).T
                a, b = fitted(n, moved + r["shift"], product / n - np.outer(moved, moved), r["c"], matrix(r["fit"], rows), regression, ica, project)
                out.append({"recording": r["recording"], "map": a.ravel().tolist(), "offset": b.tolist()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([batch.schema.field("recording"), ("map", FLOATS), ("offset", FLOATS)]))

    def mapped(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                y = single(matrix(r["map"], len(r["offset"])) @ matrix(r["x"], r["rows"]) + np.array(r["offset"])[:, None])
                out += [{"track": t, "block": r["block"], "y": own.tolist()} for t, own in zip(r["tracks"], y, strict=False)]
            yield pa.RecordBatch.from_pylist(out, pa.schema([pa.field("track", batch.schema.field("tracks").type.value_type), ("block", pa.int64()), ("y", FLOATS)]))

    models = moments.join(sampled, "recording").mapInArrow(model, f"recording {name}, map array<double>, offset array<double>")
    clean = blocks.join(models, "recording").select("block", "rows", "tracks", "x", "map", "offset").mapInArrow(mapped, f"track {kind}, block long, y array<double>")
    clean = clean.select("track", "block", F.posexplode("y").alias("k", "v")).select("track", (F.col("block") * size + F.col("k")).alias("i"), "v")
    # The rest: other channels, and what lies beyond the shortest one.
    targets = used.where("role = 'target'").select("track", "least")
    rest = samples.join(targets, "track", "left").where("least is null or i >= least").select("track", "i", "v")
    return clean.unionByName(rest)
