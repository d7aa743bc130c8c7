"""Tracks as chunks: recurrences over a whole track whose state goes from chunk to chunk as a linear map.

A chunk's effect on a linear recurrence is affine in the state that enters it. So each
chunk is run from rest once, in its own task; what enters every chunk follows from
these few numbers a chunk, and a second run of each chunk, from what enters it, gives
the track's output. No task holds more than a chunk of samples.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.operators.dsp import Filters, highpass, lowpass, notch, single

CHUNK = 1 << 16


def in_chunks(samples: DataFrame, size: int = CHUNK) -> DataFrame:
    """(track, chunk, samples) of samples(track, i, v): at most size values in order of i."""
    keyed = samples.withColumn("chunk", F.floor(F.col("i") / size))
    return keyed.groupBy("track", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda r: r["v"]).alias("samples"))


def out_of_chunks(chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    return chunks.select("track", "chunk", F.posexplode("samples").alias("pos", "v")).select("track", (F.col("chunk") * size + F.col("pos")).alias("i"), "v")


def single_bin(chunks: DataFrame, fs: float, hz: float, size: int = CHUNK) -> DataFrame:
    """(track, n, magnitude): one bin of each track's transform, the one nearest to hz, by a recurrence of second order.

    q' = 2 cos(w) q - q'' + x. A chunk from rest leaves (q, q'); the samples after it turn that by the m-th power of the
    recurrence's matrix, which is made of U(m) = sin((m + 1) w) / sin(w). What the chunks leave, so turned, adds up to the
    track's state, in any order. Samples count as they are; the recurrence runs in the JVM.
    """
    n = chunks.groupBy("track").agg(F.sum(F.size("samples")).alias("n"))
    bin_ = F.floor(F.col("n") * hz / fs + 0.5)
    rows = chunks.join(n, "track").withColumn("w", 2 * math.pi * bin_ / F.col("n"))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    left = F.aggregate("samples", zero, lambda q, x: F.struct((2 * F.cos("w") * q["a"] - q["b"] + x).alias("a"), q["a"].alias("b")))
    after = F.col("n") - F.col("chunk") * size - F.size("samples")
    # At w = 0 and w = pi the quotient is its limit.
    turns = bin_ % F.col("n")
    straight = (turns == 0) | (2 * turns == F.col("n"))
    sign = lambda m: F.when(turns == 0, 1.0).otherwise(1.0 - 2 * (F.abs(m) % 2))
    u = lambda m: F.when(straight, sign(m) * (m + 1)).otherwise(F.sin((m + 1) * F.col("w")) / F.sin("w"))
    turned = rows.withColumns({"q": left, "m": after}).select(
        "track", "n", "w",
        (u(F.col("m")) * F.col("q.a") - u(F.col("m") - 1) * F.col("q.b")).alias("a"), (u(F.col("m") - 1) * F.col("q.a") - u(F.col("m") - 2) * F.col("q.b")).alias("b"),
    )
    total = turned.groupBy("track", "n", "w").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    real, imaginary = F.col("a") - F.col("b") * F.cos("w"), F.col("b") * F.sin("w")
    return total.select("track", "n", F.hypot(real, imaginary).alias("magnitude"))


def passes(filters: Filters, fs: float) -> list[tuple[np.ndarray, bool]]:
    """(section, backward) of each pass that Filters.apply makes after the mean, in order."""
    filters.check(fs)
    top = fs / 2 - 1
    low = filters.lff or (filters.low if filters.bandpass else 0)
    high = filters.hff or (filters.high if filters.bandpass else 0)
    own = []
    if low > 0:
        own.append(highpass(fs, max(0.01, min(low, top * 0.8))))
    if high > 0:
        own.append(lowpass(fs, max((low or 0.1) + 1, min(high, top))))
    if filters.notch60 and fs > 130:
        own.append(notch(fs, 60.0))
    return [(k, back) for k in own for back in (False, True)]


#: Samples that one matrix product advances.
STEP = 128


@lru_cache(maxsize=64)
def _matrices(section: tuple[float, ...]) -> tuple[np.ndarray, ...]:
    """Of STEP samples: their response from rest, the state that they leave, the response to a state, and the state's own map."""
    b0, b1, b2, a1, a2 = section
    step, drive = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
    powers = [np.eye(2)]
    for _ in range(STEP):
        powers.append(step @ powers[-1])
    pulse = np.array([b0, *((p @ drive)[0] for p in powers[: STEP - 1])])
    lag = np.subtract.outer(np.arange(STEP), np.arange(STEP))
    return np.where(lag >= 0, pulse[np.abs(lag)], 0.0), np.array([powers[STEP - 1 - j] @ drive for j in range(STEP)]), np.array([p[0] for p in powers[:STEP]]), powers[STEP]


def run(x: np.ndarray, section: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x through a section from a state: its output and the state after it."""
    b0, b1, b2, a1, a2 = section
    whole = len(x) // STEP
    y = np.empty(len(x))
    state = np.array(state, np.float64)
    if whole:
        response, left, own, onward = _matrices(tuple(section))
        blocks = x[: whole * STEP].reshape(whole, STEP)
        gathered = blocks @ left
        entering = np.empty((whole, 2))
        for j in range(whole):
            entering[j] = state
            state = onward @ state + gathered[j]
        y[: whole * STEP] = (blocks @ response.T + entering @ own.T).ravel()
    s1, s2 = state
    for j in range(whole * STEP, len(x)):
        v = x[j]
        y[j] = b0 * v + s1
        s1, s2 = s2 + b1 * v - a1 * y[j], b2 * v - a2 * y[j]
    return y, np.array([s1, s2])


def through(x: np.ndarray, plan: list[tuple[np.ndarray, bool]], entering: np.ndarray, rounded: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """x through all passes, each from its entering state: the output, and the state that each pass leaves."""
    left = np.zeros((len(plan), 2))
    y = single(x) if rounded else x
    for j, (section, back) in enumerate(plan):
        y, left[j] = run(y[::-1] if back else y, section, entering[j])
        y = y[::-1] if back else y
        y = single(y) if rounded else y
    return y, left


@lru_cache(maxsize=32)
def influence(n: int, passes_: tuple[tuple[tuple[float, ...], bool], ...]) -> np.ndarray:
    """[j, a, k, b]: what component b of the state that enters pass k adds to component a of what pass j leaves, over n samples."""
    plan = [(np.array(section), back) for section, back in passes_]
    out = np.zeros((len(plan), 2, len(plan), 2))
    for k in range(len(plan)):
        for b in range(2):
            entering = np.zeros((len(plan), 2))
            entering[k, b] = 1.0
            out[:, :, k, b] = through(np.zeros(n), plan, entering, rounded=False)[1]
    return out


def entering_states(lengths: list[int], left: np.ndarray, plan: list[tuple[np.ndarray, bool]]) -> np.ndarray:
    """[chunk, pass, 2]: what enters each chunk in each pass, from what the chunks leave from rest.

    Pass after pass, forward ones from the first chunk on and backward ones from the last: a pass's state after a chunk is what
    it leaves from rest and what the states that entered the chunk in this pass and the ones before add to it.
    """
    maps = {n: influence(n, tuple((tuple(section), back) for section, back in plan)) for n in set(lengths)}
    entering = np.zeros_like(left)
    for j, (_, back) in enumerate(plan):
        order = range(len(lengths))[::-1] if back else range(len(lengths))
        state = np.zeros(2)
        for c in order:
            entering[c, j] = state
            state = left[c, j] + np.einsum("akb,kb->a", maps[lengths[c]][j, :, : j + 1], entering[c, : j + 1])
    return entering


def filtered(chunks: DataFrame, filters: Filters, fs: float, offsets: DataFrame | None = None) -> DataFrame:
    """chunks(track, chunk, samples) through Filters.apply, as if each track were one array; tracks of fewer than 8 samples lose their mean only.

    offsets(track, offset) are taken off in place of the tracks' own means.

    Two runs over the chunks and one small step a track in between, which sees six pairs of numbers for each chunk.
    """
    plan = passes(filters, fs)
    shape = "track " + chunks.schema["track"].dataType.simpleString()
    stats = chunks.groupBy("track").agg(F.sum(F.size("samples")).alias("_n"), (F.sum(F.aggregate("samples", F.lit(0.0), lambda s, x: s + x)) / F.sum(F.size("samples"))).alias("_mean"))
    if offsets is not None:
        stats = stats.join(offsets.select("track", F.col("offset").alias("_o")), "track", "left").withColumn("_mean", F.coalesce("_o", "_mean")).drop("_o")
    rows = chunks.join(stats.withColumn("_mean", F.col("_mean") if filters.remove_dc else F.lit(0.0)), "track")

    def values(batch, k):
        x = np.asarray(batch.column("samples")[k].values.to_numpy(zero_copy_only=False), np.float64)
        return single(single(x) - batch.column("_mean")[k].as_py())

    def probe(batches):
        for batch in batches:
            left = [through(values(batch, k), plan, np.zeros((len(plan), 2)), rounded=False)[1].ravel().tolist() for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_pydict({"track": batch.column("track"), "chunk": batch.column("chunk"), "m": pa.array([len(x) for x in batch.column("samples")], pa.int64()), "left": pa.array(left, pa.list_(pa.float64()))})

    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        left = np.array(table["left"].to_pylist()).reshape(len(table), len(plan), 2)
        entering = entering_states(table["m"].to_pylist(), left, plan)
        return pa.table({"track": table["track"], "chunk": table["chunk"], "_in": pa.array(entering.reshape(len(table), -1).tolist(), pa.list_(pa.float64()))})

    def replay(batches):
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                x = values(batch, k)
                if plan and batch.column("_n")[k].as_py() >= 8:
                    x = through(x, plan, np.array(batch.column("_in")[k].as_py()).reshape(-1, 2))[0]
                out.append(x)
            offsets = np.cumsum([0, *map(len, out)])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(out) if out else np.zeros(0)))
            yield pa.RecordBatch.from_pydict({"track": batch.column("track"), "chunk": batch.column("chunk"), "samples": lists})

    if not plan:
        return rows.withColumn("_in", F.array().cast("array<double>")).mapInArrow(replay, f"{shape}, chunk long, samples array<double>")
    states = rows.select("track", "chunk", "samples", "_mean").mapInArrow(probe, f"{shape}, chunk long, m long, left array<double>")
    solved = states.groupBy("track").applyInArrow(solve, f"{shape}, chunk long, _in array<double>")
    return rows.join(solved, ["track", "chunk"]).mapInArrow(replay, f"{shape}, chunk long, samples array<double>")
