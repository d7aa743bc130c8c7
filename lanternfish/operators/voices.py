"""Live voices: a track's voltage, block by block, as a gliding tone under gains, mutes and pauses that change on the way.

A voice carries five numbers from block to block: its pitch, its loudness, its phase, how
open its mute is, and the last sample. But for the last sample, a block's effect on them is affine
in what enters it. So a recording is voiced in two runs over its blocks, each by itself, with a small fold of three
sums a block in between; streaming.voices goes through the same blocks in order and gives the same sound.

A block goes by its time, then by n. One without samples, or whose samples hold a null or a non-finite value, is silence of
its length, in which the voice stands still, as in a pause; a block after a last sample of that kind, or after a gap, starts
at its own first sample. A control counts from the first block that begins at its time or
later; its null fields change nothing; of two at one moment the fields of the one that sorts last count.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternfish.functions.scalars import is_finite
from lanternfish.operators.chunks import run
from lanternfish.operators.synthesis import SCALES, midi_hz, quantized

#: Fixed values of each kind of voice: shares by which pitch and loudness near their targets in a sample; loudness of silence and its rise with the voltage.
KINDS = {"contour": (0.012, 0.05, 0.28, 1.4), "pulse": (0.02, 0.045, 0.26, 1.5)}
#: How far a mute opens in 128 samples, its loudness in the mix, a side's share, a voice's first loudness.
OPENS, LOUD, SIDE, FIRST = 0.012, 0.7, 0.7071, 0.25
#: Semitones over the root of a pulse to the left, to the right and in the middle.
PULSE = {"left": 0, "right": 7, "middle": 3}

#: What a control may change, with what holds before any.
CONTROLS = {"scale": 1.0, "gain": 1.0, "pan": 0.0, "mute": False, "playing": True}
CONTROL_TYPES = {"scale": "double", "gain": "double", "pan": "double", "mute": "boolean", "playing": "boolean"}


@dataclass(frozen=True)
class Voice:
    """Voltage at fs, played speed times as fast, as sound at rate."""

    fs: float
    rate: float = 44_100.0
    speed: float = 2.0
    kind: str = "contour"
    root: float = 50.0
    semitones: float = 8.0
    scale: str | None = None
    negative_up: bool = True

    @property
    def step(self) -> float:
        """Samples of voltage that pass with one of sound."""
        return self.fs * self.speed / self.rate

    @property
    def shares(self) -> tuple[float, float, float]:
        """Of pitch, loudness and mute."""
        return *KINDS[self.kind][:2], 1 - (1 - OPENS) ** (1 / 128)

    def at_rest(self) -> tuple[float, float, float, float]:
        """(hz, loudness, phase, open) of a voice that has not played."""
        return float(midi_hz(self.root)), FIRST, 0.0, 1.0


def places(first: int, n: int, follows: bool, s: Voice) -> tuple[int, int]:
    """The sounds from and to which a block plays: those after the sample before it, up to its last one.

    What lies between two blocks belongs to the later one, which knows both samples.
    """
    start = math.floor((first - 1) / s.step) + 1 if follows else math.ceil(first / s.step)
    return start, math.floor((first + n - 1) / s.step) + 1


def told(v: list | None, start: int, stop: int, first: int, before: float | None, scale: float, s: Voice) -> np.ndarray | None:
    """The voltage at each sound of a block, within one either way; None where the block can't be heard."""
    if not v or stop <= start or any(x is None or not math.isfinite(x) for x in v):
        return None
    known = np.array([v[0] if before is None else before, *v], np.float64)
    return np.clip(np.interp(np.arange(start, stop) * s.step - (first - 1), np.arange(len(known)), known) * scale, -1, 1)


def targets(x: np.ndarray, pan: float, s: Voice) -> tuple[np.ndarray, np.ndarray]:
    """The pitch and the loudness that a voice makes for."""
    floor, rise = KINDS[s.kind][2:]
    loud = floor + (1 - floor) * np.minimum(1, np.abs(x) * rise)
    if s.kind == "pulse":
        side = "left" if pan < -0.25 else "right" if pan > 0.25 else "middle"
        return np.full(len(x), float(midi_hz(s.root + PULSE[side]))), loud
    midi = s.root + (x if s.negative_up else -x) * s.semitones
    return midi_hz(quantized(midi, SCALES[s.scale], s.root) if s.scale else midi), loud


def glide(target: np.ndarray, share: float, start: float) -> np.ndarray:
    """Each value moves a share of the way from the one before it to its target."""
    return run(target, np.array([share, 0.0, 0.0, share - 1, 0.0]), np.array([(1 - share) * start, 0.0]))[0]


def sounded(x: np.ndarray, pan: float, gain: float, mute: bool, state: tuple, s: Voice) -> tuple[np.ndarray, tuple]:
    """A block's sound from the state that enters it, and the state that it leaves."""
    hz, loud, phase, opened = state
    a, b, c = s.shares
    pitch, size = targets(x, pan, s)
    pitch, size = glide(pitch, a, hz), glide(size, b, loud)
    turned = phase + 2 * math.pi / s.rate * np.cumsum(pitch)
    want = 0.0 if mute else 1.0
    gate = want + (opened - want) * (1 - c) ** np.arange(1, len(x) + 1)
    if s.kind == "pulse":
        wave = np.sin(turned) + 0.12 * np.sin(2 * turned)
    else:
        up = x if s.negative_up else -x
        wave = np.sin(turned) + 0.18 * np.maximum(0, up) * np.sin(2 * turned) + 0.3 * np.maximum(0, -up) * np.sin(turned / 2)
    # The octave below repeats after two turns.
    left = (float(pitch[-1]), float(size[-1]), float(math.fmod(turned[-1], 4 * math.pi)), float(gate[-1]))
    return wave * size * gate * gain * LOUD, left


def sides(wave: np.ndarray, pan: float) -> tuple[list[float], list[float]]:
    return (wave * SIDE * (1 - pan)).tolist(), (wave * SIDE * (1 + pan)).tolist()


def controlled(blocks: DataFrame, controls: DataFrame) -> DataFrame:
    """blocks with what the controls up to each block's time leave of CONTROLS, its order _k, and _before: the sample before it.

    blocks(track, n, at, first, samples), controls(track, at, ...fields). Rows without samples go through a track's window.
    """
    none = {"n": "long", "first": "long", "_size": "int", "_last": "double"}
    heads = blocks.select("track", "at", "n", "first", F.size("samples").alias("_size"), F.get("samples", F.size("samples") - 1).alias("_last"), F.lit(1).alias("_block"), *(F.lit(None).cast(t).alias(k) for k, t in CONTROL_TYPES.items()))
    changes = controls.select("track", "at", *(F.lit(None).cast(t).alias(k) for k, t in none.items()), F.lit(0).alias("_block"), *(F.col(k).cast(t) for k, t in CONTROL_TYPES.items()))
    w = Window.partitionBy("track").orderBy("at", "_block", "n", *CONTROLS)
    held = {k: F.coalesce(F.last(k, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(v)) for k, v in CONTROLS.items()}
    rows = heads.unionByName(changes).withColumns({f"_{k}": v for k, v in held.items()} | {"_k": F.row_number().over(w)}).where("_block = 1")
    w = Window.partitionBy("track").orderBy("_k")
    joins = (F.lag(F.col("first") + F.col("_size")).over(w) == F.col("first")) & is_finite(F.lag("_last").over(w))
    before = F.when(joins, F.lag("_last").over(w))
    rows = rows.select("track", "n", "_k", before.alias("_before"), *(F.col(f"_{k}").alias(k) for k in CONTROLS))
    # Merged, so that neither samples nor heads are ever broadcast on a wrong estimate.
    return blocks.select("track", "n", "at", "first", "samples").join(rows.hint("merge"), ["track", "n"])


def heard(row: dict, s: Voice) -> tuple[int, int, np.ndarray | None]:
    """Where a row of controlled plays, and its voltage there; None if it is silent."""
    v = row["samples"] or []
    start, stop = places(row["first"], len(v), row["_before"] is not None, s)
    return start, max(start, stop), told(v, start, stop, row["first"], row["_before"], row["scale"], s) if row["playing"] else None


def left_from_rest(x: np.ndarray | None, pan: float, s: Voice) -> list[float]:
    """What a block adds to a voice from nothing: sounds, pitch, loudness, and the sum of its pitches."""
    if x is None:
        return [0.0] * 4
    a, b, _ = s.shares
    pitch, size = targets(x, pan, s)
    pitch = glide(pitch, a, 0.0)
    return [float(len(x)), float(pitch[-1]), float(glide(size, b, 0.0)[-1]), float(pitch.sum())]


def onward(state: tuple, left: list[float], mute: bool, s: Voice) -> tuple:
    """The state after a block, from the one before it and what the block leaves from nothing."""
    m, pitch, size, total = left
    if not m:
        return state
    hz, loud, phase, opened = state
    a, b, c = s.shares
    total += hz * (1 - a) * (1 - (1 - a) ** m) / a
    want = 0.0 if mute else 1.0
    return pitch + hz * (1 - a) ** m, size + loud * (1 - b) ** m, math.fmod(phase + 2 * math.pi / s.rate * total, 4 * math.pi), want + (opened - want) * (1 - c) ** m


OUT = "n long, start long, hz double, loudness double, left array<double>, right array<double>"


def voiced(blocks: DataFrame, controls: DataFrame, s: Voice) -> DataFrame:
    """(track, n, start, hz, loudness, left, right): each block's sound from its first place on, with the pitch and loudness it ends on.

    blocks(track, n, at, first, samples), n unique in a track; controls(track, at, scale, gain, pan, mute, playing).
    """
    rows = controlled(blocks, controls)
    shape = "track " + blocks.schema["track"].dataType.simpleString()

    def probe(batches):
        for batch in batches:
            left = [left_from_rest(heard(r, s)[2], r["pan"], s) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pydict({**{k: batch.column(k) for k in ("track", "n", "_k", "mute")}, "left": pa.array(left, pa.list_(pa.float64()))})

    def fold(table: pa.Table) -> pa.Table:
        table, state, entering = table.sort_by("_k"), s.at_rest(), []
        for left, mute in zip(table["left"].to_pylist(), table["mute"].to_pylist(), strict=True):
            entering.append(state)
            state = onward(state, left, mute, s)
        return pa.table({"track": table["track"], "n": table["n"], "_in": pa.array(entering, pa.list_(pa.float64()))})

    def replay(batches):
        for batch in batches:
            # A block at a time: its sound is longer than its voltage.
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                made = played(r, tuple(r["_in"]), s)[0]
                yield pa.RecordBatch.from_pydict({"track": batch.column("track").slice(k, 1), **{c: pa.array([x], pa.list_(pa.float64()) if c in ("left", "right") else None) for c, x in made.items()}})

    states = rows.mapInArrow(probe, f"{shape}, n long, _k int, mute boolean, left array<double>")
    entering = states.groupBy("track").applyInArrow(fold, f"{shape}, n long, _in array<double>")
    return rows.join(entering.hint("merge"), ["track", "n"]).mapInArrow(replay, f"{shape}, {OUT}")


def played(row: dict, state: tuple, s: Voice) -> tuple[dict, tuple]:
    """A row of controlled as sound from a state, and the state after it."""
    start, stop, x = heard(row, s)
    if x is None:
        left, right = sides(np.zeros(stop - start), 0.0)
    else:
        wave, state = sounded(x, row["pan"], row["gain"], row["mute"], state, s)
        left, right = sides(wave, row["pan"])
    return {"n": row["n"], "start": start, "hz": state[0], "loudness": state[1], "left": left, "right": right}, state
