"""Live voices of a recording as it arrives: state by track, a stream of controls beside the samples, timers on the watermark."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lanternfish.operators.voices import CONTROL_TYPES, CONTROLS, OUT, Voice, played

FIELDS = list(CONTROLS)
ROW = "at long, block int, n long, first long, samples array<double>, " + ", ".join(f"{k} {t}" for k, t in CONTROL_TYPES.items())
NAMES = [x.split()[0] for x in ROW.split(", ")]


def in_order(row: tuple) -> tuple:
    """Time, controls before blocks, n, then fields, nulls first: the order of voices.controlled."""
    at, block, n, fields = row[0], row[1], row[2], row[5:]
    return at, block, -1 if n is None else n, tuple((x is not None, x or 0) for x in fields)


class Voices(StatefulProcessor):
    """Rows wait until the watermark has passed them and then sound in order of their time, however they came in.

    So what waits of a track is as long as the watermark's delay; what stays is one row: the voice, the controls that hold, and where the last
    block ended. A timer at the time of the first row that waits brings it out
    without new rows of its track.
    """

    def __init__(self, voice: Voice):
        self.voice = voice

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ROW)
        self.now = handle.getValueState("now", "hz double, loudness double, phase double, opened double, next long, last double, " + ", ".join(f"{k} {t}" for k, t in CONTROL_TYPES.items()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            taken = [clean(r) for r in batch[NAMES].itertuples(index=False, name=None)]
            first = min([r[0] for r in taken] + ([] if first is None else [first]))
            self.waiting.appendList(taken)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((tuple(r) for r in self.waiting.get()), key=in_order)
        due = [r for r in rows if r[0] < passed]
        if not due:
            return
        if len(due) < len(rows):
            self.waiting.put(rows[len(due) :])
            self.handle.registerTimer(rows[len(due)][0] // 1000 + 1)
        else:
            self.waiting.clear()
        state, after, last, held = self.voice.at_rest(), None, None, dict(CONTROLS)
        if self.now.exists():
            *state, after, last = self.now.get()[:6]
            held = dict(zip(FIELDS, self.now.get()[6:], strict=True))
        for _, block, n, first, samples, *fields in due:
            if not block:
                held |= {k: x for k, x in zip(FIELDS, fields, strict=True) if x is not None}
                continue
            row = held | {"n": n, "first": first, "samples": samples, "_before": last if after == first and last is not None and math.isfinite(last) else None}
            made, state = played(row, tuple(state), self.voice)
            after, last = first + len(samples or []), samples[-1] if samples else None
            yield pd.DataFrame({"track": [key[0]], **{k: [x] for k, x in made.items()}})
        self.now.update((*state, after, last, *held.values()))

    def close(self) -> None:
        pass


def clean(row: tuple) -> tuple:
    """A row of pandas with None for what it calls missing, and plain lists and numbers."""
    at, block, n, first, samples, *fields = row
    number = lambda x, t: None if pd.isna(x) else t(x)
    own = None if samples is None else [None if x is None else float(x) for x in samples]
    types = {"double": float, "boolean": bool}
    return int(at), int(block), number(n, int), number(first, int), own, *(number(x, types[t]) for x, t in zip(fields, CONTROL_TYPES.values(), strict=True))


def voiced(blocks: DataFrame, controls: DataFrame, s: Voice, late: str = "2 seconds") -> DataFrame:
    """operators.voices.voiced over streams: blocks(track, n, ts, first, samples), controls(track, ts, scale, gain, pan, mute, playing).

    ts is the time; rows later than the watermark are dropped. Needs the RocksDB state store.
    """
    none = {"n": "long", "first": "long", "samples": "array<double>"}
    at = F.unix_micros("ts").alias("at")
    b = blocks.select("track", "ts", at, F.lit(1).alias("block"), *(F.col(k).cast(t) for k, t in none.items()), *(F.lit(None).cast(t).alias(k) for k, t in CONTROL_TYPES.items()))
    c = controls.select("track", "ts", at, F.lit(0).alias("block"), *(F.lit(None).cast(t).alias(k) for k, t in none.items()), *(F.col(k).cast(t) for k, t in CONTROL_TYPES.items()))
    # One watermark for each stream; the slower one counts, so a control is never passed by blocks after it.
    rows = b.withWatermark("ts", late).unionByName(c.withWatermark("ts", late))
    shape = "track " + blocks.schema["track"].dataType.simpleString()
    return rows.groupBy("track").transformWithStateInPandas(Voices(s), f"{shape}, {OUT}", "append", "eventTime")
