"""EDF files as a sink: records(…).write.format("edf").

Samples become records of whole numbers in the JVM, dealt by (recording, segment): a
segment is a run of records that one task writes as a file of its own, with a header
that holds its record count. Tasks write under a folder of the job; when all have
ended the driver moves the files that their commit messages name into place, so what
a lost or repeated task has left is never seen and goes with the folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from lanternfish.sources.edf import BLOCKS, FIXED, EdfError, opened

LOW, HIGH = -32768, 32767
ROWS = "recording string, segment int, record_index int, signal_index int, label string, unit string, digital array<smallint>"


def digital(v, most: float):
    """Physical values of -most to most as 16 bits, halves up; what lies beyond is clipped, what isn't finite is zero."""
    whole = F.floor((F.when(F.isnan(v) | v.isNull(), 0.0).otherwise(v) + most) / (2 * most) * 65535 - 32768 + 0.5)
    return F.least(F.lit(HIGH), F.greatest(F.lit(LOW), whole)).cast("smallint")


def records(samples: DataFrame, labels: DataFrame, fs: float, seconds: float = 1.0, most: float = 3200.0, segment: int = 4096) -> DataFrame:
    """The sink's rows of samples(recording, track, i, v) without gaps and labels(track, label, unit).

    Signals that end early, and a last record that isn't full, hold zeros from there on, as a record has all signals in full.
    """
    per = round(fs * seconds)
    zero = digital(F.lit(0.0), most)
    keyed = samples.select("recording", "track", F.floor(F.col("i") / per).alias("record"), (F.col("i") % per).cast("int").alias("pos"), digital(F.col("v"), most).alias("d"))
    held = keyed.groupBy("recording", "track", "record").agg(F.array_sort(F.collect_list(F.struct("pos", "d"))).alias("x"))
    whole = F.element_at("x", -1)["pos"] + 1 == F.size("x")
    values = F.when(whole, F.concat(F.transform("x", lambda r: r["d"]), F.array_repeat(zero, F.lit(per) - F.size("x")))).otherwise(F.raise_error(F.lit("a record has a gap or a sample twice")).cast("array<smallint>"))
    held = held.select("recording", "track", "record", values.alias("digital"))
    ends = samples.groupBy("recording").agg((F.floor(F.max("i") / per) + 1).alias("n"))
    grid = ends.select("recording", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("record"))
    every = samples.select("recording", "track").distinct().join(labels, "track").join(grid, "recording")
    full = every.join(held, ["recording", "track", "record"], "left").select(
        "recording", F.floor(F.col("record") / segment).cast("int").alias("segment"), (F.col("record") % segment).cast("int").alias("record_index"),
        F.col("track").cast("int").alias("signal_index"), "label", "unit", F.coalesce("digital", F.array_repeat(zero, per)).alias("digital"),
    )
    return full.repartition("recording", "segment").sortWithinPartitions("recording", "segment", "record_index", "signal_index")


def header(signals: list[tuple[str, str]], count: int, per: int, seconds: float, most: float) -> bytes:
    n = len(signals)
    pad = lambda s, w: str(s).encode("latin-1", "replace")[:w].ljust(w)
    fixed = ("0", "X X X X", "Startdate X X X X", "01.01.00", "00.00.00", 256 * (n + 1), "", count, f"{seconds:g}", n)
    values = {"label": [x for x, _ in signals], "unit": [u for _, u in signals], "physical_min": [f"{-most:g}"] * n, "physical_max": [f"{most:g}"] * n, "digital_min": [LOW] * n, "digital_max": [HIGH] * n, "samples_per_record": [per] * n}
    blocks = (pad(v, w) for name, w in BLOCKS for v in values.get(name, [""] * n))
    return b"".join(pad(v, w) for v, (_, w) in zip(fixed, FIXED, strict=True)) + b"".join(blocks)


@dataclass
class Written(WriterCommitMessage):
    #: (name in the job's folder, name at its place) of the task's files.
    files: list[tuple[str, str]]


class EdfWriter(DataSourceArrowWriter):
    """Options: path (a folder), seconds (of a record), most (the physical maximum). File names: recording-segment.edf."""

    def __init__(self, options: dict, overwrite: bool):
        self.uri, self.overwrite = options["path"].rstrip("/"), overwrite
        self.seconds, self.most = float(options.get("seconds", 1.0)), float(options.get("most", 3200.0))
        self.job = f"_job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = opened(self.uri)
        system.create_dir(f"{folder}/{self.job}", recursive=True)
        out: list[tuple[str, str]] = []
        key, signals, body, record = None, [], [], None

        def close():
            if key is None:
                return
            per = len(body[0][0])
            if any(len(x) != per for r in body for x in r) or any(len(r) != len(signals) for r in body):
                raise EdfError(f"records of {key[0]} differ in their signals")
            name = f"{uuid.uuid4().hex}.edf"
            with system.open_output_stream(f"{folder}/{self.job}/{name}") as f:
                f.write(header(signals, len(body), per, self.seconds, self.most))
                for r in body:
                    f.write(np.concatenate(r).astype("<i2").tobytes())
            out.append((name, f"{key[0].replace('/', '_')}-{key[1]:05}.edf"))

        for batch in iterator:
            columns = [batch.column(c).to_pylist() for c in ("recording", "segment", "record_index", "label", "unit")]
            for recording, segment, at, label, unit, x in zip(*columns, batch.column("digital"), strict=True):
                if (recording, segment) != key:
                    close()
                    key, signals, body, record = (recording, segment), [], [], None
                if at != record:
                    if at != len(body):
                        raise EdfError(f"record {len(body)} of {recording} is missing")
                    body.append([])
                    record = at
                if len(body) == 1:
                    signals.append((label, unit))
                body[-1].append(x.values.to_numpy(zero_copy_only=False))
        close()
        return Written(out)

    def commit(self, messages) -> None:
        system, folder = opened(self.uri)
        if self.overwrite:
            from pyarrow import fs

            for old in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if old.path.lower().endswith(".edf"):
                    system.delete_file(old.path)
        for m in messages:
            for name, place in m.files if m else ():
                system.move(f"{folder}/{self.job}/{name}", f"{folder}/{place}")
        self._drop(system, folder)

    def abort(self, messages) -> None:
        self._drop(*opened(self.uri))

    def _drop(self, system, folder: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{folder}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{folder}/{self.job}")


def scratch(spark: SparkSession, name: str) -> str:
    """A path for a job's files in the folder that spark.checkpoint.dir names; the JVM removes it when it ends. Local mode may lack one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="lanternfish-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path
