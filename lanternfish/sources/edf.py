"""EDF and EDF+ recordings as a DataFrame source: spark.read.format("edf").

The driver parses headers only and plans one partition for each run of records;
tasks read just their bytes and the signals that are asked for. Rows are
(recording, signal_index, record_index, digital); headers and annotations have
readers of their own. Files open through pyarrow's file systems by URI.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RECORDS = "recording string, signal_index int, record_index int, digital array<smallint>"
#: Names and widths of a header's fixed fields, and of its signal blocks.
FIXED = (("version", 8), ("patient", 80), ("recording", 80), ("start_date", 8), ("start_time", 8), ("header_bytes", 8), ("reserved", 44), ("record_count", 8), ("record_duration", 8), ("signal_count", 4))
BLOCKS = (("label", 16), ("transducer", 80), ("unit", 8), ("physical_min", 8), ("physical_max", 8), ("digital_min", 8), ("digital_max", 8), ("prefilter", 80), ("samples_per_record", 8), ("reserved", 32))


#: Bytes of a file that a task reads at once.
PARTITION_BYTES = 16 << 20
#: Signals of all files whose table is sent by broadcast; a longer one is shuffled.
FEW_SIGNALS = 100_000


class EdfError(ValueError):
    pass


@dataclass
class Header:
    fields: dict
    signals: list[dict] = field(default_factory=list)
    record_count: int = 0
    record_duration: float = 0.0
    bytes_per_record: int = 0
    header_bytes: int = 0

    @property
    def duration(self) -> float:
        return self.record_count * self.record_duration

    @property
    def plus(self) -> bool:
        return self.fields["reserved"].startswith("EDF+")


def text(raw: bytes) -> str:
    """Up to the first zero byte, trimmed."""
    return raw.split(b"\0", 1)[0].decode("latin-1").strip()


def number(value: str, what: str) -> float:
    try:
        x = float(value)
    except ValueError:
        x = np.nan
    if not np.isfinite(x):
        raise EdfError(f"{what} is not a finite number")
    return x


def parse_header(raw: bytes, size: int) -> Header:
    """A header from a file's first bytes and its size; anything malformed is refused."""
    if size < 256 or len(raw) < 256:
        raise EdfError("the file is shorter than a header")
    at, fields = 0, {}
    for name, width in FIXED:
        fields[name] = text(raw[at : at + width])
        at += width
    if fields["version"] != "0":
        raise EdfError("unknown version")
    n = int(number(fields["signal_count"], "number of signals"))
    length = int(number(fields["header_bytes"], "header length"))
    if not 1 <= n <= 512 or length != 256 * (n + 1):
        raise EdfError("the header's length and number of signals don't agree")
    if len(raw) < length or size < length:
        raise EdfError("the signal header is cut off")
    if fields["reserved"].startswith("EDF+D"):
        raise EdfError("discontinuous recordings aren't supported")
    duration, count = number(fields["record_duration"], "record duration"), int(number(fields["record_count"], "record count"))
    if duration <= 0 or count < -1 or count == 0:
        raise EdfError("record duration and count must be positive")
    signals = [{} for _ in range(n)]
    for name, width in BLOCKS:
        for k in range(n):
            signals[k][name] = text(raw[at : at + width])
            at += width
    for k, s in enumerate(signals):
        for name in ("physical_min", "physical_max", "digital_min", "digital_max", "samples_per_record"):
            s[name] = number(s[name], f"signal {k + 1}: {name}")
        s |= {x: int(s[x]) for x in ("digital_min", "digital_max", "samples_per_record")}
        if not -32768 <= s["digital_min"] < s["digital_max"] <= 32767 or s["physical_min"] == s["physical_max"] or s["samples_per_record"] < 1:
            raise EdfError(f"signal {k + 1}: impossible range or number of samples")
        s |= {"index": k, "is_annotation": "Annotations" in s["label"] and s["label"].upper().startswith(("EDF", "BDF")), "fs": s["samples_per_record"] / duration}
    width = 2 * sum(s["samples_per_record"] for s in signals)
    whole, rest = divmod(size - length, width)
    if rest or whole < 1 or count not in (-1, whole):
        raise EdfError("the file's length and its record count don't agree")
    return Header(fields, signals, whole, duration, width, length)


def opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def files_of(uri: str) -> list[str]:
    from pyarrow import fs

    system, path = opened(uri)
    info = system.get_file_info(path)
    if info.type == fs.FileType.Directory:
        return sorted(f.path for f in system.get_file_info(fs.FileSelector(path)) if f.path.lower().endswith(".edf"))
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    return [path]


def header_of(system, path: str) -> Header:
    size = system.get_file_info(path).size
    with system.open_input_file(path) as f:
        first = f.read_at(min(size, 256), 0)
        n = int(first[252:256].decode("latin-1").strip() or 0) if len(first) == 256 and first[252:256].strip(b" \0").isdigit() else 0
        return parse_header(first + f.read_at(max(0, min(size, 256 * (n + 1)) - 256), 256), size)


@dataclass
class Run(InputPartition):
    uri: str
    path: str
    first: int
    last: int


class EdfSource(DataSource):
    """Options: path (a file or a folder of .edf files), records (a partition's records, else as many as fit into bytes), bytes
    (16 MB), signals (indices, all). As a sink: see edf_writer."""

    @classmethod
    def name(cls):
        return "edf"

    def schema(self):
        return RECORDS

    def reader(self, schema):
        return EdfReader(self.options)

    def writer(self, schema, overwrite):
        from lanternfish.sources.edf_writer import EdfWriter

        return EdfWriter(dict(self.options), overwrite)


class EdfReader(DataSourceReader):
    def __init__(self, options):
        self.uri = options["path"]
        self.size, self.bytes = int(options.get("records", 0)), int(options.get("bytes", PARTITION_BYTES))
        self.signals = [int(x) for x in options.get("signals", "").split(",") if x]
        self.first, self.last = 0, None

    def pushFilters(self, filters):
        """Bounds on record_index and a signal_index become part of the plan; all are checked again by Spark."""
        for f in filters:
            name, column, value = type(f).__name__, getattr(f, "attribute", ()), getattr(f, "value", None)
            if column == ("record_index",) and name in ("GreaterThanOrEqual", "GreaterThan"):
                self.first = max(self.first, int(value) + (name == "GreaterThan"))
            elif column == ("record_index",) and name in ("LessThan", "LessThanOrEqual"):
                end = int(value) + (name == "LessThanOrEqual")
                self.last = end if self.last is None else min(self.last, end)
            elif column == ("signal_index",) and name == "EqualTo":
                self.signals = [int(value)] if not self.signals or int(value) in self.signals else [-1]
            yield f

    def partitions(self):
        system, _ = opened(self.uri)
        out = []
        for path in files_of(self.uri):
            h = header_of(system, path)
            end = h.record_count if self.last is None else min(h.record_count, self.last)
            size = self.size or max(1, self.bytes // max(1, h.bytes_per_record))
            out += [Run(self.uri, path, a, min(end, a + size)) for a in range(self.first, end, size)]
        return out or [Run(self.uri, "", 0, 0)]

    def read(self, part):
        if part.first >= part.last:
            return
        system, _ = opened(part.uri)
        h = header_of(system, part.path)
        with system.open_input_file(part.path) as f:
            raw = f.read_at((part.last - part.first) * h.bytes_per_record, h.header_bytes + part.first * h.bytes_per_record)
        table = np.frombuffer(raw, "<i2").reshape(part.last - part.first, h.bytes_per_record // 2)
        ends = np.cumsum([s["samples_per_record"] for s in h.signals])
        for s in h.signals:
            k = s["index"]
            if self.signals and k not in self.signals:
                continue
            n = s["samples_per_record"]
            own = np.ascontiguousarray(table[:, ends[k] - n : ends[k]])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, n, dtype=np.int32)), pa.array(own.ravel()))
            rows = len(own)
            yield pa.RecordBatch.from_arrays([pa.array([part.path] * rows), pa.array([k] * rows, pa.int32()), pa.array(np.arange(part.first, part.last), pa.int32()), lists], ["recording", "signal_index", "record_index", "digital"])


def register(spark: SparkSession) -> None:
    """Makes the format known and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EdfSource)


def recordings(spark: SparkSession, uri: str) -> DataFrame:
    """One row for each file: its header; whether patient or recording fields may identify someone, not the fields."""
    from lanternfish.functions.labels import looks_identifying

    system, _ = opened(uri)
    rows = []
    for path in files_of(uri):
        h = header_of(system, path)
        rows.append((path, h.fields["version"], h.fields["start_date"], h.fields["start_time"], h.header_bytes, h.record_count, h.record_duration, h.duration, h.plus, h.fields["patient"], h.fields["recording"]))
    df = spark.createDataFrame(rows, "recording string, version string, start_date string, start_time string, header_bytes int, record_count int, record_duration double, duration double, is_edf_plus boolean, p string, r string")
    return df.withColumn("identifier_warning", looks_identifying(F.col("p"), F.col("r"))).drop("p", "r")


def signals(spark: SparkSession, uri: str) -> DataFrame:
    """One row for each signal, with the factor that brings its unit to microvolts where its kind has one."""
    from lanternfish.functions.labels import electrode_key, kind

    system, _ = opened(uri)
    rows = [(path, s["index"], s["label"], s["unit"], s["physical_min"], s["physical_max"], s["digital_min"], s["digital_max"], s["samples_per_record"], s["fs"], s["is_annotation"]) for path in files_of(uri) for s in header_of(system, path).signals]
    df = spark.createDataFrame(rows, "recording string, signal_index int, label string, unit string, phys_min double, phys_max double, dig_min int, dig_max int, samples_per_record int, fs double, is_annotation boolean")
    df = F.broadcast(df) if len(rows) <= FEW_SIGNALS else df
    df = df.withColumn("_key", electrode_key(F.col("label"))).withColumn("kind", kind(F.col("label"), F.col("unit"), F.col("_key"))).drop("_key")
    return df.withColumn("unit_scale", unit_scale(F.col("unit"), F.col("kind")))


def unit_scale(unit, kind):
    u = F.lower(F.translate(unit, "μ", "µ"))
    scale = F.when(u == "v", 1e6).when(u == "mv", 1e3).when(u == "nv", 1e-3).otherwise(1.0)
    return F.when(kind.isin("eeg", "eog", "emg", "ekg"), scale).otherwise(1.0)


def physical(digital, dig_min, dig_max, phys_min, phys_max, scale):
    """A digital value in physical units; a falling calibration is allowed."""
    return ((digital - dig_min) / (dig_max - dig_min) * (phys_max - phys_min) + phys_min) * scale


def samples(records: DataFrame, signals_: DataFrame) -> DataFrame:
    """(recording, track, i, v) of records with their signals' calibration, in single precision; annotation signals go."""
    long = records.join(signals_.where(~F.col("is_annotation")), ["recording", "signal_index"]).select("*", F.posexplode("digital").alias("pos", "d"))
    v = physical(F.col("d").cast("double"), F.col("dig_min"), F.col("dig_max"), F.col("phys_min"), F.col("phys_max"), F.col("unit_scale"))
    return long.select("recording", F.col("signal_index").alias("track"), (F.col("record_index").cast("long") * F.col("samples_per_record") + F.col("pos")).alias("i"), v.cast("float").cast("double").alias("v"))


def records_between(records: DataFrame, record_duration: float, start: float, seconds: float) -> DataFrame:
    """Whole records from the one that holds start, ceil(seconds / duration) of them: an unaligned start isn't made up for at the end."""
    first = int(start // record_duration)
    return records.where((F.col("record_index") >= first) & (F.col("record_index") < first + int(-(-seconds // record_duration))))


_ONSET = re.compile(r"^[+-]\d+(\.\d*)?$")
_LENGTH = re.compile(r"^\d+(\.\d*)?$")


def parse_tals(raw: bytes) -> list[tuple[float, float | None, str]]:
    """(onset, duration, text) of the time-stamped lists in one record's annotation bytes; bytes that aren't UTF-8 are refused."""
    try:
        told = raw.decode("utf-8")
    except UnicodeDecodeError as e:
        raise EdfError("annotations aren't UTF-8") from e
    out = []
    for tal in told.split("\0"):
        if not tal:
            continue
        stamp, *texts = tal.split("\x14")
        onset, _, length = stamp.partition("\x15")
        if not _ONSET.match(onset) or length and not _LENGTH.match(length):
            raise EdfError(f"bad time stamp {stamp!r}")
        out += [(float(onset), float(length) if length else None, t) for t in texts if t]
    return out


def annotations(spark: SparkSession, uri: str) -> DataFrame:
    """(recording, onset, duration, text) of all annotation signals."""
    register(spark)
    own = signals(spark, uri).where("is_annotation").select("recording", "signal_index")
    records = spark.read.format("edf").load(uri).join(own, ["recording", "signal_index"])

    def parse(batches):
        for batch in batches:
            rows = [(r, *t) for r, d in zip(batch.column("recording").to_pylist(), batch.column("digital").to_pylist(), strict=True) for t in parse_tals(np.array(d, "<i2").tobytes())]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.float64(), pa.float64(), pa.string()), strict=True)], ["recording", "onset", "duration", "text"])

    return records.select("recording", "digital").mapInArrow(parse, "recording string, onset double, duration double, text string")


def to_events(rows: DataFrame) -> DataFrame:
    """File annotations as comment events on all tracks."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("recording").orderBy("onset", "text")) - 1
    return rows.select(F.concat(F.lit("edf-"), k.cast("string")).alias("id"), F.col("onset").alias("start"), (F.col("onset") + F.coalesce("duration", F.lit(0.0))).alias("end"), F.lit("comment").alias("type"), "text", F.lit("file").alias("source"), F.lit(1.0).alias("confidence"))


def rate_summary(signals_: DataFrame) -> DataFrame:
    """(recording, rates, mixed, primary): distinct rates to a thousandth; the first microvolt signal's is primary, of signals with one index the least."""
    fs = F.floor(F.col("fs") * 1000 + 0.5) / 1000
    own = signals_.where(~F.col("is_annotation")).withColumn("rate", fs)
    micro = F.lower(F.translate("unit", "μ", "µ")).isin("uv", "µv")
    place = F.struct("signal_index", "rate")
    return own.groupBy("recording").agg(F.array_sort(F.collect_set("rate")).alias("rates"), F.coalesce(F.min(F.when(micro, place)), F.min(place))["rate"].alias("primary")).withColumn("mixed", F.size("rates") > 1)


def build(signals_: list[tuple[str, np.ndarray]], fs: int = 200, record: float = 0.1, physical_max: float = 3200.0, notes: list[bytes] | None = None, unit: str = "uV") -> bytes:
    """An EDF+C file of signals in microvolts with an annotation signal of 25 samples a record, for tests and export."""
    n, per = len(signals_) + 1, int(fs * record)
    count = max(1, len(signals_[0][1]) // per)
    pad = lambda s, w: str(s).encode("latin-1")[:w].ljust(w)
    head = b"".join(pad(v, w) for v, (_, w) in zip(("0", "X X X X", "Startdate X X X X", "01.01.00", "00.00.00", 256 * (n + 1), "EDF+C", count, f"{record:g}", n), FIXED, strict=True))
    values = {"label": [*(s for s, _ in signals_), "EDF Annotations"], "transducer": [""] * n, "unit": [unit] * (n - 1) + [""], "physical_min": [f"{-physical_max:g}"] * n, "physical_max": [f"{physical_max:g}"] * n, "digital_min": [-32768] * n, "digital_max": [32767] * n, "prefilter": [""] * n, "samples_per_record": [per] * (n - 1) + [25], "reserved": [""] * n}
    head += b"".join(pad(v, w) for name, w in BLOCKS for v in values[name])
    body = []
    for k in range(count):
        for _, x in signals_:
            d = np.floor((x[k * per : (k + 1) * per] + physical_max) / (2 * physical_max) * 65535 - 32768 + 0.5)
            body.append(np.clip(d, -32768, 32767).astype("<i2").tobytes())
        note = notes[k] if notes and k < len(notes) else b""
        body.append((b"+%g\x14\x14\0" % (k * record) + note)[:50].ljust(50, b"\0"))
    return head + b"".join(body)


def wav(left: np.ndarray, right: np.ndarray, rate: int, bits: int = 16) -> bytes:
    """A RIFF file of stereo samples of 16 or 24 bits, clamped to full scale."""
    if bits not in (16, 24):
        raise ValueError("16 or 24 bits")
    x = np.clip(np.column_stack([left, right]), -1, 1) * (32767 if bits == 16 else 8388607)
    v = np.trunc(x).astype("<i4")
    raw = v.astype("<i2").tobytes() if bits == 16 else np.ascontiguousarray(v.view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()
    width = 2 * bits // 8
    return b"RIFF" + struct.pack("<I", 36 + len(raw)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, rate, rate * width, width, bits) + b"data" + struct.pack("<I", len(raw)) + raw
