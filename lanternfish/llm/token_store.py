"""Token ids in binary shards with a minimal perfect hash index.

Shards hold raw ids (two or four bytes each, little-endian), documents in
ascending doc_id, each followed by an end id. A document's key is its doc_id and
its number among rows with the same doc_id. Keys are dealt by hash into index
blocks of bounded size; a block's minimal perfect hash sends each key to a place of
its own, where a 32-bit fingerprint (to refuse keys that were never stored), the
shard, the offset and the number of ids stand. So a keyed read costs one block,
one probe and one seek, whatever the store's size.

A folder holds ids/shard-*.ids, index/block-*.mph and a table of what was written.
Files are written under an attempt's name and renamed in place of what an earlier
attempt left, so a task that runs again leaves the same file. Any file system that pyarrow opens by its URI will do.

Defined results: a null or empty text is its end id alone; null doc_ids come
first; rows that share a doc_id follow each other by text and are numbered; an
empty table gives a store without shards and no rows; columns other than doc_id and text
are not read.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanternfish.llm.bpe import read_tokenizer
from lanternfish.llm.common import documents, parts, steps, tuned
from lanternfish.llm.textops import mixed
from lanternfish.llm.tokens import Cut, vocabulary

#: Keys in an index block, about.
BLOCK_KEYS = 50_000
_NUMBER = 0x9E3779B97F4A7C15
_MARK = np.uint64(0x8EBC6AF09C88C6E3)
RECORD = np.dtype([("mark", "<u4"), ("shard", "<u4"), ("at", "<u8"), ("n", "<u8")])


def opened(uri: str):
    """A file system and a path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def settle(system, part: str, path: str) -> None:
    """Renames a written file. Where another attempt's file stands already, as some systems refuse to replace it, that one goes first: it holds the same."""
    from pyarrow.fs import FileType

    if system.get_file_info(path).type != FileType.NotFound:
        system.delete_file(path)
    system.move(part, path)


def put(uri: str, data: bytes, attempt: int) -> None:
    system, path = opened(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(f"{path}.{attempt}.part") as out:
        out.write(data)
    settle(system, f"{path}.{attempt}.part", path)


def key_hash(ids: np.ndarray, missing: np.ndarray, number: np.ndarray) -> np.ndarray:
    """64 bits for each key (doc_id or none, number)."""
    h = mixed(ids.astype(np.int64).view(np.uint64) + np.uint64(_NUMBER))
    h = mixed(h ^ mixed(number.astype(np.int64).view(np.uint64)))
    return np.where(missing, mixed(h ^ _MARK), h)


class Places:
    """A minimal perfect hash: level by level, keys that are alone at their bit stay there; a key's place is the bits before it."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = []
        n = 0
        for words in levels:
            c = np.bitwise_count(words).astype(np.int64)
            self.before.append(n + np.cumsum(c) - c)
            n += int(c.sum())
        self.n = n

    @staticmethod
    def bit(h: np.ndarray, level: int, words: int) -> np.ndarray:
        return (mixed(h + np.uint64((level + 1) * _NUMBER % (1 << 64))) % np.uint64(words * 64)).astype(np.int64)

    @classmethod
    def of(cls, h: np.ndarray) -> "Places":
        levels, rest = [], h
        while len(rest):
            if len(levels) > 100:
                raise ValueError("two keys have one 64-bit hash")
            words = max(1, 2 * len(rest) // 64)
            at = cls.bit(rest, len(levels), words)
            alone = np.bincount(at, minlength=words * 64) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64).copy())
            rest = rest[~alone[at]]
        return cls(levels)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Each key's place; -1 for some that were never stored, others get the place of another key."""
        out = np.full(len(h), -1, np.int64)
        open_ = np.arange(len(h))
        for level, words in enumerate(self.levels):
            at = self.bit(h[open_], level, len(words))
            word, shift = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> shift) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << shift) - np.uint64(1)))
            out[open_[hit]] = self.before[level][at[hit] >> 6] + below[hit]
            open_ = open_[~hit]
        return out


def marks(h: np.ndarray) -> np.ndarray:
    return (mixed(h ^ _MARK) >> np.uint64(32)).astype(np.uint32)


def block_bytes(h: np.ndarray, records: np.ndarray) -> bytes:
    """An index block: a line of JSON, the levels' words, the records by place."""
    places = Places.of(h)
    table = np.zeros(len(h), RECORD)
    records["mark"] = marks(h)
    table[places.find(h)] = records
    head = json.dumps({"keys": len(h), "levels": [len(x) for x in places.levels]}).encode() + b"\n"
    return head + b"".join(x.tobytes() for x in places.levels) + table.tobytes()


class Block:
    def __init__(self, raw: bytes):
        end = raw.index(b"\n") + 1
        head = json.loads(raw[:end])
        levels = []
        for n in head["levels"]:
            levels.append(np.frombuffer(raw, np.uint64, n, end) if end % 8 == 0 else np.frombuffer(raw[end : end + 8 * n], np.uint64))
            end += 8 * n
        self.places = Places(levels)
        self.records = np.frombuffer(raw[end:], RECORD)

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, records) of the keys."""
        at = self.places.find(h)
        got = self.records[np.maximum(at, 0)] if len(self.records) else np.zeros(len(h), RECORD)
        return (at >= 0) & (got["mark"] == marks(h)), got


def hashes(table: pa.Table) -> np.ndarray:
    ids = table["doc_id"].combine_chunks()
    return key_hash(ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), table["number"].to_numpy())


def write_store(df: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Writes df(doc_id, text) under the URI path, which must not exist."""
    spark = tuned(df.sparkSession)
    source = spark.sparkContext.broadcast(read_tokenizer(tokenizer))
    docs = documents(df)
    n = parts(spark)

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        shard, vocab, at, last = task.partitionId(), vocabulary(source.value), 0, None
        system, where = opened(f"{path}/ids/shard-{shard:06d}.ids")
        number, out = 0, None
        for table in steps(batches):
            if out is None:
                system.create_dir(where.rsplit("/", 1)[0], recursive=True)
                out = system.open_output_stream(f"{where}.{task.taskAttemptId()}.part")
            cut = Cut(table["text"])
            flat, ends = cut.joined(vocab.encode(cut.distinct), vocab.dtype)
            out.write(np.insert(flat, ends[1:], end_id).astype(vocab.dtype, copy=False).tobytes())
            sizes = np.diff(ends) + 1
            offsets = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            numbers = []
            for i in table["doc_id"].to_pylist():
                number = number + 1 if last == (i,) else 0
                last = (i,)
                numbers.append(number)
            yield pa.RecordBatch.from_pydict({"doc_id": table["doc_id"].combine_chunks(), "number": pa.array(numbers, pa.int64()), "shard": pa.array([shard] * len(numbers), pa.int64()), "at": pa.array(offsets, pa.int64()), "n": pa.array(sizes, pa.int64())})
        if out is not None:
            out.close()
            settle(system, f"{where}.{task.taskAttemptId()}.part", where)

    rows = docs.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    rows.mapInArrow(write, "doc_id long, number long, shard long, at long, n long").write.parquet(f"{path}/written")
    written = spark.read.schema("doc_id long, number long, shard long, at long, n long").parquet(f"{path}/written")
    blocks = max(1, -(-written.count() // BLOCK_KEYS))

    def index(table: pa.Table) -> pa.Table:
        from pyspark import TaskContext

        records = np.zeros(table.num_rows, RECORD)
        for c in ("shard", "at", "n"):
            records[c] = table[c].to_numpy()
        block = table["block"][0].as_py()
        put(f"{path}/index/block-{block:06d}.mph", block_bytes(hashes(table), records), TaskContext.get().taskAttemptId())
        return pa.table({"block": pa.array([block], pa.int64()), "keys": pa.array([table.num_rows], pa.int64())})

    made = written.withColumn("block", block_of(blocks)).groupBy("block").applyInArrow(index, "block long, keys long")
    made.write.parquet(f"{path}/blocks")
    itemsize = vocabulary(source.value).dtype.itemsize
    spark.createDataFrame([(blocks, itemsize, end_id)], "blocks long, itemsize int, end_id int").coalesce(1).write.parquet(f"{path}/meta")


def block_of(blocks: int):
    return F.pmod(F.xxhash64("doc_id", "number"), F.lit(blocks)).cast("long")


def read_store(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """doc_id, number, start, n_tokens, ids (the stored bytes), itemsize for each of keys(doc_id, number) that the store holds.

    start: the ids of all documents before it, from the lengths of the shards' files.
    """
    spark = tuned(spark)
    meta = spark.read.parquet(f"{path}/meta").first()
    blocks, itemsize = meta["blocks"], meta["itemsize"]

    def look(table: pa.Table) -> pa.Table:
        system, where = opened(f"{path}/index/block-{table['block'][0].as_py():06d}.mph")
        from pyarrow.fs import FileType

        if system.get_file_info(where).type == FileType.NotFound:
            found, got = np.zeros(table.num_rows, bool), np.zeros(table.num_rows, RECORD)
        else:
            with system.open_input_file(where) as f:
                found, got = Block(f.read()).look(hashes(table))
        out = pa.table({"doc_id": table["doc_id"], "number": table["number"], **{c: pa.array(got[c].astype(np.int64)) for c in ("shard", "at", "n")}})
        return out.filter(pa.array(found))

    def fetch(batches):
        held, f = None, None
        for batch in batches:
            ids = []
            for shard, at, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "at", "n")), strict=True):
                if shard != held:
                    system, where = opened(f"{path}/ids/shard-{shard:06d}.ids")
                    held, f = shard, system.open_input_file(where)
                ids.append(f.read_at(n * itemsize, at * itemsize))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "number", "shard", "at", "n")), pa.array(ids, pa.binary())], ["doc_id", "number", "shard", "at", "n", "ids"])

    found = keys.select("doc_id", "number").withColumn("block", block_of(blocks)).groupBy("block").applyInArrow(look, "doc_id long, number long, shard long, at long, n long")
    found = found.repartition(parts(spark), "shard").sortWithinPartitions("shard", "at")
    got = found.mapInArrow(fetch, "doc_id long, number long, shard long, at long, n long, ids binary")
    starts = shard_starts(spark, path, itemsize)
    return got.join(F.broadcast(starts), "shard").select("doc_id", "number", (F.col("begin") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), "ids", F.lit(itemsize).alias("itemsize"))


def shard_starts(spark: SparkSession, path: str, itemsize: int) -> DataFrame:
    """(shard, begin): the ids in all shards before; as many rows as shards, which is at most the number of partitions."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/ids")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files = [(int(f.getPath().getName()[6:12]), f.getLen() // itemsize) for f in system.listStatus(folder) if f.getPath().getName().endswith(".ids")] if system.exists(folder) else []
    begins, total = [], 0
    for shard, n in sorted(files):
        begins.append((shard, total))
        total += n
    return spark.createDataFrame(begins, "shard long, begin long")


def numbered(df: DataFrame) -> DataFrame:
    """The keys of df's rows."""
    ids = df.select(F.col("doc_id").cast("long").alias("doc_id"))
    return ids.withColumn("number", (F.row_number().over(Window.partitionBy("doc_id").orderBy(F.lit(0))) - 1).cast("long"))


def checksums(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as unsigned 32-bit integers) of read_store's rows."""

    def check(batches):
        for batch in batches:
            kinds = batch.column("itemsize").to_pylist()
            crc = [zlib.crc32(np.frombuffer(b, f"<u{k}").astype("<u4").tobytes()) for b, k in zip(batch.column("ids").to_pylist(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids", "itemsize").mapInArrow(check, "doc_id long, start long, n_tokens long, ids_crc32 long")
