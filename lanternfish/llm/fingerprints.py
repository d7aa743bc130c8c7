"""Document fingerprints from content-defined chunks.

A gear hash rolls over the text's bytes: bit i of the hash depends on the last
i + 1 bytes, and only its high half is tested, so a border depends on 16 bytes
around it and shifts with them. Cutting is normalised: from the least to the
usual length a border needs more zero bits, from there to the longest fewer.
A fingerprint is the set of chunk digests with their lengths, sorted, in base64.
Likeness is containment weighted by length, the smaller of both directions: the
bytes in digests that both have, over the larger of both sums.

For edited texts documents stand in descending order of doc_id; they are dealt
by ranges of doc_id, and each range also gets the one document that follows it.

Defined results: a null text is empty; an empty text has an empty fingerprint,
like another empty one (1.0) and unlike others (0.0); null doc_ids come last in
the order; documents with one doc_id follow each other by text; an empty table
gives no rows; a table of one document has itself as the next; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.llm.common import documents, parts, steps, tuned
from lanternfish.llm.textops import bytes_of

LEAST, USUAL, MOST = 16, 40, 160
HARD = np.uint32(0b1111110 << 25)
EASY = np.uint32(0b1111000 << 25)
#: A number for each byte, from a seeded generator.
GEAR = np.array([random.Random(f"gear {b}").getrandbits(32) for b in range(256)], np.uint32)
#: A chunk in a fingerprint: digest and length.
ENTRY = np.dtype([("digest", "<u8"), ("length", "<u2")])


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of all chunks of the rows, in order, and for each row the number of its first chunk (one more at the end)."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        later = h[step:] + (h[:-step] << np.uint32(step))
        h = np.concatenate([h[:step], later]) if len(h) > step else h
    hard, easy = np.flatnonzero((h & HARD) == 0) + 1, np.flatnonzero((h & EASY) == 0) + 1
    far = np.int64(1 << 62)
    hard, easy = np.append(hard, far), np.append(easy, far)
    at, row = offsets[:-1].copy(), np.arange(len(offsets) - 1)
    stop = offsets[1:]
    live = at < stop
    at, row, stop = at[live], row[live], stop[live]
    ends, rows = [], []
    while len(at):
        first = hard[np.searchsorted(hard, at + LEAST)]
        second = easy[np.searchsorted(easy, at + USUAL)]
        end = np.where(first < at + USUAL, first, np.minimum(second, at + MOST))
        end = np.minimum(end, stop)
        ends.append(end)
        rows.append(row)
        live = end < stop
        at, row, stop = end[live], row[live], stop[live]
    if not ends:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ends = np.sort(np.concatenate(ends))
    return ends, np.concatenate([[0], np.cumsum(np.bincount(np.concatenate(rows), minlength=len(offsets) - 1))])


def chunk_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Each row's distinct chunks as sorted entries."""
    ends, firsts = chunk_ends(data, offsets)
    starts = np.empty_like(ends)
    if len(ends):
        starts[0], starts[1:] = 0, ends[:-1]
    raw = memoryview(data.tobytes())
    entries = np.empty(len(ends), ENTRY)
    entries["digest"] = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(ends))
    entries["length"] = ends - starts
    out = []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        _, first = np.unique(entries["digest"][a:b], return_index=True)
        out.append(entries[a:b][first])
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of two chunk sets, 0 to 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.searchsorted(b["digest"], a["digest"])
    at[at == len(b)] = 0
    shared = int(a["length"][b["digest"][at] == a["digest"]].sum(dtype=np.int64))
    return shared / max(int(a["length"].sum(dtype=np.int64)), int(b["length"].sum(dtype=np.int64)))


def shown(a: np.ndarray) -> str:
    return base64.b64encode(a.tobytes()).decode()


def parsed(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), ENTRY)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(df: DataFrame) -> DataFrame:
    """doc_id, fingerprint of each row of df(doc_id, text)."""

    def mark(batches):
        for table in steps(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": table["doc_id"].combine_chunks(), "fingerprint": pa.array(map(shown, chunk_sets(*bytes_of(table["text"]))), pa.string())})

    tuned(df.sparkSession)
    return documents(df).mapInArrow(mark, "doc_id long, fingerprint string")


def with_edits(df: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of df(doc_id, text).

    The edited text has its last half replaced by the start of the next document in descending doc_id, after the last the first.
    """
    spark = tuned(df.sparkSession)
    docs = documents(df)
    n = 3 * parts(spark)
    # Bounds of about equal ranges; a number of them that follows the partitions, not the rows.
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n).alias("c")).first()["c"] if n > 1 else []
    cuts = sorted(set(cuts or []))
    # Ranges in descending order: range r holds the ids over cuts[r] and up to the cut above; nulls are in the last.
    descending = F.array(*[F.lit(-c).cast("long") for c in reversed(cuts)]) if cuts else F.array().cast("array<long>")
    place = F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(F.size(F.filter(descending, lambda c: c < -F.col("doc_id")))) if cuts else F.lit(0)
    docs = docs.withColumn("r", place.cast("int"))
    tops = docs.select("doc_id", "r").groupBy("r").agg(F.max("doc_id").alias("top")).orderBy("r").collect()
    order = [t["r"] for t in tops]
    before = {r: order[i - 1] for i, r in enumerate(order)}
    # The documents with the highest id of a range go to the range before it as well, those of the first to the last.
    to = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("r")) if before else F.lit(0)
    top = F.element_at(F.create_map(*[x for t in tops for x in (F.lit(t["r"]), F.lit(t["top"]).cast("long"))]), F.col("r")) if tops else F.lit(None)
    guests = docs.where(F.col("doc_id").eqNullSafe(top)).select("doc_id", "text", to.alias("r"), F.lit(1).alias("guest"))
    rows = docs.select("doc_id", "text", "r", F.lit(0).alias("guest")).unionByName(guests)
    rows = rows.repartition(parts(spark), "r").sortWithinPartitions("r", "guest", F.desc_nulls_last("doc_id"), "text")

    def work(batches):
        last = None
        for table in steps(batches):
            if last is not None:
                table = pa.concat_tables([last, table]).combine_chunks()
            yield from made(table.slice(0, table.num_rows - 1), table.slice(1))
            last = table.slice(table.num_rows - 1)

    def made(own: pa.Table, following: pa.Table):
        """Rows whose next row is in the same range; the last row of a range is a guest."""
        use = [i for i, (g, a, b) in enumerate(zip(own["guest"].to_pylist(), own["r"].to_pylist(), following["r"].to_pylist(), strict=True)) if not g and a == b]
        if not use:
            return
        own, following = own.take(use).combine_chunks(), following.take(use).combine_chunks()
        texts, nexts = own["text"].to_pylist(), following["text"].to_pylist()
        changed = [edited(a, b) for a, b in zip(texts, nexts, strict=True)]
        raw = [t.encode() for t in changed]
        first = chunk_sets(*bytes_of(own["text"]))
        other = chunk_sets(*bytes_of(pa.array(raw, pa.large_binary())))
        # The next row's chunks are mostly those of the row that follows here.
        lone = [i for i in range(len(use)) if i + 1 == len(use) or use[i + 1] != use[i] + 1]
        beyond = dict(zip(lone, chunk_sets(*bytes_of(following["text"].combine_chunks().take(pa.array(lone, pa.int64())))), strict=True))
        near = [likeness(first[i], beyond[i] if i in beyond else first[i + 1]) for i in range(len(use))]
        yield pa.RecordBatch.from_pydict({
            "doc_id": own["doc_id"].combine_chunks(), "n_chars": pa.array(map(len, texts), pa.int64()), "edited_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in raw], pa.string()),
            "fingerprint": pa.array(map(shown, first), pa.string()), "edited_fingerprint": pa.array(map(shown, other), pa.string()),
            "near_edited": pa.array([likeness(a, b) for a, b in zip(first, other, strict=True)], pa.float64()), "near_next": pa.array(near, pa.float64()),
        })

    return rows.mapInArrow(work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
