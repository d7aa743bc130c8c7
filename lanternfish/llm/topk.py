"""Exact top-k inner products on a bit-sliced index.

Vectors are quantised to integers. A block of the index holds up to a fixed
number of rows; for each attribute it has one bitmap over its rows for each bit
of the value less the attribute's least value in the block. For a query the
slices are weighted by the bits of the query's components and added up with
bitmap arithmetic: carry-save adders reduce all slices of one weight, and carries
go to the next. The sums' slices, from the most significant one downward, select
the k best rows; rows that tie at the border are resolved exactly, by vec_id.

Queries meet every block: both travel in packed blocks; index blocks are dealt to
groups of a few, moved once and held, and the packed queries stream past them.
Each group keeps k rows for a query, so what is left to rank grows with queries
times groups, not with all pairs.

Defined results: a vector that is null or has null or non-finite components takes
no part, nor does a null vec_id; components of any size count, sums are exact, and
a component of 2**62 or more after quantising or a score beyond 64 bits among the
results raises an error; vectors of other lengths count as if zeros followed; repeated rows are
rows of their own, as candidates and as queries; a query's own rows are all with
its vec_id; an empty table gives no rows; columns other than vec_id and embedding
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternfish.llm.common import parts, tuned

ROWS = 16_384
QUERIES = 512
#: Index blocks that a task holds at once, about.
HELD = 4


def quantised(df: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v array<long> of the rows that take part."""
    fits = lambda e: F.abs(e.cast("double") * scale) < float(1 << 62)
    x = F.transform("embedding", lambda e: F.when(fits(e), F.floor(e.cast("double") * scale)).otherwise(F.raise_error("a component is too large").cast("long")))
    finite = F.forall("embedding", lambda e: F.coalesce(~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")), F.lit(False)))
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(ok).select("vec_id", x.alias("v"))


PACK = "part long, width int, size int, ids binary, m binary"


def packs(df: DataFrame, rows: int) -> DataFrame:
    """Blocks of up to rows vectors, as ids and a matrix of integers of ``size`` bytes; part numbers them within the partitions."""

    def pack(batches):
        from pyspark import TaskContext

        first, ids, vectors = TaskContext.get().partitionId() << 32, [], []

        def block(k):
            width = max(map(len, vectors))
            m = np.zeros((len(vectors), width), np.int64)
            for i, v in enumerate(vectors):
                m[i, : len(v)] = v
            size = 4 if not m.size or -(1 << 31) <= m.min() <= m.max() < 1 << 31 else 8
            return pa.RecordBatch.from_pydict({"part": pa.array([first + k], pa.int64()), "width": pa.array([width], pa.int32()), "size": pa.array([size], pa.int32()), "ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), "m": pa.array([m.astype(f"<i{size}").tobytes()], pa.binary())})

        k = 0
        for batch in batches:
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                ids.append(i)
                vectors.append(v)
                if len(ids) == rows:
                    yield block(k)
                    k, ids, vectors = k + 1, [], []
        if ids:
            yield block(k)

    return df.mapInArrow(pack, PACK)


class Sliced:
    """The bit-sliced index of one block."""

    def __init__(self, ids: np.ndarray, m: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, m = ids[order], m[order].astype(np.int64)
        self.n = len(ids)
        self.words = (self.n + 63) // 64
        self.least = m.min(axis=0)
        self.top = m.max(axis=0)
        self.slices: list[list[np.ndarray]] = []
        for j in range(m.shape[1]):
            value = m[:, j] - self.least[j]
            self.slices.append([self.bits((value >> b) & 1) for b in range(int(value.max()).bit_length())])

    def bits(self, flags: np.ndarray) -> np.ndarray:
        raw = np.zeros(self.words * 64, np.uint8)
        raw[: self.n] = flags
        return np.packbits(raw, bitorder="little").view(np.uint64)

    def sums(self, q: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of score - shift for all rows, from bit 0 on, none of them negative; and shift.

        A negative component counts down from the attribute's largest value: its slices' complements are added.
        """
        columns: list[list[np.ndarray]] = []
        shift = 0
        for j, c in enumerate(q.tolist()[: len(self.slices)]):
            own = self.slices[j]
            if c < 0:
                # v = least + x, and x = 2**bits - 1 - complement(x).
                shift += c * (int(self.least[j]) + (1 << len(own)) - 1)
                own = [~s for s in own]
                c = -c
            else:
                shift += c * int(self.least[j])
            a = 0
            while c >> a:
                if c >> a & 1:
                    for b, s in enumerate(own):
                        while len(columns) <= a + b:
                            columns.append([])
                        columns[a + b].append(s)
                a += 1
        out, at = [], 0
        zero = np.zeros(self.words, np.uint64)
        while at < len(columns):
            column = columns[at]
            while len(column) > 1:
                carries = []
                rest = []
                k = 0
                while k + 2 < len(column):
                    x, y, z = column[k : k + 3]
                    half = x ^ y
                    rest.append(half ^ z)
                    carries.append((x & y) | (half & z))
                    k += 3
                if len(column) - k == 2 and not rest:
                    x, y = column[k:]
                    rest.append(x ^ y)
                    carries.append(x & y)
                else:
                    rest += column[k:]
                column = rest
                if at + 1 == len(columns):
                    columns.append([])
                columns[at + 1] += carries
            out.append(column[0] if column else zero)
            at += 1
        return out, shift

    def best(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the k best rows but those of id own; ties to smaller ids."""
        slices, shift = self.sums(q)
        live = np.ones(self.n, np.uint8)
        a, b = np.searchsorted(self.ids, own, "left"), np.searchsorted(self.ids, own, "right")
        live[a:b] = 0
        tied, sure = self.bits(live), np.zeros(self.words, np.uint64)
        for s in reversed(slices):
            both = tied & s
            n = int(np.bitwise_count(sure | both).sum())
            if n > k:
                tied = both
            else:
                sure = sure | both
                tied = tied & ~s
                if n == k:
                    break
        rows = self.rows(sure)
        if len(rows) < k:
            rows = np.concatenate([rows, self.rows(tied)[: k - len(rows)]])
        word, bit = rows >> 6, (rows & 63).astype(np.uint64)
        # Python's integers: sums of large components are wider than a word until the shift is added.
        scores = [shift] * len(rows)
        for at, s in enumerate(slices):
            for i in np.flatnonzero((s[word] >> bit) & np.uint64(1)).tolist():
                scores[i] += 1 << at
        if any(not -(1 << 63) <= x < 1 << 63 for x in scores):
            raise OverflowError("a score exceeds 64 bits")
        return rows, np.array(scores, np.int64)

    def rows(self, bits: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little")[: self.n])


def search(df: DataFrame, k: int = 5, scale: int = 256, every: int = 50, rows: int = ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row with vec_id divisible by every the k best others of df(vec_id, embedding)."""
    spark = tuned(df.sparkSession)
    n = parts(spark)
    all_ = quantised(df)
    groups = max(n, -(-df.count() // (HELD * rows)))
    index = packs(all_, rows).select(F.pmod(F.xxhash64("part"), F.lit(groups)).alias("g"), F.lit(0).alias("asked"), "*")
    asked = packs(all_.where(F.col("vec_id") % every == 0), QUERIES)
    asked = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"), F.lit(1).alias("asked"), "*")

    def answer(batches):
        group, held = None, []
        for batch in batches:
            out: dict[str, list] = {"q": [], "query_id": [], "vec_id": [], "score": []}
            for g, asked_, part, w, size, ids, m in zip(*(batch.column(c).to_pylist() for c in ("g", "asked", "part", "width", "size", "ids", "m")), strict=True):
                if g != group:
                    group, held = g, []
                ids, m = np.frombuffer(ids, np.int64), np.frombuffer(m, f"<i{size}").reshape(-1, w)
                if not asked_:
                    held.append(Sliced(ids, m))
                    continue
                for j, (i, q) in enumerate(zip(ids.tolist(), m, strict=True)):
                    found = [(block.ids[at], scores) for block in held for at, scores in (block.best(q, i, k),)]
                    if not found:
                        continue
                    others, scores = (np.concatenate(x) for x in zip(*found, strict=True))
                    top = np.lexsort((others, ~scores))[:k]
                    out["q"] += [part * QUERIES + j] * len(top)
                    out["query_id"] += [i] * len(top)
                    out["vec_id"] += others[top].tolist()
                    out["score"] += scores[top].tolist()
            yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in out.items()})

    rows_ = index.unionByName(asked).repartition(n, "g").sortWithinPartitions("g", "asked", "part")
    found = rows_.mapInArrow(answer, "q long, query_id long, vec_id long, score long")
    # q: the query's row, as rows may repeat.
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
with e as (
  select row_number() over () as i, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), u as (
  select i, vec_id, unnest(v) as x, generate_subscripts(v, 1) as j from e
), s as (
  select q.i as q, c.i as c, q.vec_id as query_id, c.vec_id, cast(sum(q.x * c.x) as bigint) as score
  from u q join u c on q.j = c.j and q.vec_id <> c.vec_id
  where q.vec_id % 50 = 0 group by q.i, c.i, q.vec_id, c.vec_id
), r as (
  select *, cast(row_number() over (partition by q order by score desc, vec_id) as integer) as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""
