"""Exact similarity join of documents on n-gram sets, and the groups that its links form.

Documents with one set of shingles are one class. Classes are dealt into tiles so
that every pair that can link meets in one: within a band of sizes, a set is cut
by hash into so many parts that sets which link must agree on a whole part (more
parts than they can differ in shingles), and a tile holds the classes with one
such part. Sets with too many empty parts enter the tiles of their prefix as well
(the least shingles, of which linked sets share one). Nothing is lost, and tiles
rarely hold classes that aren't nearly alike.

In a tile, a first round compares classes only with one pivot, the class with
the most tiles; its links already join most groups. Classes that are in one
component need no more comparing. Where a tile still holds several components,
its classes are cut into squares of bounded size and compared by hashed bitmaps:
their differing bits bound the overlap from above, and the pairs that remain are
settled by intersecting sorted arrays of hashes (64 bits).

Defined results: A-Z count as lower case; a null, empty or wordless text has no
shingles and links with nothing; a text of fewer words than a shingle has its
whole sequence as the only one; repeated rows are one class; a null doc_id is
never a component's id while another is there; an empty table gives no rows;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from itertools import count as counted

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.llm.common import drop_path, few, parts, release, steps, stored, trim, tuned
from lanternfish.llm.components import connected
from lanternfish.llm.textops import LOWER, bytes_of, mixed, sequence_hashes, word_hashes, word_spans

_PART = np.uint64(0xA24BAED4963EE407)
_SUM = np.uint64(0x9FB21C651E98DF25)
_PREFIX = np.uint64(0xE7037ED1A0B428DB)
_SQUARE = 256
#: Bytes of text whose sets are in memory at once.
STEP = 3 << 19


def shingle_sets(column: pa.ChunkedArray, k: int) -> list[np.ndarray]:
    """Each row's distinct shingles as sorted 64-bit hashes."""
    data, offsets = bytes_of(column)
    data = LOWER[data]
    starts, ends, firsts = word_spans(data, offsets)
    h = word_hashes(data, starts, ends)
    seq = sequence_hashes(h, k)
    out = []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(seq[a : b - k + 1]))
        else:
            out.append(sequence_hashes(h[a:b], b - a) ^ np.uint64(b - a) if b > a else h[:0])
    return out


def set_id(s: np.ndarray) -> int:
    """64 bits that stand for a set of shingles; 0 for the empty one."""
    if not len(s):
        return 0
    return int(mixed(np.array([mixed(s ^ _SUM).sum(dtype=np.uint64) ^ np.uint64(len(s))], np.uint64)).view(np.int64)[0]) or 1


class Bands:
    """Bands of set sizes, and how many parts the sets of a band are cut into."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low, self.high = [1], [1]

    def of(self, n: int) -> int:
        while self.high[-1] < n:
            self.low.append(self.high[-1] + 1)
            self.high.append(max(self.low[-1], self.low[-1] * 7 // 5))
        return int(np.searchsorted(self.high, n))

    def parts(self, band: int) -> tuple[int, int]:
        """(parts, spare): linked sets of at most the band's size agree on spare + 1 parts or more.

        spare: the empty parts that hardly any set of the band exceeds.
        """
        most = (self.den - self.num) * 2 * self.high[band] // (self.den + self.num)
        empty = (most + 1) * math.exp(-self.low[band] * self.num / self.den / (most + 1))
        spare = int(empty + 4 * math.sqrt(empty) + 1) if most else 0
        return most + 1 + spare, spare

    def wanted(self, n: int) -> list[int]:
        """The bands in which a set of n meets those it can link with: from its own to that of the largest such set."""
        return list(range(self.of(n), self.of(n * self.den // self.num) + 1))


def tile_keys(s: np.ndarray, bands: Bands) -> np.ndarray:
    """The tiles of a set."""
    out, prefix = [], False
    n = len(s)
    value = mixed(s ^ _SUM)
    where = mixed(s ^ _PART)
    for band in bands.wanted(n):
        m, spare = bands.parts(band)
        part = (where % np.uint64(m)).astype(np.int64)
        total = np.zeros(m, np.uint64)
        np.add.at(total, part, value)
        full = np.flatnonzero(np.bincount(part, minlength=m))
        prefix |= m - len(full) > spare
        out.append(mixed(total[full] + np.uint64(((band << 32) + 1) * int(_PART) % (1 << 64)) + full.astype(np.uint64)))
    if prefix:
        out.append(mixed(s[: n - (n * bands.num + bands.den - 1) // bands.den + 1] ^ _PREFIX))
    return np.concatenate(out)


def bitmap(s: np.ndarray) -> bytes:
    """Four bits for each shingle or more, a power of two in all; bit by the hash's low bits."""
    width = 64
    while width < 4 * len(s):
        width *= 2
    bits = np.zeros(width, np.uint8)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    x = np.frombuffer(bits, np.uint8)
    while len(x) > size:
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    return x


def bound(a: bytes, b: bytes, na: int, nb: int) -> int:
    """No overlap of the sets exceeds this: each differing bit costs a shingle of one of them."""
    size = min(len(a), len(b))
    return (na + nb - int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())) // 2


def links_with(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum()) if len(b) else 0
    return common > 0 and den * common >= num * (len(a) + len(b) - common)


def similar_groups(df: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_id (0: no shingles), root, component_id of df(doc_id, text).

    Two documents link when den * common >= num * all of their distinct k-word shingles; component_id is the least doc_id
    reachable by links, and root a number of the component that is never null. text_hash (64 bits) tells rows of one doc_id apart.
    """
    spark = tuned(df.sparkSession)
    n = parts(spark)
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def keys(batches):
        from pyspark import TaskContext

        bands, task = Bands(num, den), TaskContext.get().partitionId()
        for serial, table in zip(counted(), steps(batches, STEP)):
            # Documents' rows are spread over all buckets by what makes this step unique.
            spread = int(mixed(np.array([task << 32 | serial], np.uint64))[0] % np.uint64(n))
            sets = shingle_sets(table["text"], k)
            ids = np.array([set_id(s) for s in sets], np.int64)
            own = {int(i): s for i, s in zip(ids, sets, strict=True) if i}
            h = [tile_keys(s, bands) for s in own.values()]
            s = np.repeat(np.fromiter(own, np.int64, len(own)), [len(x) for x in h])
            h = np.concatenate(h) if h else np.zeros(0, np.uint64)
            to = (h % np.uint64(n)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            ends = np.searchsorted(to[order], np.arange(n + 1))
            h, s = h[order], s[order]
            at = [j for j in range(n) if ends[j] < ends[j + 1]]
            yield pa.RecordBatch.from_pydict({
                "_k": pa.array([*at, spread], pa.int64()),
                "_h": pa.array([*(h[ends[j] : ends[j + 1]].tobytes() for j in at), None], pa.binary()),
                "_s": pa.array([*(s[ends[j] : ends[j + 1]].tobytes() for j in at), ids.tobytes()], pa.binary()),
                "_d": pa.array([*([None] * len(at)), table["doc_id"].combine_chunks().to_pylist()], pa.list_(pa.int64())),
                "_n": pa.array([*([None] * len(at)), [len(x) for x in sets]], pa.list_(pa.int64())),
                "_t": pa.array([*([None] * len(at)), table["text_hash"].combine_chunks().to_pylist()], pa.list_(pa.int64())),
            })

    def meet(table: pa.Table) -> pa.Table:
        """(kind, x, y, z, t): of kind 1 a tile and a class in it, for tiles with two classes or more; of kind 0 a document, its set's size, class and text hash."""
        trim()
        keyed = table.filter(table["_h"].is_valid())
        h = np.frombuffer(b"".join(keyed["_h"].to_pylist()), np.uint64)
        s = np.frombuffer(b"".join(keyed["_s"].to_pylist()), np.int64)
        order = np.lexsort((s, h))
        h, s = h[order], s[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
        h, s = h[new], s[new]
        many = np.zeros(len(h), bool)
        same = h[1:] == h[:-1]
        many[1:] |= same
        many[:-1] |= same
        h, s = h[many].view(np.int64), s[many]
        rest = table.filter(table["_h"].is_null())
        d, sizes, hashes = (rest[c].combine_chunks().flatten() for c in ("_d", "_n", "_t"))
        ids = np.frombuffer(b"".join(rest["_s"].to_pylist()), np.int64)
        kind = pa.array(np.repeat(np.array([1, 0], np.int32), [len(h), len(d)]))
        none = pa.nulls(len(h), pa.int64())
        return pa.table({"kind": kind, "x": pa.concat_arrays([pa.array(h), d]), "y": pa.concat_arrays([pa.array(s), sizes]), "z": pa.concat_arrays([none, pa.array(ids)]), "t": pa.concat_arrays([none, hashes])})

    dealt = docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(keys, "_k long, _h binary, _s binary, _d array<long>, _n array<long>, _t array<long>")
    met = stored(dealt.groupBy("_k").applyInArrow(meet, "kind int, x long, y long, z long, t long"), "tiles")
    release(spark)
    of = met.where("kind = 0").select(F.col("x").alias("doc_id"), F.col("t").alias("text_hash"), F.col("y").alias("n_shingles"), F.col("z").alias("set_id"))
    tiles = met.where("kind = 1").select(F.col("x").alias("tile"), F.col("y").alias("s"))
    labels, scratch = None, []

    def kept(rows: DataFrame, name: str) -> DataFrame:
        rows = stored(rows, name)
        scratch.append(rows._stored_at)
        return rows

    if not tiles.isEmpty():
        degree = kept(tiles.groupBy("s").agg(F.count("*").alias("d")), "classes")
        tiles = distinct_tiles(tiles, kept)
        sets = Sets(docs, degree, k, num, den, kept)
        links = tested = None
        for _ in range(2):
            pairs = pivots(open_tiles(tiles, labels), degree, tested, kept)
            if pairs.isEmpty():
                break
            found = sets.linked(pairs)
            tested = pairs if tested is None else tested.unionByName(pairs)
            links = found if links is None else links.unionByName(found)
            labels = stored(connected(links.select(F.col("s").alias("a"), F.col("p").alias("b"))), "labels")
        pairs = sets.unsettled(open_tiles(tiles, labels), tested)
        if not pairs.isEmpty():
            links = links.unionByName(sets.linked(pairs))
            labels = stored(connected(links.select(F.col("s").alias("a"), F.col("p").alias("b"))), "labels")
        # What follows reads only the documents' classes and the labels.
        for path in scratch:
            drop_path(spark, path)
        release(spark)
    # A class's documents first, then the least document of each component.
    if labels is None:
        of = of.withColumn("root", F.col("set_id"))
    else:
        of = of.join(labels.select(F.col("node").alias("set_id"), "root"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    least = of.where("set_id <> 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    return of.join(least, "root", "left").select("doc_id", "text_hash", "n_shingles", "set_id", "root", F.when(F.col("set_id") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def distinct_tiles(tiles: DataFrame, kept) -> DataFrame:
    """One tile of those that hold the same classes; near copies share most of their parts. Tiles are told apart by 128 bits and their size."""
    print_ = tiles.groupBy("tile").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("s")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "s")).alias("y"))
    return kept(tiles.join(print_.groupBy("n", "x", "y").agg(F.min("tile").alias("tile")).select("tile"), "tile", "left_semi"), "distinct-tiles")


def open_tiles(tiles: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(tile, s, label) of the tiles that hold classes of several components."""
    if labels is None:
        return tiles.withColumn("label", F.col("s"))
    tiles = tiles.join(labels.select(F.col("node").alias("s"), "root"), "s", "left").select("tile", "s", F.coalesce("root", "s").alias("label"))
    mixed_ = tiles.groupBy("tile").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
    return tiles.join(mixed_.select("tile"), "tile", "left_semi")


def pivots(tiles: DataFrame, degree: DataFrame, tested: DataFrame | None, kept) -> DataFrame:
    """(s, p): for each class the pivot that it meets most often outside its component and hasn't been compared with."""
    tiles = tiles.join(degree, "s")
    top = tiles.groupBy("tile").agg(F.max(F.struct("d", "s", "label")).alias("t")).select("tile", F.col("t.s").alias("p"), F.col("t.label").alias("q"), F.col("t.d").alias("e"))
    pairs = tiles.join(top, "tile").where("label <> q").groupBy("s", "p").agg(F.count("*").alias("c"), F.max("e").alias("e"))
    if tested is not None:
        pairs = pairs.join(tested, ["s", "p"], "left_anti")
    return kept(pairs.groupBy("s").agg(F.max(F.struct("c", "e", "p")).alias("t")).select("s", F.col("t.p").alias("p")), "pairs")


class Sets:
    """The candidate classes' shingles, made from the texts again: few of all documents are candidates."""

    def __init__(self, docs: DataFrame, degree: DataFrame, k: int, num: int, den: int, kept):
        self.spark, self.num, self.den, self.kept = docs.sparkSession, num, den, kept
        self.n = parts(self.spark)
        bits = 1 << 16
        size = degree.count()
        while bits < 16 * size and bits < 1 << 27:
            bits *= 2
        filter_ = self.spark.sparkContext.broadcast(bloom(degree, bits))

        def pick(batches):
            words = filter_.value
            for table in steps(batches, STEP):
                seen: dict[int, np.ndarray] = {}
                for s in shingle_sets(table["text"], k):
                    i = set_id(s)
                    if i and i not in seen and all(int(words[p >> 6]) >> (p & 63) & 1 for p in positions(i, bits)):
                        seen[i] = s
                yield pa.RecordBatch.from_pydict({"s": pa.array(list(seen), pa.int64()), "n": pa.array([len(x) for x in seen.values()], pa.int64()), "a": pa.array([x.tobytes() for x in seen.values()], pa.binary()), "m": pa.array([bitmap(x) for x in seen.values()], pa.binary())})

        # The filter lets some others pass; joins with pairs drop them. A class with copies far apart stands here several
        # times, once for each batch of texts at most, which repeats a comparison and changes nothing.
        self.all = kept(docs.select("doc_id", "text").mapInArrow(pick, "s long, n long, a binary, m binary"), "sets")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (s, p) that link: bitmaps rule most others out, the sets themselves go to the rest only."""
        num, den = self.num, self.den

        def may(a, b):
            return bound(a[1], b[1], a[0], b[0]) * (den + num) >= num * (a[0] + b[0])

        def do(a, b):
            return links_with(np.frombuffer(a[1], np.uint64), np.frombuffer(b[1], np.uint64), num, den)

        return self.compared(self.compared(pairs, "m", may), "a", do)

    def compared(self, pairs: DataFrame, column: str, agree) -> DataFrame:
        """The pairs whose (n, column) agree. A pivot with many partners is dealt to several tasks."""
        groups = pairs.groupBy("p").agg(F.ceil(F.count("*") / 400).cast("int").alias("tasks"))
        members = pairs.join(groups, "p").select("s", F.col("p").alias("g"), F.pmod(F.hash("s"), "tasks").alias("t"))
        centres = groups.select(F.col("p").alias("s"), F.col("p").alias("g"), F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("t"))
        wanted = self.kept(members.unionByName(centres), "wanted")
        # Ids go to where the sets are if they are few; else both are shuffled.
        rows = self.all.select("s", "n", F.col(column).alias("x")).join(few(wanted), "s").withColumn("c", (F.col("s") == F.col("g")).cast("int"))

        def settle(batches):
            centre, g, t = None, None, None
            for batch in batches:
                s, p = [], []
                for row in zip(*(batch.column(c).to_pylist() for c in ("g", "t", "c", "s", "n", "x")), strict=True):
                    if row[2]:
                        g, t, centre = row[0], row[1], row[4:]
                        continue
                    if (row[0], row[1]) != (g, t):
                        raise RuntimeError("a class came before its pivot")
                    if agree(centre, row[4:]):
                        s.append(row[3])
                        p.append(g)
                yield pa.RecordBatch.from_pydict({"s": pa.array(s, pa.int64()), "p": pa.array(p, pa.int64())})
            trim()

        rows = rows.repartition(self.n, "g", "t").sortWithinPartitions("g", "t", F.desc("c"))
        return self.kept(rows.select("g", "t", "c", "s", "n", "x").mapInArrow(settle, "s long, p long").distinct(), "links")

    def unsettled(self, tiles: DataFrame, tested: DataFrame | None) -> DataFrame:
        """Pairs (s, p) of classes in different components that share a tile and whose bitmaps allow a link."""
        num, den = self.num, self.den
        sizes = tiles.groupBy("tile").agg(F.ceil(F.count("*") / _SQUARE).cast("int").alias("cuts"))
        rows = tiles.join(sizes, "tile").withColumn("i", F.pmod(F.hash("s"), "cuts"))
        rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        rows = rows.select("tile", "s", "label", "i", F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v"))
        rows = rows.join(self.all.select("s", "n", "m").dropDuplicates(["s"]), "s").repartition(self.n, "tile", "u", "v").sortWithinPartitions("tile", "u", "v")

        def compare(batches):
            held: list[tuple] = []
            for batch in batches:
                s, p = [], []
                for row in zip(*(batch.column(c).to_pylist() for c in ("tile", "u", "v", "s", "label", "i", "n", "m")), strict=True):
                    if held and held[0][:3] != row[:3]:
                        square(held, num, den, s, p)
                        held = []
                    held.append(row)
                yield pa.RecordBatch.from_pydict({"s": pa.array(s, pa.int64()), "p": pa.array(p, pa.int64())})
            s, p = [], []
            square(held, num, den, s, p)
            held = []
            trim()
            yield pa.RecordBatch.from_pydict({"s": pa.array(s, pa.int64()), "p": pa.array(p, pa.int64())})

        pairs = rows.select("tile", "u", "v", "s", "label", "i", "n", "m").mapInArrow(compare, "s long, p long").distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["s", "p"], "left_anti").join(tested.select(F.col("p").alias("s"), F.col("s").alias("p")), ["s", "p"], "left_anti")
        return self.kept(pairs, "pairs")


def square(held: list[tuple], num: int, den: int, s: list, p: list) -> None:
    """Compares the classes of one square, at most 2 * _SQUARE or so, in order of size: one class with all larger ones at a time."""
    held = sorted(held, key=lambda r: (r[6], r[3]))
    n = np.array([r[6] for r in held])
    ids, labels, cuts = (np.array([r[c] for r in held]) for c in (3, 4, 5))
    widths = np.array([len(r[7]) for r in held])
    rows: dict[int, np.ndarray] = {}
    for x, row in enumerate(held):
        # Larger sets that can still link, in the other cut if the square has two.
        last = int(np.searchsorted(n, row[6] * den // num, "right"))
        near = np.arange(x + 1, last)
        near = near[(labels[near] != labels[x]) & ((row[1] == row[2]) | (cuts[near] != cuts[x]))]
        if not len(near):
            continue
        width = int(widths[x])  # bitmaps don't get narrower as sets grow
        if width not in rows:
            rows[width] = np.stack([folded(r[7], width) if len(r[7]) >= width else np.zeros(width, np.uint8) for r in held])
        bits = rows[width]
        common = (n[near] + n[x] - np.bitwise_count(bits[near] ^ bits[x]).sum(axis=1, dtype=np.int64)) // 2
        for j in near[common * (den + num) >= num * (n[near] + n[x])].tolist():
            s.append(max(int(ids[x]), int(ids[j])))
            p.append(min(int(ids[x]), int(ids[j])))


def positions(i: int, bits: int) -> tuple[int, int]:
    """Two places of a class in the filter; its id is a hash already."""
    return i & (bits - 1), (i >> 28) & (bits - 1)


def bloom(degree: DataFrame, bits: int) -> np.ndarray:
    """A filter of the classes in at most 16 MB, whatever their number."""
    at = F.explode(F.array(F.col("s").bitwiseAND(bits - 1), F.shiftright("s", 28).bitwiseAND(bits - 1))).alias("at")
    words = degree.select(at).selectExpr("shiftright(at, 6) w", "shiftleft(1L, cast(at & 63 as int)) b")
    rows = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy()
    return out.view(np.uint64)
