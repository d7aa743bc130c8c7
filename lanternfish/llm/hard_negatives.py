"""Hard negatives by vantage-point trees over norm-augmented vectors.

Vectors are quantised to integers. With M the largest norm of a tree's vectors, each
vector x gets one more component, sqrt(M^2 - |x|^2), and a query q gets zero there:
then the squared distance is |q|^2 + M^2 - 2 q.x, so that higher scores are nearer and
a window of scores is an annulus around the query. A node of a tree has a vantage
point, one of its vectors, and halves the others by their distance to it; the ranges
of those distances bound the distances of a query to either half by the triangle
inequality. Leaves that the annulus doesn't meet are passed over; the others are
visited nearest first, by their lower bounds, until no leaf can hold anything better
than the k rows found. Bounds are doubles with room for their error, scores are exact
integers.

The index is written once, in packs of rows, each a tree; packs are dealt to groups
of as many rows as a task can hold, and the packed queries stream past each group,
which keeps k rows of each query. So what is moved is the index once and the queries
once for each group.

Defined results: rows with a null vec_id, a null label, a null vector, or a component
that is null or, times the scale, not finite take no part; vectors of other lengths count as if zeros
followed; repeated rows are rows of their own, as anchors, positives and negatives;
rows with the anchor's vec_id aren't its positives; components of any size count, and
only a row to be returned whose score exceeds 64 bits is an error, which names it; an
empty table gives no rows; columns other than vec_id, label and embedding aren't read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternfish.llm.common import from_blob, parts, stored, to_blob, tuned

#: Rows of a pack, which is a tree; of a leaf; of a group of packs that a task holds, about; queries of a pack.
ROWS, LEAF, HELD, QUERIES = 4096, 512, 1 << 18, 512
#: Sums of products below this are exact in doubles.
EXACT = float(1 << 53)
#: Components below this go to a pack's main tree, larger ones to one of their own.
NARROW = float(1 << 20)


def taking_part(df: DataFrame) -> DataFrame:
    """vec_id, label, embedding of the rows that have all of them; components are looked at when they are quantised."""
    whole = F.forall("embedding", lambda e: e.isNotNull())
    return df.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))


def matrix(column: pa.ChunkedArray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of lists of doubles, shorter ones with zeros after them, and which rows are finite throughout."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    m = np.zeros((len(sizes), int(sizes.max(initial=0))))
    with np.errstate(over="ignore", invalid="ignore"):
        m[np.arange(m.shape[1]) < sizes[:, None]] = np.floor(lists.flatten().to_numpy(zero_copy_only=False) * float(scale))
    return m, np.isfinite(m).all(axis=1)


def small(m: np.ndarray) -> np.ndarray:
    """The whole numbers of m in the smallest type that holds them."""
    most = np.abs(m).max(initial=0)
    return m.astype(next((t for t, n in ((np.int16, 1 << 15), (np.int32, 1 << 31)) if most < n), np.float64))


def packs(df: DataFrame, scale: int, rows: int, *more: str) -> DataFrame:
    """part, n, blob: rows of df(vec_id, label, embedding and more) in blocks, vectors quantised; part numbers them within the partitions."""

    def pack(batches):
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId() << 32, []

        def made(table):
            m, ok = matrix(table["embedding"], scale)
            m = small(m[ok])
            columns = {c: table[c].filter(pa.array(ok)) for c in table.column_names if c != "embedding"}
            body = pa.table(columns | {"v": pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), m.shape[1])} if m.shape[1] else columns)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "n": pa.array([int(ok.sum())], pa.int64()), "blob": pa.array([to_blob(body)], pa.binary())})

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= rows:
                table = pa.Table.from_batches(held)
                yield made(table.slice(0, rows))
                part, held = part + 1, [b for b in table.slice(rows).to_batches() if b.num_rows]
        if sum(b.num_rows for b in held):
            yield made(pa.Table.from_batches(held))

    chosen = df.select("vec_id", "label", "embedding", *more)
    return chosen.mapInArrow(pack, "part long, n long, blob binary").where("n > 0")


def opened(blob) -> tuple[pa.Table, np.ndarray]:
    """A pack's columns and its vectors."""
    table = from_blob(blob)
    if "v" not in table.column_names:
        return table, np.zeros((len(table), 0), np.int16)
    v = table["v"].combine_chunks()
    return table, v.flatten().to_numpy(zero_copy_only=False).reshape(-1, v.type.list_size)


def products(m: np.ndarray, q: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products of m's rows, of components up to most, with q: doubles where they are exact, else Python's integers."""
    n = min(m.shape[1], len(q))
    m, q = m[:, :n], q[:n].astype(np.float64)
    if n * most * float(np.abs(q).max(initial=0)) < EXACT:
        return (m.astype(np.float64) @ q).astype(np.int64)
    whole = [int(x) for x in q]
    return np.array([sum(int(a) * b for a, b in zip(row, whole, strict=True)) for row in m.tolist()], dtype=object)


class Tree:
    """A vantage-point tree of a pack's rows; a node's vantage point is its row farthest from the node's first one."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, m: np.ndarray, leaf: int = LEAF):
        x = m.astype(np.float64)
        self.norm = np.square(x).sum(axis=1)
        self.top = float(self.norm.max(initial=0))
        self.most = float(np.abs(x).max(initial=0))
        augmented = np.hstack([x, np.sqrt(np.maximum(0, self.top - self.norm))[:, None]])
        vantage: list[int] = []
        spans, leaves = [], []

        def grow(rows: np.ndarray, above: list[tuple[int, float, float]]):
            """above: for each vantage point over these rows its number and the least and largest distance of the rows to it."""
            if len(rows) <= leaf:
                spans.append(above)
                leaves.append(rows)
                return
            far = np.square(augmented[rows] - augmented[rows[0]]).sum(axis=1)
            point = rows[int(far.argmax())]
            d = np.sqrt(np.square(augmented[rows] - augmented[point]).sum(axis=1))
            order = np.argsort(d, kind="stable")
            half = len(rows) // 2
            number = len(vantage)
            vantage.append(point)
            for own in (order[:half], order[half:]):
                grow(rows[own], [*above, (number, float(d[own].min()), float(d[own].max()))])

        grow(np.arange(len(ids)), [])
        order = np.concatenate(leaves)
        self.ids, self.labels, self.m = ids[order], labels[order], m[order]
        self.ends = np.cumsum([len(r) for r in leaves])
        self.vantage = augmented[vantage] if vantage else np.zeros((0, augmented.shape[1]))
        # (leaf, vantage point, least, largest) of all spans; each leaf's are together.
        flat = [(i, *s) for i, own in enumerate(spans) for s in own]
        self.leaf_of = np.array([s[0] for s in flat], np.int64)
        self.point = np.array([s[1] for s in flat], np.int64)
        self.near, self.far = np.array([s[2] for s in flat]), np.array([s[3] for s in flat])

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each leaf the least and the largest score that q can have there, with room for the error of doubles."""
        n = min(len(q), self.vantage.shape[1] - 1)
        own = float(np.square(q.astype(np.float64)).sum())
        inner = self.vantage[:, :n] @ q[:n].astype(np.float64)
        d = np.sqrt(np.maximum(0, own + self.top - 2 * inner))[self.point]
        reach = np.sqrt(own * self.top)
        low, high = np.zeros(len(self.ends)), np.full(len(self.ends), np.sqrt(own) + np.sqrt(self.top))
        np.maximum.at(low, self.leaf_of, np.maximum(d - self.far, self.near - d))
        np.minimum.at(high, self.leaf_of, d + self.far)
        room = 1e-9 * (own + self.top) + 1
        return np.maximum(-reach, (own + self.top - np.square(high)) / 2) - room, np.minimum(reach, (own + self.top - np.square(low)) / 2) + room


class Forest:
    """The trees that a task holds, and a query's traversal of all of their leaves, nearest first."""

    def __init__(self):
        self.trees: list[Tree] = []

    def add(self, ids: np.ndarray, labels: np.ndarray, m: np.ndarray) -> None:
        wide = (np.abs(m.astype(np.float64)) >= NARROW).any(axis=1)
        for own in (~wide, wide):
            if own.any():
                self.trees.append(Tree(ids[own], labels[own], small(m[own].astype(np.float64))))


class Query:
    """One query's bounds of all leaves, and the scores of the leaves visited so far."""

    def __init__(self, forest: Forest, q: np.ndarray):
        self.forest, self.q = forest, q
        bounds = [t.bounds(q) for t in forest.trees]
        self.low, self.high = (np.concatenate([b[i] for b in bounds]) for i in (0, 1))
        self.tree = np.repeat(np.arange(len(forest.trees)), [len(t.ends) for t in forest.trees])
        self.leaf = np.concatenate([np.arange(len(t.ends)) for t in forest.trees])
        self.scores: dict[int, tuple] = {}

    def visit(self, at: int) -> tuple:
        """ids, labels and scores of a leaf's rows."""
        if at not in self.scores:
            tree, k = self.forest.trees[self.tree[at]], int(self.leaf[at])
            rows = slice(int(tree.ends[k - 1]) if k else 0, int(tree.ends[k]))
            self.scores[at] = tree.ids[rows], tree.labels[rows], products(tree.m[rows], self.q, tree.most)
        return self.scores[at]

    def nearest(self, k: int, fits, least: float = -np.inf, most: float = np.inf) -> list[tuple[int, int]]:
        """(score, vec_id) of the k first rows that fit(ids, labels, scores), whose scores lie between least and most."""
        meets = np.flatnonzero((self.high >= least) & (self.low <= most))
        order = meets[np.argsort(-self.high[meets], kind="stable")]
        found: list[tuple[int, int]] = []
        for at in order.tolist():
            if len(found) == k and self.high[at] < -found[-1][0]:
                break
            ids, labels, scores = self.visit(at)
            ok = np.flatnonzero(fits(ids, labels, scores))
            if len(ok):
                if len(ok) > k:  # ties at the k-th score stay
                    edge = np.sort(-scores[ok])[k - 1]
                    ok = ok[-scores[ok] <= edge]
                found = sorted(found + [(-int(s), int(i)) for s, i in zip(scores[ok], ids[ok], strict=True)])[:k]
        return [(-s, i) for s, i in found]


def sortable(score: int) -> str:
    """Text of a whole number of any size below 10**200 whose order is that of the numbers."""
    return f"1{score:0200d}" if score >= 0 else f"0{10**200 + score:0200d}"


def number(text: str) -> int:
    return int(text[1:]) - (0 if text[0] == "1" else 10**200)


def searched(index: DataFrame, asked: DataFrame, groups: int, answer, schema: str) -> DataFrame:
    """answer(forest, columns, vectors) of each pack of queries against each group of the index."""
    n = parts(index.sparkSession)
    # By partition and serial number in turn, which is more even than a hash of few packs.
    turn = F.shiftright("part", 32) + F.col("part").bitwiseAND((1 << 32) - 1) * 31
    held = index.select(F.pmod(turn, F.lit(groups).cast("long")).alias("g"), F.lit(0).alias("asked"), "part", "blob")
    asked = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"), F.lit(1).alias("asked"), "part", "blob")

    def run(batches):
        group, forest = None, Forest()
        for batch in batches:
            for g, is_query, blob in zip(*(batch.column(c).to_pylist() for c in ("g", "asked", "blob")), strict=True):
                if g != group:
                    group, forest = g, Forest()
                columns, m = opened(blob)
                if not is_query:
                    forest.add(columns["vec_id"].to_numpy(), columns["label"].to_numpy(), m)
                elif forest.trees:
                    yield answer(forest, columns, m)

    rows = held.unionByName(asked).repartition(n, "g").sortWithinPartitions("g", "asked", "part")
    return rows.mapInArrow(run, schema)


def first_same(forest: Forest, columns: pa.Table, m: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best rows of each anchor's label but those of its own vec_id."""
    out: dict[str, list] = {"q": [], "id": [], "score": []}
    for q, i, label, v in zip(columns["q"].to_pylist(), columns["vec_id"].to_pylist(), columns["label"].to_pylist(), m, strict=True):
        for score, other in Query(forest, v).nearest(k, lambda ids, labels, _, i=i, label=label: (labels == label) & (ids != i)):
            for c, x in zip(out, (q, other, sortable(score)), strict=True):
                out[c].append(x)
    return pa.RecordBatch.from_pydict({"q": pa.array(out["q"], pa.int64()), "id": pa.array(out["id"], pa.int64()), "score": pa.array(out["score"], pa.string())})


def within(forest: Forest, columns: pa.Table, m: np.ndarray, k: int, low: int, high: int) -> pa.RecordBatch:
    """The k best rows of other labels in the window of each of an anchor's positives."""
    out: dict[str, list] = {"q": [], "positive": [], "id": [], "score": []}
    for q, label, wanted, v in zip(columns["q"].to_pylist(), columns["label"].to_pylist(), columns["wanted"].to_pylist(), m, strict=True):
        query = Query(forest, v)
        for x in wanted:
            best = number(x["score"])
            # Whole scores from the least to the most: low * best <= 100 * score <= high * best.
            least, most = -(-low * best // 100), high * best // 100
            if least > most:
                continue
            for score, other in query.nearest(k, lambda _, labels, scores, label=label, least=least, most=most: (labels != label) & (scores >= least) & (scores <= most), float(least), float(most)):
                for c, y in zip(out, (q, x["rank"], other, sortable(score)), strict=True):
                    out[c].append(y)
    return pa.RecordBatch.from_pydict({"q": pa.array(out["q"], pa.int64()), "positive": pa.array(out["positive"], pa.int32()), "id": pa.array(out["id"], pa.int64()), "score": pa.array(out["score"], pa.string())})


def ranked(found: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def long_score(score: str, who: str):
    """The text of a score as a long; beyond 64 bits an error that names the row."""
    whole = F.when(F.substring(score, 1, 1) == "1", F.regexp_replace(F.substring(score, 2, 200), "^0+(?=.)", "")).otherwise(F.lit(None))
    # Below zero the digits are those of 10**200 plus the number: nines before a small one.
    below = F.when(F.substring(score, 2, 180) == "9" * 180, F.substring(score, 182, 20).cast("decimal(38,0)") - F.lit("100000000000000000000").cast("decimal(38,0)"))
    value = F.coalesce(F.when(F.length(whole) <= 19, whole.cast("decimal(38,0)")), below)
    fits = value.isNotNull() & (value >= F.lit(-(1 << 63)).cast("decimal(38,0)")) & (value <= F.lit((1 << 63) - 1).cast("decimal(38,0)"))
    return F.when(fits, value.cast("long")).otherwise(F.raise_error(F.concat(F.lit("a score exceeds 64 bits, with vec_id "), F.col(who).cast("string"))).cast("long"))


def mine(df: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of df(vec_id, label, embedding).

    Anchors are rows with vec_id divisible by every; a negative's score is low to high percent of the positive's.
    """
    spark = tuned(df.sparkSession)
    rows = taking_part(df)
    index = stored(packs(rows, scale, ROWS), "negatives-index")
    total = index.agg(F.sum("n")).first()[0] or 0
    groups = max(1, min(parts(spark), -(-total // ROWS)), -(-total // HELD))
    anchors = stored(rows.where(F.col("vec_id") % every == 0).withColumn("q", F.monotonically_increasing_id()), "anchors")
    same = searched(index, packs(anchors, scale, QUERIES, "q"), groups, partial(first_same, k=positives), "q long, id long, score string")
    best = stored(ranked(same, positives, "q"), "positives")
    wanted = best.groupBy("q").agg(F.collect_list(F.struct("rank", "score")).alias("wanted"))
    asked = anchors.join(wanted, "q").select("vec_id", "label", "embedding", "q", "wanted")
    other = searched(index, packs(asked, scale, QUERIES, "q", "wanted"), groups, partial(within, k=negatives, low=low, high=high), "q long, positive int, id long, score string")
    found = ranked(other, negatives, "q", "positive").select("q", "positive", F.col("rank"), F.col("id").alias("negative_id"), F.col("score").alias("_n"))
    chosen = best.select("q", F.col("rank").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("_p"))
    out = found.join(chosen, ["q", "positive"]).join(anchors.select("q", F.col("vec_id").alias("anchor_id")), "q")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", long_score("_p", "positive_id").alias("positive_score"), long_score("_n", "negative_id").alias("negative_score"))


ORACLE = """
with e as (
  select row_number() over () as i, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), u as (
  select i, vec_id, label, cast(unnest(v) as bigint) as x, generate_subscripts(v, 1) as j from e
), s as (
  select q.i as q, c.i as c, any_value(q.vec_id) as anchor_id, any_value(c.vec_id) as vec_id, any_value(q.label = c.label) as same, cast(sum(q.x * c.x) as bigint) as score
  from u q join u c on q.j = c.j and q.i <> c.i
  where q.vec_id % 100 = 0 group by q.i, c.i
), p as (
  select * from s where same and vec_id <> anchor_id qualify row_number() over (partition by q order by score desc, vec_id) <= 5
)
select p.anchor_id, p.vec_id as positive_id, cast(row_number() over w as integer) as rank, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score
from p join s on s.q = p.q and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score
window w as (partition by p.q, p.c order by s.score desc, s.vec_id)
qualify row_number() over w <= 10
"""
