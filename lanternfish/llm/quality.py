"""Document quality by histogram gradient-boosted trees over statistics of the text.

Statistics come from whole texts, vectorised over an Arrow batch. Trees are
trained by the driver on a bounded sample of labelled documents (``sample`` of
each label): features are binned by quantiles, each level's gradients are summed
by bin, and each tree is complete to a fixed depth, so that all trees are three
arrays (feature, threshold, leaf) and a batch goes down all of them by array
indexing.

Defined results: null, empty and wordless texts have statistics of 0 and are
scored like others; a null doc_id counts as an empty string in the held-out rule;
a doc_id labelled twice takes the larger label; repeated rows get one result each;
without labelled documents, or with one label only, the score is the share of
label 1 (0.5 without any); an empty table gives no rows; columns other than those
named are not read by ``score`` and kept by ``good_documents``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternfish.llm.common import documents, null_safe_crc, steps, tuned
from lanternfish.llm.textops import LOWER, bytes_of, encoded_words, row_of, word_spans

SAMPLE = 6000
#: Bytes of text and rows measured at once; a byte takes some 60 bytes of memory meanwhile, a row some 8 kB.
STEP, ROWS = 1 << 20, 4096
_KIND = np.zeros(256, np.int64)
_KIND[65:91] = 1
_KIND[97:123] = 2
_KIND[48:58] = 3
_KIND[list(b".,;:?'-()\"")] = 4
_KIND[list(b"!")] = 5
_KIND[list(b"#$%&*@+=<>[]{}\\/^_`~")] = 6
_KIND[list(b"|")] = 7
_KIND[[10, 13]] = 8
_KIND[[9, 11, 12, 32]] = 9
_KIND[128:192] = 10
_KIND[192:] = 11
KINDS = 12
STATISTICS = KINDS + 12


def statistics(column: pa.ChunkedArray) -> np.ndarray:
    """A row of statistics for each text."""
    data, offsets = bytes_of(column)
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    kinds = np.bincount(row * KINDS + _KIND[data], minlength=n * KINDS).reshape(n, KINDS)
    chars = np.maximum(size - kinds[:, 10], 1)
    starts, ends, firsts = word_spans(data, offsets)
    words = np.diff(firsts)
    some = np.maximum(words, 1)
    own = row_of(firsts)
    length = (ends - starts).astype(np.float64)
    which, distinct = encoded_words(LOWER[data], starts, ends)
    pairs = np.unique(own.astype(np.int64) * max(1, len(distinct)) + which)
    kind_of_word = np.bincount(pairs // max(1, len(distinct)), minlength=n) if len(pairs) else np.zeros(n)
    same = np.zeros(len(which), bool)
    if len(which) > 1:
        same[1:] = (which[1:] == which[:-1]) & (own[1:] == own[:-1])
    last = data[ends - 1] if len(ends) else data[:0]
    first = data[starts] if len(starts) else data[:0]
    by = lambda x: np.bincount(own, weights=x, minlength=n) / some
    mean = by(length)
    spread = np.sqrt(np.maximum(by(length * length) - mean * mean, 0))
    histogram = np.bincount(row * 256 + data, minlength=n * 256).reshape(n, 256) / np.maximum(size, 1)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.where(histogram > 0, histogram * np.log2(histogram), 0).sum(axis=1)
    more = [np.log1p(size), np.log1p(words), mean, spread, kind_of_word / some, np.log1p(kind_of_word), by(same), by(_KIND[last] == 6), by(_KIND[last] == 5), by(_KIND[first] == 1), by(length <= 3), entropy]
    return np.column_stack([kinds / chars[:, None], *more])


class Trees:
    """Boosted complete trees as arrays: feature and threshold by (tree, inner node), leaf by (tree, leaf)."""

    def __init__(self, base: float, depth: int):
        self.base, self.depth = base, depth
        self.feature = np.zeros((0, (1 << depth) - 1), np.int64)
        self.threshold = np.zeros((0, (1 << depth) - 1))
        self.leaf = np.zeros((0, 1 << depth))

    def margin(self, x: np.ndarray) -> np.ndarray:
        """All rows go down one tree after another; a level is one gather and one comparison."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - len(feature)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0) -> Trees:
    """Logistic boosting on binned features; ties between splits go to the lower feature and bin."""
    weight = np.ones(len(y)) if weight is None else weight
    share = float((weight * y).sum() / weight.sum()) if len(y) else 0.5
    model = Trees(float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))), depth)
    if not 0 < y.sum() < len(y):
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)])
    width = max(map(len, edges)) + 1
    d = x.shape[1]
    margin = np.full(len(y), model.base)
    inner = (1 << depth) - 1
    flat = (binned + np.arange(d) * width).astype(np.int64)
    made = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * p * (1 - p)
        feature, threshold, cut = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, width)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            at = ((node - first)[:, None] * (d * width) + flat).ravel()
            total = count * d * width
            gs = np.bincount(at, weights=np.repeat(g, d), minlength=total).reshape(count, d, width).cumsum(axis=2)
            hs = np.bincount(at, weights=np.repeat(h, d), minlength=total).reshape(count, d, width).cumsum(axis=2)
            ga, ha = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (ga - gs) ** 2 / (ha - hs + ridge) - ga**2 / (ha + ridge)
            gain[(hs < 1e-2) | (ha - hs < 1e-2)] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            value = gain.reshape(count, -1)[np.arange(count), best]
            for k in np.flatnonzero(value > 1e-6).tolist():
                j, b = divmod(int(best[k]), width)
                if b < len(edges[j]):
                    feature[first + k], cut[first + k], threshold[first + k] = j, b, edges[j][b]
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > cut[node])
        where = node - inner
        leaf = -rate * np.bincount(where, weights=g, minlength=inner + 1) / (np.bincount(where, weights=h, minlength=inner + 1) + ridge)
        margin += leaf[where]
        made.append((feature, threshold, leaf))
    model.feature, model.threshold, model.leaf = (np.array(a) for a in zip(*made, strict=True))
    return model


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from at most ``sample`` documents of each label whose crc32(doc_id) mod 3 is not 1, in the order of a hash of doc_id."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    marks = marks.groupBy("doc_id").agg(F.max("y").alias("y")).where(null_safe_crc(F.col("doc_id")) % 3 != 1)
    counts = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    zero, one = (marks.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1))

    def measure(batches):
        for table in steps(batches, STEP, ROWS):
            x = statistics(table["text"])
            yield pa.RecordBatch.from_pydict({"doc_id": table["doc_id"].combine_chunks(), "y": table["y"].combine_chunks(), "x": pa.array(list(x), pa.list_(pa.float64()))})

    # At most 2 * sample rows on either side of this; a doc_id that repeats gives one row.
    rows = docs.join(F.broadcast(zero.unionByName(one)), "doc_id").select("doc_id", "text", "y").mapInArrow(measure, "doc_id long, y int, x array<double>")
    found = rows.groupBy("doc_id", "y").agg(F.min("x").alias("x")).orderBy("doc_id").toArrow()
    if not found.num_rows:
        return Trees(0.0, 1)
    y = found["y"].to_numpy().astype(np.float64)
    # A label with more documents than the sample holds keeps its share.
    weight = np.where(y == 1, max(1.0, counts.get(1, 0) / sample), max(1.0, counts.get(0, 0) / sample))
    return train(np.array(found["x"].to_pylist()), y, weight / weight.mean())


def with_score(df: DataFrame, model: Trees, text: str = "text", name: str = "score") -> DataFrame:
    """df with the model's score of a text column, as a new last column."""
    spark = tuned(df.sparkSession)
    sent = spark.sparkContext.broadcast(model)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def mark(batches):
        for table in steps(batches, STEP, ROWS):
            score_ = sent.value.probability(statistics(table[text]))
            yield from table.append_column(name, pa.array(score_, pa.float64())).to_batches()

    return df.mapInArrow(mark, schema)


def score(df: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of df(doc_id, text); labels(doc_id, quality)."""
    docs = documents(df)
    out = with_score(docs, fitted(docs, labels, sample)).select("doc_id", "score")
    return out.select("doc_id", (null_safe_crc(F.col("doc_id")) % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good_documents(df: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of df that score 0.5 or more, columns as they were."""
    names = [f"_x{i}" for i in range(len(df.columns))]
    at = dict(zip(df.columns, names, strict=True))
    scored = with_score(df.toDF(*names), fitted(documents(df), labels, sample), at["text"], "_score")
    return scored.where("_score >= 0.5").select(*(F.col(x).alias(c) for c, x in at.items()))
