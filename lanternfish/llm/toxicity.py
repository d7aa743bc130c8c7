"""Toxicity by compression distance: zstandard with a dictionary of ordinary text against one of toxic text.

Texts are lower-cased (A-Z), everything but letters becomes a space, each byte is
written twice (so that what a match saves exceeds what it costs even for short
words), and windows of a fixed number of words are compressed twice.

Both dictionaries are trained by zstandard, on the words of each document, each
word once a document. The ordinary one is trained on ordinary documents. The toxic
one has the ordinary one behind it, so that both know what the classes share, and
is trained on toxic documents: first on all of their words, then on those words
that compress better with it than ordinary documents' words do. Which words these
are is measured by compression alone, with dictionaries trained on the other folds.

A window's gain is the number of bytes by which the toxic dictionary makes it
shorter. Gains, all measured across folds, calibrate the thresholds: each gain has
a weight, the log of how much more frequent it is in toxic documents; a logistic
curve over a document's sum of weights and number of windows gives the score, and
it is shifted so that of ordinary documents no more than a given share reach 0.5.
Sizes of the toxic dictionary and how many documents a word of it must stand in are
chosen by the same folds.

The labelled sample is bounded (``sample`` documents of each label, in the order
of a hash of doc_id); scores are made from the text alone.

Defined results: null, empty and wordless texts have no windows and get the curve's
score for that; a null doc_id counts as an empty string in the held-out rule; a
doc_id labelled twice counts as toxic if either row says so; repeated rows get
one result each; without documents of both labels every score is 0; an empty
table gives no rows; columns other than those named are not read.
"""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.llm.common import documents, null_safe_crc, steps, tuned
from lanternfish.llm.textops import LOWER, bytes_of, encoded_words, row_of, word_spans

WORDS = 3
#: Bytes of shared content put after each window: compression then pays for both dictionaries from the first match on.
PRIMER = 96
#: Gains from here on weigh alike.
MOST = 16
SAMPLE = 2500
FOLDS = 3
#: Bytes of the ordinary dictionary, of the first toxic one, and of the later ones to choose from.
ORDINARY, FIRST, SIZES = 65_536, 32_768, (4096,)
#: In how many toxic documents a word must stand to train the later ones, to choose from.
FLOORS = (2, 3)
#: How many times as frequent a gain must be in toxic documents for its words to train the later dictionaries, and to weigh at all.
LIFT, LEAST_LIFT = 20.0, 3.0
#: The share of ordinary documents that may reach a score of 0.5.
FALSE = 0.015
_SEGMENT, _SEQUENCE = 20, 8
_KEPT = np.full(256, 32, np.uint8)
for _b in range(256):
    if 97 <= int(LOWER[_b]) <= 122 or _b >= 128:
        _KEPT[_b] = LOWER[_b]


def windows(column: pa.Array | pa.ChunkedArray, words: int = WORDS) -> tuple[list[bytes], np.ndarray]:
    """All rows' windows, words joined by one space with one on either side, bytes doubled; and for each row the number of its first."""
    data, offsets = bytes_of(column)
    data = _KEPT[data]
    starts, ends, firsts = word_spans(data, offsets)
    counts = np.diff(firsts)
    # Words with a space before each; a window reaches to the space before the next one.
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts + 1, out=at[1:])
    joined = np.full(at[-1] + 1, 32, np.uint8)
    inside = np.ones(at[-1] + 1, bool)
    inside[at] = False
    joined[inside] = data[data != 32]
    raw = np.repeat(joined, 2).tobytes()
    cuts = -(-counts // words)
    first = np.concatenate([[0], np.cumsum(cuts)])
    begin = np.repeat(firsts[:-1], cuts) + words * (np.arange(first[-1]) - np.repeat(first[:-1], cuts))
    end = np.minimum(begin + words, np.repeat(firsts[1:], cuts))
    return [raw[2 * a : 2 * b + 2] for a, b in zip(at[begin].tolist(), at[end].tolist(), strict=True)], first


def compressor(content: bytes):
    how = zstandard.ZstdCompressionParameters(window_log=18, hash_log=17, chain_log=18, search_log=5, min_match=6, target_length=32, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False)
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress


def lengths(compress, texts: list[bytes], primer: bytes) -> np.ndarray:
    return np.fromiter((len(compress(t + primer)) for t in texts), np.int64, len(texts))


def trained(size: int, samples: list[bytes]) -> bytes:
    """The content of a dictionary that zstandard trains; of too little text, the text itself."""
    try:
        return zstandard.train_dictionary(size + 1024, samples, k=_SEGMENT, d=_SEQUENCE).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:] or b" "


class Model:
    """Two dictionaries' contents, weights of gains and the curve."""

    def __init__(self, ordinary: bytes, toxic: bytes, weights: np.ndarray | None = None, curve: np.ndarray | None = None):
        self.ordinary, self.toxic = ordinary, toxic
        self.weights = np.zeros(MOST + 1) if weights is None else weights
        self.curve = np.array([-30.0, 0, 0, 0]) if curve is None else curve

    def gains(self, column, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
        """Of each window the bytes that the toxic dictionary saves, and for each row the number of its first window."""
        cut, first = windows(column, words)
        ordinary, toxic = compressors(self)
        primer = self.ordinary[-PRIMER:]
        # Copies and stock phrases repeat windows: each is compressed once.
        distinct = list(dict.fromkeys(cut))
        saved = dict(zip(distinct, (lengths(ordinary, distinct, primer) - lengths(toxic, distinct, primer)).tolist(), strict=True))
        return np.fromiter((saved[w] for w in cut), np.int64, len(cut)), first

    def sums(self, gains: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Each row's place on the curve."""
        return features(self.weights, gains, first) @ self.curve

    def scores(self, sums: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(sums, -30, 30)))


@lru_cache(maxsize=2)
def compressors(model: Model):
    return compressor(model.ordinary), compressor(model.toxic)


def features(weights: np.ndarray, gains: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(weights[np.clip(gains, 0, MOST)])])
    s = np.log1p(total[first[1:]] - total[first[:-1]])
    return np.column_stack([np.ones(len(s)), s, np.log1p(np.diff(first)), s * s])


def lifts(gains: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """For each gain, how many times as frequent it or a greater one is where toxic."""
    a, b = (np.bincount(np.clip(gains[x], 0, MOST), minlength=MOST + 1) + 0.5 for x in (toxic, ~toxic))
    a, b = np.cumsum(a[::-1])[::-1], np.cumsum(b[::-1])[::-1]
    return a / a[0] * b[0] / b


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Coefficients of a logistic curve by Newton's method; the first column is constant and isn't shrunk."""
    b = np.zeros(x.shape[1])
    shrink = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + shrink, x.T @ (weight * (y - p)) - shrink @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


class Labelled:
    """The labelled sample: each document's distinct words, its windows, and what both weigh with the ordinary dictionary."""

    def __init__(self, texts: list[str], toxic: np.ndarray, weight: float):
        column = pa.array(texts, pa.string())
        self.toxic = toxic
        self.weight = np.where(toxic, 1.0, weight)
        self.weight /= self.weight.mean()
        data, offsets = bytes_of(column)
        data = _KEPT[data]
        starts, ends, firsts = word_spans(data, offsets)
        which, distinct = encoded_words(data, starts, ends)
        n = max(1, len(distinct))
        pairs = np.unique(row_of(firsts) * n + which)
        self.doc, self.word = pairs // n, pairs % n
        self.words = [np.repeat(np.frombuffer(b" " + w + b" ", np.uint8), 2).tobytes() for w in distinct.to_pylist()]
        self.windows, self.first = windows(column)
        #: Folds of either label alike.
        self.fold = np.zeros(len(texts), np.int64)
        for y in (False, True):
            self.fold[toxic == y] = np.arange((toxic == y).sum()) % FOLDS
        self.of = row_of(self.first)
        self.ordinary = trained(ORDINARY, self.samples(~toxic[self.doc]))
        self.primer = self.ordinary[-PRIMER:]
        compress = compressor(self.ordinary)
        self.long, self.word_long = lengths(compress, self.windows, self.primer), lengths(compress, self.words, self.primer)

    def samples(self, pairs: np.ndarray) -> list[bytes]:
        return [self.words[k] for k in self.word[pairs].tolist()]

    def toxic_content(self, pairs: np.ndarray, size: int) -> bytes:
        return trained(size, self.samples(pairs & self.toxic[self.doc])) + self.ordinary

    def attempt(self, pairs: np.ndarray, size: int) -> dict:
        """Gains of windows and words by dictionaries of the other folds; weights, curve and loss that follow."""
        gains, own = np.zeros(len(self.windows), np.int64), np.zeros(len(self.doc), np.int64)
        for k in range(FOLDS):
            compress = compressor(self.toxic_content(pairs & (self.fold[self.doc] != k), size))
            at = np.flatnonzero(self.fold[self.of] == k)
            gains[at] = self.long[at] - lengths(compress, [self.windows[i] for i in at.tolist()], self.primer)
            at = np.flatnonzero(self.fold[self.doc] == k)
            used, back = np.unique(self.word[at], return_inverse=True)
            own[at] = (self.word_long[used] - lengths(compress, [self.words[i] for i in used.tolist()], self.primer))[back]
        lift = lifts(gains, self.toxic[self.of])
        weights = np.maximum.accumulate(np.where((np.arange(MOST + 1) > 0) & (lift >= LEAST_LIFT), np.log(lift), 0))
        x = features(weights, gains, self.first)
        curve = logistic(x, self.toxic.astype(float), self.weight)
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        loss = -float((self.weight * np.log(np.where(self.toxic, p, 1 - p) + 1e-12)).sum())
        return {"pairs": pairs, "size": size, "words": own, "weights": weights, "curve": curve, "loss": loss, "sums": x @ curve}

    def telling(self, tried: dict) -> np.ndarray:
        """The (document, word) pairs of toxic documents whose gain is much more frequent there."""
        toxic = self.toxic[self.doc]
        lift = lifts(tried["words"], toxic)
        lift[0] = 0
        least = int(np.flatnonzero(lift >= LIFT)[0]) if (lift >= LIFT).any() else int(lift.argmax())
        return toxic & (tried["words"] >= max(1, least))

    def often(self, pairs: np.ndarray, floor: int) -> np.ndarray:
        return pairs & (np.bincount(self.word[pairs], minlength=len(self.words))[self.word] >= floor)


def fit(texts: list[str], toxic: list[int], weight: float = 1.0) -> Model:
    """From labelled texts. weight: how many ordinary documents one of the sample stands for, if a toxic one stands for one."""
    y = np.array(toxic, bool)
    if y.sum() < FOLDS or (~y).sum() < FOLDS:
        return Model(b" ", b" ")
    known = Labelled(texts, y, weight)
    if not len(known.doc):
        return Model(b" ", b" ")
    best, seen = known.attempt(np.ones(len(known.doc), bool), FIRST), set()
    for _ in range(2):
        pairs = known.telling(best)
        for floor, size in itertools.product(FLOORS, SIZES):
            own = known.often(pairs, floor)
            content = known.toxic_content(own, size) if own.any() else None
            if content and content not in seen:
                seen.add(content)
                best = min(best, known.attempt(own, size), key=lambda t: t["loss"])
    # Shifted so that few enough ordinary documents pass.
    sums = np.sort(best["sums"][~y])[::-1]
    curve = best["curve"].copy()
    curve[0] -= sums[min(len(sums) - 1, int(FALSE * len(sums)))] + 1e-9
    return Model(known.ordinary, known.toxic_content(best["pairs"], best["size"]), best["weights"], curve)


def labelled(docs: DataFrame, labels: DataFrame, sample: int, modulus: int, rest: int, label: str) -> tuple[list[tuple[str, int]], float]:
    """At most ``sample`` texts of each label from rows that aren't held out, in the order of a hash of doc_id; and the weight of label 0's."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    marks = marks.groupBy("doc_id").agg(F.max("y").alias("y")).where(null_safe_crc(F.col("doc_id")) % modulus != rest)
    chosen = None
    for y in (0, 1):
        some = marks.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = some if chosen is None else chosen.unionByName(some)
    # At most 2 * sample rows.
    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    n = {r["y"]: max(1.0, r["n"] / sample) for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect() if r["y"] in (0, 1)}
    return [(r["text"], r["y"]) for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator()], n.get(0, 1.0) / n.get(1, 1.0)


def score(df: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of df(doc_id, text); labels(doc_id, toxic)."""
    spark = tuned(df.sparkSession)
    docs = documents(df)
    known, weight = labelled(docs, labels, sample, 5, 0, "toxic")
    model = spark.sparkContext.broadcast(fit([t for t, _ in known], [y for _, y in known], weight))

    def mark(batches):
        own = model.value
        for table in steps(batches):
            s = own.scores(own.sums(*own.gains(table["text"])))
            yield pa.RecordBatch.from_pydict({"doc_id": table["doc_id"].combine_chunks(), "score": pa.array(s, pa.float64())})

    out = docs.mapInArrow(mark, "doc_id long, score double")
    return out.select("doc_id", (null_safe_crc(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
