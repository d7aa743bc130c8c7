"""Phrase collocations counted by position bitmaps, shard by shard.

A shard is some megabytes of text. Each word of it has a bitmap over the shard's
word positions, with an empty position between pieces, so that no phrase crosses
one. Bitmaps are compressed as is best for each: a plain bitmap for a word that
holds so many positions that one bit for each position is less than a number for
each occurrence, else an array of its positions. A phrase's bitmap (where it ends)
shifted by one position, ANDed with a word's bitmap, is that of the longer phrase,
and its popcount the phrase's count: plain bitmaps are ANDed with each other, and
arrays with all words at once, through the word that holds each shifted position.
Phrases grow depth-first, one run of first words after another, so that only one
run's bitmaps exist at a time. Counts are summed over shards.

Two passes over the texts. The first counts words and pairs. Those that are frequent
in the whole table fill a Bloom filter, whose size is a parameter; in the second pass
phrases of three and more words grow only through pairs that pass it. What passes
wrongly is counted too and is dropped when the sums are known, so counts are exact
however full the filter is. Cuts, scores, containment and ranks are joins and
windows over frequent phrases. Words are known by 64 bits of their language and
bytes: among 10^10 words of which 10^8 are frequent, one in twenty tables would have
a frequent word that is confused with another one.

Defined results: a null text has no words; a null lang is `und`; repeated rows count
as often as they stand there; doc_id is not read; ties go by code points of the
phrase; an empty table gives no rows; columns other than text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternfish.llm.common import parts, steps, stored, tuned
from lanternfish.llm.textops import LOWER, binary_array, bytes_of, mixed, row_of, sequence_hashes

#: Bytes that end a piece, and those between words of a piece.
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(10, 14)]] = True
APART = ENDS.copy()
APART[[32, 9]] = True
#: Bytes of text that a shard holds, about; a longer text is cut between pieces.
SHARD = 6 << 20
#: Occurrences whose phrases grow at a time.
RUN = 1 << 18
#: Shares of a lang whose phrases are ranked apart before the lang's own.
SHARES = 64
#: Bytes of the filter at most, and bits for each entry.
FILTER_BYTES, FILTER_BITS = 64 << 20, 16


def shards(batches) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """(bytes in lower case, offsets of rows, languages) of some megabytes each; cut in a row only where a piece ends."""
    for table in steps(batches, SHARD):
        data, offsets = bytes_of(table["text"])
        data, langs, at = LOWER[data], table["lang"].combine_chunks(), 0
        while at < len(data):
            end = min(len(data), at + SHARD)
            if end < len(data):
                row = offsets[np.searchsorted(offsets, end, "right") - 1]
                last = np.flatnonzero(ENDS[data[max(at, end - 65_536) : end]])
                near = max(int(row), end - 65_536 + int(last[-1]) + 1 if len(last) and end - at > 65_536 else 0)
                if near <= at:  # no end near: the next one
                    after = np.flatnonzero(ENDS[data[end:]][: 1 << 30])
                    near = min(end + int(after[0]) + 1 if len(after) else len(data), int(offsets[np.searchsorted(offsets, end, "right")]))
                end = near
            first, last = np.searchsorted(offsets, at, "right") - 1, np.searchsorted(offsets, end, "left")
            yield data[at:end], np.clip(offsets[first : last + 1], at, end) - at, langs.slice(first, last - first)
            at = end


class Shard:
    """The position bitmaps of a shard's words, each known by its language and bytes.

    holder: the word at each position, -1 at the empty one between pieces (and at both ends); order, firsts: positions by word;
    key: the words' 64 bits.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: pa.Array):
        inside = ~APART[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        start, end = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1] | edge[1:-1]
        end[:-1] &= ~inside[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        firsts = np.searchsorted(starts, offsets)
        rows = row_of(firsts)
        pieces = np.cumsum(ENDS[data], dtype=np.int32)[starts]
        lengths = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=lengths[1:])
        coded = binary_array(data[inside], lengths).dictionary_encode()
        which, self.texts = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        langs = langs.dictionary_encode()
        lang, self.langs = langs.indices.to_numpy(zero_copy_only=False)[rows].astype(np.int64), langs.dictionary
        both, word, counts = np.unique(lang * max(1, len(self.texts)) + which, return_inverse=True, return_counts=True)
        self.lang, self.text = np.divmod(both, max(1, len(self.texts)))
        salt = np.array([xxhash.xxh3_64_intdigest(x.encode(), seed=1) for x in self.langs.to_pylist()], np.uint64)
        plain = np.fromiter(map(xxhash.xxh3_64_intdigest, self.texts.to_pylist()), np.uint64, len(self.texts))
        self.key = mixed(plain[self.text] ^ salt[self.lang]) if len(both) else np.zeros(0, np.uint64)
        self.counts = counts
        gap = np.zeros(len(starts), np.int64)
        if len(starts):
            gap[0] = 1
            gap[1:] = (pieces[1:] != pieces[:-1]) | (rows[1:] != rows[:-1])
        at = np.arange(len(starts)) + np.cumsum(gap)
        self.span = int(at[-1]) + 2 if len(at) else 1
        self.holder = np.full(self.span, -1, np.int32)
        self.holder[at] = word
        self.order = at[np.argsort(word, kind="stable")]
        self.firsts = np.concatenate([[0], np.cumsum(counts)])
        #: Words whose plain bitmaps are smaller than 32-bit positions, and those bitmaps.
        self.dense = np.flatnonzero(counts * 32 >= self.span)
        self.plain = np.stack([self.bits(self.positions(w)) for w in self.dense]) if len(self.dense) else np.zeros((0, 0), np.uint64)
        self.is_dense = np.zeros(len(counts) + 1, bool)  # the last one: the empty position
        self.is_dense[self.dense] = True

    def positions(self, word: int) -> np.ndarray:
        return self.order[self.firsts[word] : self.firsts[word + 1]]

    def bits(self, positions: np.ndarray) -> np.ndarray:
        raw = np.zeros(-(-self.span // 64) * 64, np.uint8)
        raw[positions] = 1
        return np.packbits(raw, bitorder="little").view(np.uint64)

    def is_wide(self, n: int) -> bool:
        return n * 32 >= self.span

    def extended(self, prefix: np.ndarray, ends: np.ndarray):
        """Each prefix (ascending) with the words that follow it: (prefix, word, count) of each longer phrase, then its occurrences.

        ends: where the prefixes' occurrences end. A prefix whose plain bitmap is the smaller form is shifted and ANDed with the
        plain bitmaps of words as such; all else goes through the words that hold the shifted positions.
        """
        out, keep = [], np.ones(len(ends), bool)
        if len(self.dense):
            cuts = np.flatnonzero(np.diff(prefix)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(prefix)], strict=True):
                if not self.is_wide(b - a):
                    continue
                own = shifted(self.bits(ends[a:b]))
                both = self.plain & own
                n = np.bitwise_count(both).sum(axis=1, dtype=np.int64)
                for k in np.flatnonzero(n):
                    at = np.flatnonzero(np.unpackbits(both[k].view(np.uint8), bitorder="little"))
                    out.append((prefix[a], self.dense[k], n[k], at))
                # AND NOT: what is left goes on as an array.
                keep[a:b] = ~self.is_dense[self.holder[ends[a:b] + 1]]
        prefix, ends = prefix[keep], ends[keep] + 1
        word = self.holder[ends].astype(np.int64)
        real = word >= 0
        prefix, ends, word = prefix[real], ends[real], word[real]
        code = prefix * (len(self.counts) + 1) + word
        order = np.argsort(code, kind="stable")
        code, ends = code[order], ends[order]
        heads = np.flatnonzero(np.diff(code, prepend=-1))
        popcount = np.diff(np.append(heads, len(code)))
        p, w = np.divmod(code[heads], len(self.counts) + 1)
        if out:
            p = np.concatenate([p, [x[0] for x in out]])
            w = np.concatenate([w, [x[1] for x in out]])
            popcount = np.concatenate([popcount, [x[2] for x in out]])
            ends = np.concatenate([ends, *(x[3] for x in out)])
        return p, w, popcount, ends

    def runs(self, words: np.ndarray) -> Iterator[np.ndarray]:
        """The words in runs of about RUN occurrences."""
        total = np.cumsum(self.counts[words]) // RUN
        return iter(np.split(words, np.flatnonzero(np.diff(total)) + 1)) if len(words) else iter(())


def shifted(bits: np.ndarray) -> np.ndarray:
    """A plain bitmap moved by one position."""
    out = bits << np.uint64(1)
    out[1:] |= bits[:-1] >> np.uint64(63)
    return out


def grown(shard: Shard, words: np.ndarray, longest: int, passes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words of each phrase as a matrix, popcounts) of all phrases of 2 to longest words that begin with one of words.

    passes(a, b): which pairs of words phrases may grow through. Depth-first over runs of first words.
    """
    for run in shard.runs(words):
        phrases = run[:, None]
        prefix = np.repeat(np.arange(len(run)), shard.counts[run])
        ends = np.concatenate([shard.positions(w) for w in run])
        for size in range(2, longest + 1):
            p, w, n, ends = shard.extended(prefix, ends)
            ok = passes(phrases[p, -1], w, size)
            ends = ends[np.repeat(ok, n)]
            phrases, n = np.concatenate([phrases[p[ok]], w[ok, None]], axis=1), n[ok]
            if not len(n):
                break
            yield phrases, n
            prefix = np.repeat(np.arange(len(n)), n)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each pair of words; a word alone is paired with zero."""
    h = np.empty(2 * len(a), np.uint64)
    h[::2], h[1::2] = a, b
    return sequence_hashes(h, 2)[::2] if len(a) else h


class Filter:
    """A Bloom filter over 64-bit hashes: four bits each, of a number of bits that is a power of two."""

    SEGMENT = 1 << 19

    def __init__(self, bits: int, segments: dict[int, bytes]):
        self.size = bits
        self.raw = np.zeros(bits // 8, np.uint8)
        for k, blob in segments.items():
            at = k * self.SEGMENT // 8
            self.raw[at : at + len(blob)] = np.frombuffer(blob, np.uint8)

    @staticmethod
    def places(h: np.ndarray, bits: int) -> list[np.ndarray]:
        step = (h >> np.uint64(32)) | np.uint64(1)
        return [((h + step * np.uint64(i)) & np.uint64(bits - 1)).astype(np.int64) for i in range(4)]

    def has(self, h: np.ndarray) -> np.ndarray:
        return reduce(np.logical_and, ((self.raw[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1 for at in self.places(h, self.size)), np.ones(len(h), bool))

    @classmethod
    def of(cls, rows: DataFrame, most: int = FILTER_BYTES) -> "Filter":
        """Of df(a, b), b null for a word alone. Segments are filled by tasks; together they have at most ``most`` bytes."""
        bits = cls.SEGMENT
        wanted = min(most * 8, FILTER_BITS * rows.count())
        while bits < wanted:
            bits *= 2
        segment = min(cls.SEGMENT, bits)

        def place(batches):
            for batch in batches:
                a, b = (batch.column(c).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("a", "b"))
                at = np.unique(np.concatenate(cls.places(pair_keys(a, b), bits)))
                yield pa.RecordBatch.from_pydict({"k": pa.array(at // segment), "i": pa.array((at % segment).astype(np.int32))})

        def fill(table: pa.Table) -> pa.Table:
            raw = np.zeros(segment, np.uint8)
            raw[table["i"].to_numpy()] = 1
            return pa.table({"k": table["k"].slice(0, 1), "m": pa.array([np.packbits(raw, bitorder="little").tobytes()], pa.binary())})

        made = rows.select("a", "b").mapInArrow(place, "k long, i int").distinct().groupBy("k").applyInArrow(fill, "k long, m binary")
        return cls(bits, {r.k: bytes(r.m) for r in made.collect()})


GRAM = "a long, b long, c long, d long"


def words_and_pairs(texts: DataFrame) -> DataFrame:
    """a, b, n: popcounts of words (b null) and of pairs, summed over shards."""

    def count(batches):
        for piece in shards(batches):
            shard = Shard(*piece)
            yield pa.RecordBatch.from_pydict({"a": signed(shard.key), "b": pa.nulls(len(shard.key), pa.int64()), "n": pa.array(shard.counts, pa.int64())})
            for phrases, n in grown(shard, np.arange(len(shard.key)), 2, lambda a, b, size: np.ones(len(a), bool)):
                yield pa.RecordBatch.from_pydict({"a": signed(shard.key[phrases[:, 0]]), "b": signed(shard.key[phrases[:, 1]]), "n": pa.array(n, pa.int64())})

    return texts.mapInArrow(count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def longer_phrases(texts: DataFrame, frequent: Filter, longest: int) -> DataFrame:
    """Rows of three kinds. a to d, n: popcounts of phrases of 3 and 4 words; a, lang, word: frequent words; lang, n: all of its words."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)
    names = ["a", "b", "c", "d", "lang", "word", "n"]

    def rows(n, **columns):
        return pa.RecordBatch.from_pydict({c: columns.get(c, pa.nulls(len(n), pa.string() if c in ("lang", "word") else pa.int64())) for c in names[:-1]} | {"n": pa.array(n, pa.int64())})

    def count(batches):
        known = shared.value
        for piece in shards(batches):
            shard = Shard(*piece)
            total = np.bincount(shard.lang, weights=shard.counts, minlength=len(shard.langs)).astype(np.int64)
            yield rows(total, lang=shard.langs.cast(pa.string()))
            often = np.flatnonzero(known.has(pair_keys(shard.key, np.zeros_like(shard.key))))
            yield rows(shard.counts[often], a=signed(shard.key[often]), lang=shard.langs.take(pa.array(shard.lang[often])).cast(pa.string()), word=shard.texts.take(pa.array(shard.text[often])).cast(pa.string()))
            for phrases, n in grown(shard, often, longest, lambda a, b, size: known.has(pair_keys(shard.key[a], shard.key[b]))):
                if phrases.shape[1] > 2:
                    yield rows(n, **{c: signed(shard.key[phrases[:, j]]) for j, c in enumerate("abcd"[: phrases.shape[1]])})

    made = texts.mapInArrow(count, f"{GRAM}, lang string, word string, n long")
    return made.groupBy("a", "b", "c", "d", "lang", "word").agg(F.sum("n").alias("n"))


def mine(df: DataFrame, least: int = 30, longest: int = 4, redundant: int = 80, scale: int = 2_000_000, top: int | None = 2000, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of df(text, lang): the collocations of 2 to longest (at most 4) words, found least times.

    A phrase goes when a longer one that holds it has redundant percent of its count; with top, each lang's first ones are returned.
    """
    if not 2 <= longest <= 4:
        raise ValueError("phrases have 2 to 4 words")
    spark = tuned(df.sparkSession)
    texts = df.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    short = stored(words_and_pairs(texts).where(F.col("n") >= least), "phrases-short")
    frequent = Filter.of(short, filter_bytes)
    is_gram = F.col("c").isNotNull()
    more = stored(longer_phrases(texts, frequent, longest).where(~is_gram | (F.col("n") >= least)), "phrases-long")
    none = F.lit(None).cast("long")
    grams = short.select("a", "b", none.alias("c"), none.alias("d"), "n").unionByName(more.where(is_gram).select("a", "b", "c", "d", "n"))
    key = F.filter(F.array("a", "b", "c", "d"), lambda x: x.isNotNull())
    grams = stored(grams.select(key.alias("p"), F.col("n").alias("f")), "phrases")
    words = more.where("word is not null").select(F.col("a").alias("w"), "lang", "word")
    totals = more.where("word is null and lang is not null").select("lang", F.col("n").alias("total"))

    found = grams.where(F.size("p") >= 2).select("p", F.col("f").alias("a"))
    held = longer_ones(found, redundant)
    best = lowest_cuts(found, grams, scale)
    kept = best.join(held, "p", "left").where(F.coalesce(F.lit(100) * F.col("most") < F.lit(redundant) * F.col("a"), F.lit(True))).drop("most")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    named = spelled(kept, words)
    if top is not None:
        # A lang's first rows are among the first of each of its shares, so that no task ranks all of a lang's phrases.
        share = Window.partitionBy("lang", F.pmod(F.xxhash64("p"), F.lit(SHARES))).orderBy(*order)
        named = named.withColumn("_r", F.row_number().over(share)).where(F.col("_r") <= top).drop("_r")
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def longer_ones(found: DataFrame, redundant: int) -> DataFrame:
    """p, most: the largest count of a longer phrase among found(p, a) that holds p."""
    size = F.size("p")
    each = found.where(size > 2).select("p", "a", F.explode(F.sequence(F.lit(2), size - 1)).alias("m"))
    each = each.select("p", "a", "m", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1)).alias("at"))
    return each.select(F.slice("p", F.col("at"), F.col("m")).alias("p"), "a").groupBy("p").agg(F.max("a").alias("most"))


def lowest_cuts(found: DataFrame, grams: DataFrame, scale: int) -> DataFrame:
    """p, a, l, r, score: of each phrase's cuts the one of the lowest score, then after the fewest words."""
    cuts = found.select("p", "a", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    cuts = cuts.select("p", "a", "k", F.slice("p", F.lit(1), F.col("k")).alias("x"), F.slice("p", F.col("k") + 1, F.size("p") - F.col("k")).alias("y"))
    part = lambda c, n: grams.select(F.col("p").alias(c), F.col("f").alias(n))
    both = cuts.join(part("x", "l"), "x").join(part("y", "r"), "y")
    score = F.expr(f"(cast({scale} as decimal(20, 0)) * cast(a as decimal(18, 0))) div (cast(l as decimal(18, 0)) + cast(r as decimal(18, 0)))")
    least = both.groupBy("p", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    return least.select("p", "a", "best.l", "best.r", "best.score")


def spelled(found: DataFrame, words: DataFrame) -> DataFrame:
    """lang and phrase of found's word keys p, each word joined to its spelling and put at its place."""
    each = found.select("p", F.posexplode("p").alias("at", "w")).join(words, "w")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
    return found.join(each.groupBy("p").agg(F.first("lang").alias("lang"), text.alias("phrase")), "p")


def oracle(least: int = 30, top: int = 2000) -> str:
    pieces = r"string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')"
    return rf"""
with p as (
  select coalesce(lang, 'und') as lang, unnest({pieces}) as piece from documents
), w as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p
), o as (
  select lang, w, unnest(generate_series(1, len(w))) as i from w where len(w) > 0
), g as (
  select lang, k, w[i : i + k - 1] as p from o, (values (1), (2), (3), (4)) t(k) where i + k - 1 <= len(w)
), f as (
  select lang, k, p, count(*) as f from g group by lang, k, p having count(*) >= {least}
), n as (
  select lang, count(*) as n from o group by lang
), c as (
  select lang, k, p, f as a, unnest(generate_series(1, k - 1)) as cut from f where k >= 2
), s as (
  select c.lang, c.p, c.a, c.cut, l.f as l, r.f as r,
    cast(cast(2000000 as hugeint) * cast(c.a as hugeint) // (cast(l.f as hugeint) + r.f) as bigint) as score
  from c join f l on l.lang = c.lang and l.p = c.p[1 : c.cut] join f r on r.lang = c.lang and r.p = c.p[c.cut + 1 : c.k]
), b as (
  select lang, p, a, l, r, score from s qualify row_number() over (partition by lang, p order by score, cut) = 1
), h as (
  select f.lang, p[i : i + m - 1] as p, max(f) as most
  from f, (values (2), (3)) t(m), (values (1), (2), (3)) u(i) where m < k and i + m - 1 <= k group by 1, 2
), d as (
  select b.lang, list_aggregate(b.p, 'string_agg', ' ') as phrase, a, l, r, n, score
  from b join n on n.lang = b.lang left join h on h.lang = b.lang and h.p = b.p where coalesce(100 * most < 80 * a, true)
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from d qualify rank <= {top}
"""


ORACLE = oracle()
