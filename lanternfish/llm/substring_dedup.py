"""Substring removal by relative Lempel-Ziv parsing against an index of all documents.

The reference is the whole table, cut into blocks of text that are dealt by hash, so
that a document is parsed against exactly the blocks that can hold its phrases
(``window`` words in a row), not all of them. Two rounds:

1. Each phrase has an anchor, the least hash among its ``gram``-word sequences:
   equal phrases have equal anchors. Blocks of documents send the anchors of
   their phrases (about 8 in 100 words), buckets return those that lie at two
   places or more.
2. Each stretch of text whose phrases have such an anchor goes to the anchor's
   reference block, once for each block of documents, with the places where it
   stands. There the text is indexed by phrase. Every stretch is parsed greedily
   from left to right: at a phrase that occurs elsewhere in the block, the factor
   is extended word by word for as long as the reference goes on alike; other
   words are literals. As another place may go on where a factor ends, the phrases
   across its end are looked up as well, so no factor hides the next.

Factors have ``window`` words or more, word for word equal (64-bit hashes of
words), go back to their documents, and are removed.

Defined results: null and empty texts have no words and nothing is removed; a
table's repeated rows count as other places, so their phrases go everywhere they
stand; null doc_ids stay null; an empty table gives no rows; columns other than
doc_id and text are returned unchanged with ``keep``, and else not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternfish.llm.common import from_blob, packed, parts, trim
from lanternfish.llm.textops import bytes_of, row_of, sequence_hashes, sliding_least, whole, word_hashes, word_spans

_POSITION = np.uint64((1 << 24) - 1)
#: Sequences ranked at once, by the upper 40 bits of their hash and their place in a run; a block of more is ranked in runs.
RUN = 1 << 23
#: Bytes of text in a block of documents; its words' arrays take some 25 times as much in a worker.
BLOCK = 1 << 20
#: Reference blocks for each partition of a shuffle: one is in a worker's memory at a time.
SPLIT = 4


class Words:
    """The words of one block of documents."""

    def __init__(self, column: pa.ChunkedArray):
        self.data, self.offsets = bytes_of(column)
        self.starts, self.ends, self.firsts = word_spans(self.data, self.offsets)

    def anchored(self, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, place of the anchor, anchor) of each phrase."""
        grams = sequence_hashes(word_hashes(self.data, self.starts, self.ends), gram)
        at = np.flatnonzero(whole(self.firsts, window))
        width = window - gram + 1
        least = []
        # A run goes on for a phrase's width into the next, so that each phrase is ranked whole in the run where it starts.
        for a in range(0, max(len(grams) - width + 1, 0), RUN):
            run = grams[a : a + RUN + width - 1]
            ranked = (run & ~_POSITION) | np.arange(len(run), dtype=np.uint64)
            least.append((sliding_least(ranked, width) & _POSITION).astype(np.int64) + a)
        place = np.concatenate(least)[at] if least else np.zeros(0, np.int64)
        return at, place, grams[place]

    def anchors(self, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct anchors, and whether each stands at two places of this block."""
        _, place, anchor = self.anchored(window, gram)
        new = np.ones(len(place), bool)
        new[1:] = place[1:] != place[:-1]  # anchors don't step back from one phrase to the next
        keys, counts = np.unique(anchor[new], return_counts=True)
        return keys, counts > 1

    def stretches(self, window: int, gram: int, anchors: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(reference block, first word, end) of the stretches whose phrases have one of the anchors, all dealt to one block."""
        at, _, anchor = self.anchored(window, gram)
        own = among(anchor, anchors)
        at, to = at[own], block_of(anchor[own], n)
        row = np.searchsorted(self.firsts, at, "right")
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (to[1:] != to[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        return to[first], at[first], at[last] + window if len(at) else at


def block_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(20)) % np.uint64(n)).astype(np.int64)


def among(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(x), bool)
    keys = np.sort(keys)
    at = np.searchsorted(keys, x)
    at[at == len(keys)] = 0
    return keys[at] == x


def dealt(b: int, n: int, keys: np.ndarray, twice: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket that gets some of the keys."""
    to = block_of(keys, n)
    order = np.argsort(to, kind="stable")
    ends = np.searchsorted(to[order], np.arange(n + 1))
    some = np.flatnonzero(np.diff(ends)).tolist()
    own = [order[ends[k] : ends[k + 1]] for k in some]
    return pa.RecordBatch.from_pydict({"_b": pa.array([b] * len(some), pa.int64()), "_k": pa.array(some, pa.int64()), "_h": pa.array([keys[o].tobytes() for o in own], pa.binary()), "_m": pa.array([twice[o].tobytes() for o in own], pa.binary())})


ASKED = "_b long, _k long, _h binary, _m binary"
REPLY = "_b long, _f binary"
#: Stretches of a block of documents for a reference block: their text, words and number of places of each, and where these are.
TEXTS = "_b long, _k long, _t binary, _n binary, _m binary, _s binary"
_TEXTS = pa.schema([("_b", pa.int64()), ("_k", pa.int64()), ("_t", pa.binary()), ("_n", pa.binary()), ("_m", pa.binary()), ("_s", pa.binary())])


def lookup(table: pa.Table) -> pa.Table:
    """One bucket of anchors: to each block of documents, those of its anchors that stand at two places or more."""
    trim()
    blobs = {c: table[c].to_pylist() for c in ("_h", "_m")}
    h = np.frombuffer(b"".join(blobs["_h"]), np.uint64)
    many = np.frombuffer(b"".join(blobs["_m"]), bool)
    order = np.argsort(h, kind="stable")
    hs = h[order]
    new = np.ones(len(hs), bool)
    new[1:] = hs[1:] != hs[:-1]
    run = np.cumsum(new) - 1
    count = np.bincount(run, weights=1.0 + many[order], minlength=run[-1] + 1 if len(run) else 0)
    dup = np.zeros(len(h), bool)
    dup[order] = count[run] > 1
    out, at = [], 0
    for n in (len(x) // 8 for x in blobs["_h"]):
        out.append(h[at : at + n][dup[at : at + n]].tobytes())
        at += n
    made = pa.table({"_b": table["_b"], "_f": pa.array(out, pa.binary())})
    return made.filter(pa.array([len(x) > 0 for x in out], pa.bool_()))


def found_in(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table["_f"].to_pylist()), np.uint64)


def sent(b: int, words: Words, to: np.ndarray, first: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """A row for each reference block that gets some of the stretches; equal ones travel once."""
    raw = words.data.tobytes()
    held: dict[int, dict[bytes, list[int]]] = {}
    for k, i, x, y in zip(to.tolist(), first.tolist(), words.starts[first].tolist(), words.ends[end - 1].tolist(), strict=True):
        held.setdefault(k, {}).setdefault(raw[x:y], []).append(i)
    long = dict(zip(first.tolist(), (end - first).tolist(), strict=True))
    rows: dict[str, list] = {c: [] for c in _TEXTS.names}
    for k, own in held.items():
        rows["_b"].append(b)
        rows["_k"].append(k)
        rows["_t"].append(b" ".join(own))
        rows["_n"].append(np.array([long[at[0]] for at in own.values()], np.int32).tobytes())
        rows["_m"].append(np.array([len(at) for at in own.values()], np.int32).tobytes())
        rows["_s"].append(np.array([i for at in own.values() for i in at], np.int32).tobytes())
    return pa.RecordBatch.from_pydict(rows, _TEXTS)


def factors(h: np.ndarray, firsts: np.ndarray, copied: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, first word in it, words) of the factors of all stretches of one reference block.

    h: hashes of the words; firsts: the stretches' first words, and the end; copied: whether a stretch stands elsewhere as it is.
    All stretches are parsed in step.
    """
    pos = np.flatnonzero(whole(firsts, window))
    stretch = np.searchsorted(firsts, pos, "right") - 1
    phrase = sequence_hashes(h, window)[pos]
    order = np.argsort(phrase, kind="stable")
    same = phrase[order[1:]] == phrase[order[:-1]]
    # The reference of a phrase is the first place of its like, that of the first place the next one.
    lead = np.zeros(len(pos), np.int64)
    lead[1:] = np.where(same, 0, np.arange(1, len(pos)))
    ref = np.full(len(pos), -1, np.int64)
    ref[order] = pos[order[np.maximum.accumulate(lead)]] if len(pos) else ref
    follows = np.append(same, False)[: len(pos)]
    alone = ref == pos
    nxt = np.full(len(pos), -1, np.int64)
    nxt[order[follows]] = pos[order[1:][same]]
    ref = np.where(alone, np.where(nxt >= 0, nxt, np.where(copied[stretch], pos, -1)), ref)
    has = ref >= 0
    pos, ref = pos[has], ref[has]
    at, end, which = firsts[:-1].copy(), firsts[1:], np.arange(len(firsts) - 1)
    out: list[tuple] = []
    while len(which):
        k = np.searchsorted(pos, at)
        live = (k < len(pos)) & (np.append(pos, np.int64(1) << 62)[k] < end)
        which, end, k = which[live], end[live], k[live]
        if not len(which):
            break
        p, r = pos[k], ref[k]
        # As far as both places go on alike, within their stretches.
        room = np.minimum(end - p, firsts[np.searchsorted(firsts, r, "right")] - r)
        n, going, t = np.zeros(len(p), np.int64), np.arange(len(p)), 0
        while len(going):
            going = going[(t < room[going])]
            going = going[h[p[going] + t] == h[r[going] + t]]
            t += 1
            n[going] = t
        good = n >= window  # else two phrases have one hash
        out.append((which[good], p[good] - firsts[which[good]], n[good]))
        # The phrases across the factor's end are looked up next.
        at = np.where(good, np.maximum(p + 1, p + n - window + 1), p + 1)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def parse_block(table: pa.Table, window: int) -> pa.Table:
    """One reference block: to each block of documents its factors, as first words and lengths."""
    trim()
    texts = table["_t"].to_pylist()
    counts = [np.frombuffer(x, np.int32) for x in table["_n"].to_pylist()]
    times = [np.frombuffer(x, np.int32) for x in table["_m"].to_pylist()]
    data = np.frombuffer(b" ".join(texts), np.uint8)
    del texts
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    firsts = np.concatenate([[0], np.cumsum(np.concatenate(counts), dtype=np.int64)])
    if len(starts) != firsts[-1]:
        raise RuntimeError("stretches and their words differ in number")
    h = word_hashes(data, starts, ends)
    del starts, ends, data
    many = np.concatenate(times).astype(np.int64)
    stretch, at, n = factors(h, firsts, many > 1, window)
    # Each factor at all places of its stretch.
    places = np.frombuffer(b"".join(table["_s"].to_pylist()), np.int32)
    begin = np.cumsum(many) - many
    own = many[stretch]
    which = np.repeat(begin[stretch] - (np.cumsum(own) - own), own) + np.arange(own.sum())
    spans = np.column_stack([places[which] + np.repeat(at, own), np.repeat(n, own)]).astype(np.int32)
    of = np.repeat(np.repeat(np.arange(len(counts)), [len(c) for c in counts])[stretch], own)
    order = np.argsort(of, kind="stable")
    cuts = np.searchsorted(of[order], np.arange(len(counts) + 1))
    some = np.flatnonzero(np.diff(cuts))
    return pa.table({"_b": table["_b"].combine_chunks().take(pa.array(some)), "_f": pa.array([spans[order[cuts[k] : cuts[k + 1]]].tobytes() for k in some.tolist()], pa.binary())})


def remove_repeats(df: DataFrame, window: int = 35, gram: int = 12, keep: bool = False) -> DataFrame:
    """df(doc_id, text) parsed: doc_id, text (the kept words joined by one space), n_words, n_removed, spans.

    spans: the removed factors, as starts and ends in words. With keep, the other columns follow and rows that lose nothing
    keep their text as it was.
    """
    if not 1 <= gram <= window:
        raise ValueError("gram must lie between 1 and window")
    n = SPLIT * parts(df.sparkSession)
    extra = [f for f in df.schema.fields if f.name not in ("doc_id", "text")] if keep else []
    names = [f"_x{i}" for i in range(len(extra))]
    blocks = packed(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(F.col(f"`{f.name}`").alias(x) for f, x in zip(extra, names, strict=True))), BLOCK)

    def ask(batches):
        for batch in batches:
            for b, p in zip(batch.column("_b").to_pylist(), batch.column("_p"), strict=True):
                yield dealt(b, n, *Words(from_blob(p.as_buffer())["text"]).anchors(window, gram))

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        made, anchors = [], found_in(right)
        if len(anchors):
            for b, p in zip(left["_b"].to_pylist(), left["_p"], strict=True):
                words = Words(from_blob(p.as_buffer())["text"])
                made.append(sent(b, words, *words.stretches(window, gram, anchors, n)))
        return pa.Table.from_batches(made, _TEXTS)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        spans = np.frombuffer(b"".join(right["_f"].to_pylist()), np.int32).reshape(-1, 2)
        return pa.concat_tables([parsed(from_blob(p.as_buffer()), spans, keep) for p in left["_p"]])

    def factored(table: pa.Table) -> pa.Table:
        return parse_block(table, window)

    first = blocks.mapInArrow(ask, ASKED).groupBy("_k").applyInArrow(lookup, REPLY)
    second = blocks.groupBy("_b").cogroup(first.groupBy("_b")).applyInArrow(send, TEXTS)
    second = second.groupBy("_k").applyInArrow(factored, REPLY)
    schema = T.StructType([T.StructField(*x) for x in (("doc_id", T.LongType()), ("text", T.StringType()), ("n_words", T.LongType()), ("n_removed", T.LongType()), ("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))))] + [T.StructField(x, f.dataType) for f, x in zip(extra, names, strict=True)])
    return blocks.groupBy("_b").cogroup(second.groupBy("_b")).applyInArrow(cut, schema).withColumnsRenamed({x: f.name for f, x in zip(extra, names, strict=True)})


def covered(words: int, spans: np.ndarray) -> np.ndarray:
    """For each word whether a factor covers it."""
    edge = np.zeros(words + 1, np.int32)
    np.add.at(edge, spans[:, 0], 1)
    np.add.at(edge, spans[:, 0] + spans[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def parsed(rows: pa.Table, factors_: np.ndarray, keep: bool) -> pa.Table:
    column = rows["text"].combine_chunks()
    own = Words(column)
    gone = covered(len(own.starts), factors_)
    change = np.diff(gone.astype(np.int8), prepend=0, append=0)
    # A factor ends with its document even if the next one starts with another.
    edge = np.zeros(len(gone) + 1, bool)
    edge[own.firsts] = True
    inner = np.flatnonzero(edge[1:-1] & gone[:-1] & gone[1:]) + 1 if len(gone) > 1 else np.zeros(0, np.int64)
    begins = np.sort(np.concatenate([np.flatnonzero(change == 1), inner]))
    stops = np.sort(np.concatenate([np.flatnonzero(change == -1), inner]))
    raw, starts, ends, firsts = own.data.tobytes(), own.starts.tolist(), own.ends.tolist(), own.firsts.tolist()
    kept_at = np.flatnonzero(~gone)
    kept_first = np.searchsorted(kept_at, own.firsts).tolist()
    kept_at = kept_at.tolist()
    factor = np.searchsorted(begins, own.firsts).tolist()
    begins, stops = begins.tolist(), stops.tolist()
    texts, removed, spans = [], [], []
    for d in range(rows.num_rows):
        a, b = firsts[d], firsts[d + 1]
        mine = kept_at[kept_first[d] : kept_first[d + 1]]
        removed.append(b - a - len(mine))
        spans.append([{"start": begins[k] - a, "end": stops[k] - a} for k in range(factor[d], factor[d + 1])])
        if keep and not removed[-1]:
            texts.append(column[d].as_py())
        else:
            texts.append(b" ".join([raw[starts[i] : ends[i]] for i in mine]).decode("utf-8", "replace"))
    out = {"doc_id": rows["doc_id"], "text": pa.array(texts, pa.string()), "n_words": pa.array(np.diff(own.firsts), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))}
    return pa.table(out | {c: rows[c] for c in rows.column_names if c not in ("doc_id", "text")})
