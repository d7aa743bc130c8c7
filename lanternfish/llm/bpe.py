"""BPE encoding and decoding with a table of distinct words.

Texts are cut into words in blocks; each block sends its distinct words to the
buckets of their hashes, a bucket encodes each distinct word once, and the ids
go back to the blocks, where they are joined to the words by position. Decoding
joins ids to pieces (at most the vocabulary's size, so it travels with tasks).

Defined results: a null or empty text has no ids and decodes to an empty text;
repeated rows and doc_ids give one result row each; a null doc_id stays null; an
empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from lanternfish.llm.common import documents, from_blob, packed, parts, to_blob
from lanternfish.llm.textops import binary_array
from lanternfish.llm.tokens import Cut, vocabulary

#: What encode() can return, by name.
OUTPUTS = {"ids": "array<int>", "decoded": "string", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}


def read_tokenizer(path: str) -> str:
    """The tokenizer's JSON, read by the driver; tasks get it with their code."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def values_blob(values: list[bytes]) -> bytes:
    """Values as one binary and their lengths in one to four bytes each; offsets, which only rise, would hardly be compressed."""
    n = np.fromiter(map(len, values), np.int64, len(values))
    size = next(k for k in (1, 2, 4) if n.max(initial=0) < 1 << 8 * k)
    return to_blob(pa.table({"size": pa.array([size], pa.int8()), "n": pa.array([n.astype(f"<u{size}").tobytes()], pa.binary()), "values": pa.array([b"".join(values)], pa.large_binary())}))


def blob_values(blob: bytes) -> pa.Array:
    row = from_blob(blob).to_pylist()[0]
    ends = np.cumsum(np.frombuffer(row["n"], f"<u{row['size']}"), dtype=np.int64)
    return binary_array(np.frombuffer(row["values"], np.uint8), np.concatenate([[0], ends]))


def encode(df: DataFrame, tokenizer: str, outputs: tuple[str, ...] = ("ids",)) -> DataFrame:
    """doc_id and the named outputs of each row of df(doc_id, text): ids, decoded (their text), n_tokens and SHA-256 digests."""
    spark = df.sparkSession
    source = spark.sparkContext.broadcast(read_tokenizer(tokenizer))
    n = parts(spark)
    blocks = packed(documents(df), level=3)

    def deal(distinct: list[bytes]) -> list[np.ndarray]:
        """The numbers of the distinct words that each bucket gets."""
        h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct)) % np.uint64(n)
        order = np.argsort(h, kind="stable")
        return np.split(order, np.searchsorted(h[order], np.arange(1, n)))

    def ask(batches):
        for batch in batches:
            for b, p in zip(*(batch.column(c).to_pylist() for c in ("_b", "_p")), strict=True):
                cut = Cut(from_blob(p)["text"])
                dealt = [(k, [cut.distinct[i] for i in own]) for k, own in enumerate(deal(cut.distinct)) if len(own)]
                yield pa.RecordBatch.from_pydict({"_b": pa.array([b] * len(dealt), pa.int64()), "_k": pa.array([k for k, _ in dealt], pa.int32()), "_w": pa.array([values_blob(ws) for _, ws in dealt], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        vocab = vocabulary(source.value)
        asked = [blob_values(p) for p in table["_w"].to_pylist()]
        coded = pa.chunked_array(asked).combine_chunks().dictionary_encode()
        ids = pa.array(vocab.encode(coded.dictionary.to_pylist()), pa.binary())
        which, at, out = coded.indices, 0, []
        for a in asked:
            out.append(values_blob(ids.take(which.slice(at, len(a))).to_pylist()))
            at += len(a)
        return pa.table({"_b": table["_b"], "_k": table["_k"], "_i": pa.array(out, pa.binary())})

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        vocab = vocabulary(source.value).slim()
        got = dict(zip(right["_k"].to_pylist(), right["_i"].to_pylist(), strict=True))
        made = []
        for p in left["_p"].to_pylist():
            rows = from_blob(p)
            cut = Cut(rows["text"])
            ids: list = [None] * len(cut.distinct)
            for k, own in enumerate(deal(cut.distinct)):
                if len(own):
                    back = blob_values(got[k]).to_pylist()
                    if len(back) != len(own):
                        raise RuntimeError("a block's words and the ids it got back differ in number")
                    for i, x in zip(own.tolist(), back, strict=True):
                        ids[i] = x
            made.append(results(rows["doc_id"], *cut.joined(ids, vocab.dtype), vocab, outputs))
        return pa.concat_tables(made)

    asked = blocks.mapInArrow(ask, "_b long, _k int, _w binary")
    answered = asked.groupBy("_k").applyInArrow(answer, "_b long, _k int, _i binary")
    schema = "doc_id long, " + ", ".join(f"{c} {OUTPUTS[c]}" for c in outputs)
    # A block without words gets no answer; cogroup still hands it over.
    return blocks.groupBy("_b").cogroup(answered.groupBy("_b")).applyInArrow(join, schema)


def results(doc_id, flat: np.ndarray, offsets: np.ndarray, vocab, outputs: tuple[str, ...]) -> pa.Table:
    lists: dict[str, list] = {c: [] for c in outputs}
    ends, digests = offsets.tolist(), not set(outputs) <= {"ids", "n_tokens"}
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        ids = flat[a:b].tolist() if digests else ()
        if "ids_sha256" in lists:
            lists["ids_sha256"].append(hashlib.sha256(b",".join(map(vocab.decimals.__getitem__, ids))).hexdigest())
        if "decoded_sha256" in lists or "decoded" in lists:
            raw = b"".join(map(vocab.pieces.__getitem__, ids))
            text = raw.decode("utf-8", "replace")
            if "decoded" in lists:
                lists["decoded"].append(text)
            if "decoded_sha256" in lists:
                lists["decoded_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
    made = {c: pa.array(lists[c], pa.string()) for c in outputs if c not in ("ids", "n_tokens")}
    if "ids" in lists:
        made["ids"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.astype(np.int32)))
    if "n_tokens" in lists:
        made["n_tokens"] = pa.array(np.diff(offsets), pa.int64())
    return pa.table({"doc_id": doc_id.cast(pa.int64()), **{c: made[c] for c in outputs}})


def decode(df: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text of df(doc_id, ids): each id joined to its piece by position. Ids outside the vocabulary give nothing; null ids an empty text."""
    source = df.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer))

    def pieces(batches):
        table = vocabulary(source.value).pieces
        for batch in batches:
            texts = [b"".join(table[i] for i in ids or () if i is not None and 0 <= i < len(table)).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return df.select("doc_id", "ids").mapInArrow(pieces, "doc_id long, text string")
