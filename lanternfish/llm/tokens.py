"""A byte-level BPE vocabulary in a worker: cutting texts where no token can cross, encoding the cuts, pieces of ids.

Texts are cut only where every reading of the pre-tokenizer's pattern ends a
token: before a single space or around a single line feed between characters
that can't be white space, and between an ASCII letter and a sign that starts
neither a contraction nor a special token. So each distinct cut can be encoded
alone, and ids of a text are the ids of its cuts in order.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa

from lanternfish.llm.textops import binary_array, bytes_of

_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_LEAD = np.zeros(256, bool)
_LEAD[0xC3:0xE0] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SIGN = np.zeros(256, bool)
_SIGN[list(b',.!?;:$%&*#"()')] = True


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the cuts start in data, rows' starts included, and len(data) at the end."""
    n = len(data)
    at = np.zeros(n + 1, bool)
    at[offsets] = True
    if n > 1:
        after = _SOLID[data] | _LEAD[data]
        before = _SOLID[data]
        before[1:] |= _LEAD[data[:-1]] & (data[1:] >= 0x80)
        middle = np.zeros(n, bool)
        middle[1:-1] = before[:-2] & after[2:]
        space, line = middle & (data == 32), middle & (data == 10)
        row = np.zeros(n + 1, bool)
        row[offsets] = True
        # A separator at a row's edge has no neighbour there.
        for mask in (space, line):
            mask &= ~row[:n] & ~row[1:]
        at[:n] |= space | line
        at[1:] |= line
        at[1:n] |= _LETTER[data[:-1]] & _SIGN[data[1:]]
    return np.flatnonzero(at)


@lru_cache(maxsize=2)
def vocabulary(source: str) -> "Vocabulary":
    return Vocabulary(source)


class Vocabulary:
    """Of a tokenizers JSON with a byte-level BPE model."""

    #: Cuts that are encoded in one call.
    AT_ONCE = 65_536

    def __init__(self, source: str):
        spec = json.loads(source)
        if spec["model"]["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer") or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("a byte-level BPE tokenizer without normalizer and prefix space is needed")
        self.source, self.encoders = source, None
        as_byte = byte_of_char()
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.special_bytes = [x.encode() for x in self.special]
        size = 1 + max([*spec["model"]["vocab"].values(), *(x["id"] for x in spec["added_tokens"])])
        self.pieces = [b""] * size
        for token, i in spec["model"]["vocab"].items():
            self.pieces[i] = bytes(as_byte[c] for c in token) if all(c in as_byte for c in token) else token.encode()
        for x in spec["added_tokens"]:
            self.pieces[x["id"]] = x["content"].encode()
        self.decimals = [b"%d" % i for i in range(size)]
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")

    def encoder(self):
        """The library's tokenizer and the quicker one, made when first needed."""
        if self.encoders is None:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_str(self.source)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.encoders = tokenizer, self._plain(json.loads(self.source))
        return self.encoders

    def slim(self) -> "Vocabulary":
        """Without what only encoding needs; it takes more memory than all the rest and workers live on."""
        self.encoders = None
        return self

    def _plain(self, spec: dict):
        """A quicker encoder for Latin, Greek and Cyrillic text, if ids follow the order of merges."""
        import tiktoken

        vocab, special = spec["model"]["vocab"], {x["id"] for x in spec["added_tokens"]}
        ids = [vocab.get(m.replace(" ", "", 1) if isinstance(m, str) else m[0] + m[1]) for m in spec["model"]["merges"]]
        if None in ids or ids != sorted(ids) or spec["model"].get("ignore_merges") or spec["model"].get("dropout"):
            return None
        ranks = {self.pieces[i]: i for i in vocab.values() if i not in special}
        if sum(len(p) == 1 for p in ranks) != 256:
            return None
        self.line_feed = ranks[b"\n"]
        # The byte-level pre-tokenizer's pattern, a fixed value of the file format.
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        return tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, cuts_: list[bytes]) -> list[bytes]:
        """The ids of each cut, as bytes of dtype."""
        out: list = [None] * len(cuts_)
        tokenizer, plain = self.encoder()
        if plain:
            for k in range(0, len(cuts_), self.AT_ONCE):
                self._lines(cuts_[k : k + self.AT_ONCE], k, plain, out)
        rest = []
        for k, ids in enumerate(out):
            if ids is None:
                cut = cuts_[k]
                if plain and (cut.isascii() or max(cut) < 0xD4) and not any(x in cut for x in self.special_bytes):
                    out[k] = np.array(plain(cut.decode()), self.dtype).tobytes()
                else:
                    rest.append(k)
        if rest:
            for k, e in zip(rest, tokenizer.encode_batch([cuts_[k].decode() for k in rest], add_special_tokens=False), strict=True):
                out[k] = np.array(e.ids, self.dtype).tobytes()
        return out

    def _lines(self, cuts_: list[bytes], at: int, plain, out: list) -> None:
        """Sets from ``at`` on the ids of cuts that can be encoded together, a line each.

        A line feed between two characters that aren't white space, or before one space and such a character, is a token of
        its own, and no other token of these lines is that one.
        """
        data, offsets = bytes_of(pa.chunked_array([pa.array(cuts_, pa.binary())]))
        fit = np.diff(offsets) > 0
        if not fit.any():
            return
        starts = np.minimum(offsets[:-1], len(data) - 1)
        ends = np.maximum(offsets[1:] - 1, 0)
        padded = np.append(data, np.uint8(0))
        head = padded[starts + ((data[starts] == 32) & (np.diff(offsets) > 1))]
        fit &= _SOLID[head] | _LEAD[head]
        fit &= _SOLID[data[ends]] | (data[ends] >= 0x80) & _LEAD[data[np.maximum(ends - 1, 0)]]
        unfit = np.concatenate([[0], np.cumsum((data == 10) | (data >= 0xD4))])
        fit &= unfit[offsets[1:]] == unfit[offsets[:-1]]
        own = np.flatnonzero(fit).tolist()
        text = b"\n".join([cuts_[k] for k in own])
        if any(x in text for x in self.special_bytes):
            own = [k for k in own if not any(x in cuts_[k] for x in self.special_bytes)]
            text = b"\n".join([cuts_[k] for k in own])
        if not own:
            return
        ids = np.array(plain(text.decode()), self.dtype)
        breaks = np.flatnonzero(ids == self.line_feed)
        if len(breaks) != len(own) - 1:
            raise RuntimeError("lines of cuts and lines of ids differ in number")
        raw, size, a = ids.tobytes(), self.dtype.itemsize, 0
        for k, b in zip(own, [*(breaks * size).tolist(), len(raw)], strict=True):
            out[at + k] = raw[a:b]
            a = b + size


def byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Cut:
    """A text column as numbers of distinct cuts."""

    def __init__(self, column: pa.ChunkedArray):
        data, offsets = bytes_of(column)
        starts = cuts(data, offsets)
        coded = binary_array(data, starts).dictionary_encode() if len(starts) > 1 else None
        self.which = coded.indices.to_numpy(zero_copy_only=False) if coded is not None else np.zeros(0, np.int32)
        self.distinct: list[bytes] = coded.dictionary.to_pylist() if coded is not None else []
        #: For each row the number of its first cut.
        self.firsts = np.searchsorted(starts[:-1], offsets) if len(starts) > 1 else np.zeros(len(offsets), np.int64)

    def joined(self, ids: list[bytes], dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids in one array and each row's offsets into it, from the ids of distinct cuts."""
        flat = np.frombuffer(b"".join(ids), dtype)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // dtype.itemsize
        begins = np.cumsum(lengths) - lengths
        own = lengths[self.which]
        ends = np.zeros(len(own) + 1, np.int64)
        np.cumsum(own, out=ends[1:])
        at = np.repeat(begins[self.which] - ends[:-1], own)
        at += np.arange(ends[-1])
        return flat[at], ends[self.firsts]
