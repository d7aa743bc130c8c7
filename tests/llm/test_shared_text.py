"""Line removal and phrase mining against plain versions, on awkward rows and on an empty table."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lanternfish.llm import line_dedup, phrases

BLANKS = " \t\n\x0b\x0c\r"
LONG = "This line stands in many documents of the table"
LINES = [
    (1, f"{LONG}\nown\n  {LONG.upper()}\t\n"), (2, f"x\n{LONG}"), (3, LONG), (4, f"{LONG}\n{LONG}\nend"), (None, f"{LONG}\nno id"), (None, LONG), (5, None), (6, ""), (7, "\n\n"), (8, "short\nshort"), (9, "short"), (10, "short"),
    (11, "Ünïcode line with ÀÉÎ and twenty\nrest\r\n"), (12, "Ünïcode line with ÀÉÎ and twenty"), (13, "Ünïcode line with àéî and twenty"), (14, "\x0bünïcode line with ÀÉÎ and twenty "), (14, "Ünïcode line with ÀÉÎ and Twenty"), (15, "z\n" * 3000 + f"{LONG}\n" * 3000 + "tail"), (2, f"x\n{LONG}"),
]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_lines(rows, min_chars=20, min_docs=3):
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[lower(line.strip(BLANKS))].add(i)
    last = {k: max(x for x in ids if x is not None) for k, ids in holders.items() if len(k) >= min_chars and len(ids) >= min_docs}
    out = Counter()
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if (k := lower(x.strip(BLANKS))) not in last or last[k] == i]
        out[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


@pytest.mark.parametrize("heavy", [1, 50_000])
def test_lines_of_many_documents(spark, monkeypatch, heavy):
    """heavy: 1 sends all keys but one through the shuffle, 50000 sends all by broadcast."""
    monkeypatch.setattr(line_dedup, "HEAVY", heavy)
    df = spark.createDataFrame([(i, t, k, "n") for k, (i, t) in enumerate(LINES)], "doc_id long, text string, n_lines int, _gone string").repartition(3)
    got = line_dedup.drop_common_lines(df).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got) == plain_lines(LINES)
    kept = line_dedup.drop_common_lines(df, keep=True)
    assert kept.columns == ["doc_id", "text", "n_lines", "_gone", "n_lines_", "n_dropped"]
    assert Counter((r.doc_id, r.n_lines_, r.n_dropped, r.text) for r in kept.collect()) == plain_lines(LINES)
    assert {r.n_lines for r in kept.collect()} == set(range(len(LINES)))


def test_lines_of_nothing(spark):
    assert line_dedup.drop_common_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lines_of_a_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = line_dedup.drop_common_lines(docs).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got) == plain_lines(rows)
    assert sum(r.n_dropped for r in got)


def plain_phrases(rows, least, top):
    """Every count, cut and containment as the contract says, in plain Python."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        ranked = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and inside(p, q) for q, b in found.items()):
                continue
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), p[:k], p[k:]))
        for rank, (score, a, phrase, x, y) in enumerate(sorted(ranked)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, counts[x], counts[y], n[lang], -score))
    return out


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
SAID = ["the cat sat on the mat", "The CAT sat, on the mat", "the the the the the", "a b c d e", "É é ñ\tß", "one.two:three\nfour", "", None, "en es de", "es en de the cat"]


def phrase_rows(seed=5, n=400):
    rng = random.Random(seed)
    return [(rng.choice(["en", "es", "de", None]), " ".join(rng.choice([x for x in SAID if x]) for _ in range(rng.randrange(4))) + rng.choice([" ", ".", "\n"]) + (rng.choice(SAID) or "")) for _ in range(n)] + [("en", None), (None, "")]


@pytest.mark.parametrize("least, top, shard, run, size", [(3, 40, 6 << 20, 1 << 18, 64 << 20), (2, 2000, 900, 7, 1)])
def test_phrases(spark, monkeypatch, least, top, shard, run, size):
    """Once in one shard; once in shards smaller than a text, runs of few words and a filter that is full."""
    for name, value in (("SHARD", shard), ("RUN", run)):
        monkeypatch.setattr(phrases, name, value)
    rows = phrase_rows() + ([("en", "the cat sat on the mat. " * 200)] if shard < 1000 else [])
    df = spark.createDataFrame([(*r, k, "x") for k, r in enumerate(rows)], "lang string, text string, n int, word string").repartition(3)
    got = phrases.mine(df, least, top=top, filter_bytes=size).collect()
    assert {tuple(r[c] for c in COLUMNS) for r in got} == plain_phrases(rows, least, top) and len(got) == len({(r.lang, r["rank"]) for r in got})


def test_phrases_of_nothing(spark):
    assert phrases.mine(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert phrases.mine(spark.createDataFrame([("en", None), (None, " . ")], "lang string, text string")).count() == 0


def test_bitmaps_of_a_shard():
    """Plain bitmaps and arrays of positions give the same phrases, and no phrase crosses a piece, a row or a cut."""
    rng = random.Random(3)
    text = " ".join(rng.choice(["a", "a", "a", "b", "b", f"w{rng.randrange(300)}", "x."]) for _ in range(6000))
    table = pa.table({"lang": ["en", "de"], "text": [text, text[::-1]]})
    every = lambda a, b, size: np.ones(len(a), bool)
    counted = []
    for wide in (True, False):
        total = Counter()
        for piece in phrases.shards(table.to_batches()):
            s = phrases.Shard(*piece)
            assert len(s.dense) >= 2
            if not wide:
                s.dense = s.dense[:0]
            for words, n in phrases.grown(s, np.arange(len(s.key)), 4, every):
                for w, k in zip(words.tolist(), n.tolist(), strict=True):
                    total[tuple(int(s.key[x]) for x in w)] += k
        counted.append(total)
    pieces = [re.findall(r"[^ ]+", p) for t in (text, text[::-1]) for p in t.split(".")]
    assert counted[0] == counted[1] and sum(counted[0].values()) == sum(max(0, len(p) - k + 1) for p in pieces for k in (2, 3, 4))
