"""Hard negatives against a plain search over all pairs, in Python's integers."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from lanternfish.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, q string, part int"


def plain(rows, every=100, k=5, top=10, low=30, high=90):
    live = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(256 * x) for x in v):
            continue
        live.append((i, label, [math.floor(256 * x) for x in v]))
    out = Counter()
    for a, la, x in live:
        if a % every:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), i, label) for i, label, y in live]
        for p, i, label in sorted(s for s in scored if s[2] == la and s[1] != a)[:k]:
            inside = sorted(s for s in scored if s[2] != la and low * -p <= 100 * -s[0] <= high * -p)[:top]
            for rank, (n, j, _) in enumerate(inside, 1):
                out[a, i, rank, j, -p, -n] += 1
    return out


def made(rows, spark, **more):
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA).repartition(3)
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return Counter(tuple(r[c] for c in names) for r in hn.mine(df, **more).collect())


def vectors(n, seed=1, dim=12):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(dim)] for _ in range(6)]
    return [(i, [c + rng.gauss(0, 0.15) for c in rng.choice(centres)], rng.randrange(4)) for i in range(n)]


@pytest.fixture(scope="module")
def awkward():
    rows = vectors(500)
    rows += [(None, [1.0] * 12, 1), (600, None, 1), (700, [1.0] * 12, None), (800, [0.5, None], 1), (900, [float("nan")] * 12, 2), (1000, [float("inf")] + [0.0] * 11, 2), (1100, [1e308, 1.0], 2), (1200, [], 1), (1300, [0.5, 0.25], 3)]
    return rows + [rows[100], rows[100], rows[7]] + [(2000 + i, [0.25] * 12, i % 3) for i in range(200)]


@pytest.mark.parametrize(("rows", "leaf", "queries"), [(8192, 64, 512), (60, 4, 3)])
def test_against_all_pairs(spark, awkward, monkeypatch, rows, leaf, queries):
    """Copies, repeated rows, ties, short and empty vectors and those that take no part; in one tree, then in many groups of small ones."""
    for name, value in (("ROWS", rows), ("LEAF", leaf), ("QUERIES", queries)):
        monkeypatch.setattr(hn, name, value)
    monkeypatch.setattr(hn.Tree.__init__, "__defaults__", (leaf,))
    assert made(awkward, spark) == plain(awkward)


def test_components_of_any_size(spark):
    """Rows with large components are searched exactly; the scores that don't fit are of no window and not returned."""
    rows = vectors(300, 2) + [(401, [1e20] + [0.1] * 11, 1), (403, [3e6] * 12, 2), (404, [-2.0**40] + [0.0] * 11, 3), (500, [2.0**21] + [0.5] * 11, 2), (501, [2.0**20] + [0.5] * 11, 2), (502, [2.0**19] + [0.25] * 11, 0)]
    want = plain(rows)
    assert all(abs(x) < 1 << 63 for row in want for x in row) and any(row[0] == 500 for row in want)
    assert made(rows, spark) == want
    wide = [(100, [1e20, 0.0], 1), (101, [1e20, 0.0], 1), (102, [5e19, 0.0], 2)]
    with pytest.raises(Exception, match="with vec_id 10[12]"):
        made(wide, spark)


def test_scores_below_zero_and_nothing(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [-0.5, 0.0], 0), (2, [-0.25, 0.0], 1), (3, [0.0, 1.0], 0), (4, [0.0, 2.0], 1), (5, [-0.3, 1.0], 2)]
    assert made(rows, spark) == plain(rows) and plain(rows)
    assert not made([], spark) and not made([(100, [1.0], 1)], spark)
    for x in (0, 5, -5, 10**199, -(10**199), 1 << 63, -(1 << 63)):
        assert hn.number(hn.sortable(x)) == x
    assert sorted([5, -5, 0, -(10**30), 10**30], key=hn.sortable) == [-(10**30), -5, 0, 5, 10**30]
    low = spark.createDataFrame([(hn.sortable(x), x) for x in (0, -1, 7, -(1 << 63), (1 << 63) - 1, -256)], "s string, x long")
    assert all(r.y == r.x for r in low.select("x", hn.long_score("s", "x").alias("y")).collect())


def test_bounds_hold_and_pass_leaves_over(monkeypatch):
    monkeypatch.setattr(hn.Tree.__init__, "__defaults__", (64,))
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 60, (20, 16))
    m = np.round(centres[rng.integers(0, 20, 4000)] + rng.normal(0, 6, (4000, 16)))
    forest = hn.Forest()
    forest.add(np.arange(4000), rng.integers(0, 3, 4000), m)
    visited = 0
    for q in m[:50]:
        query = hn.Query(forest, q)
        for at in range(len(query.leaf)):
            scores = hn.Query(forest, q).visit(at)[2]
            assert query.low[at] <= scores.min() and scores.max() <= query.high[at]
        query.nearest(5, lambda ids, labels, scores: labels >= 0)
        visited += len(query.scores)
    assert visited < 0.5 * 50 * len(query.leaf)
