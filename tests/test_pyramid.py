"""Columns read from the pyramid against those of the samples themselves."""

import random

import pytest

from lanternfish.operators import pyramid
from lanternfish.operators.display import View


def direct(tracks, fs, view, pixels):
    out = {}
    for track, v in tracks.items():
        for p in range(pixels):
            a = max(0, int((view.start + p / pixels * view.seconds) * fs // 1))
            b = max(a + 1, int((view.start + (p + 1) / pixels * view.seconds) * fs // 1))
            own = v[a : min(b, len(v))]
            if own:
                low, high = min(own), max(own)
                out[track, p] = (len(own), a, own[0], a + len(own) - 1, own[-1], low, a + own.index(low), high, a + own.index(high))
    return out


@pytest.fixture(scope="module")
def tracks():
    rng = random.Random(4)
    return {t: [float(rng.randrange(-9, 10)) for _ in range(3000)] for t in ("a", "b")}


@pytest.fixture(scope="module")
def samples(spark, tracks):
    return spark.createDataFrame([(t, i, x) for t, v in tracks.items() for i, x in enumerate(v)], "track string, i long, v double").repartition(3).cache()


@pytest.mark.parametrize(("start", "seconds", "pixels", "base"), [(0.0, 15.0, 7, 16), (1.237, 9.1, 40, 4), (3.0, 0.05, 30, 16), (14.0, 4.0, 50, 8), (0.0, 15.0, 3000, 2)])
def test_columns(spark, tracks, samples, start, seconds, pixels, base):
    """Whole tracks, odd edges, pixels narrower than a sample, a view past the end, levels of a few samples."""
    view = View(start, seconds, 15.0)
    built = pyramid.build(samples, base)
    cols = pyramid.columns(built, samples, 200.0, view, pixels, 3000, base)
    got = {(r.track, r.pixel): tuple(r[c] for c in pyramid.STATE) for r in cols.collect()}
    assert got == direct(tracks, 200.0, view, pixels)
    checked = pyramid.covered(samples, cols, 200.0, view, pixels, 3000).collect()
    assert len(checked) == 2 and all(r.covers for r in checked)
    wrong = pyramid.covered(samples, cols.withColumn("high", cols.low), 200.0, view, pixels, 3000).collect()
    assert not any(r.covers for r in wrong) or pixels >= seconds * 200


def test_levels(spark, tracks, samples):
    """Each level's bins hold the extremes of their samples; the top one is a single bin."""
    rows = pyramid.build(samples, 16).collect()
    top = max(r.level for r in rows)
    assert [(r.n, r.bin) for r in rows if r.level == top] == [(3000, 0)] * 2 and top == 8
    for r in rows:
        size = 16 << r.level
        own = tracks[r.track][r.bin * size : (r.bin + 1) * size]
        assert (r.n, r.low, r.high, r.first, r.last) == (len(own), min(own), max(own), own[0], own[-1])
    assert pyramid.build(samples.limit(0)).count() == 0


def test_cover_is_small_and_whole():
    rng = random.Random(5)
    for _ in range(300):
        a = rng.randrange(100_000)
        b, base = a + rng.randrange(1, 100_000), rng.choice([2, 16])
        nodes, runs = pyramid.cover(a, b, base)
        held = sorted([(n * (base << k), (n + 1) * (base << k)) for k, n in nodes] + runs)
        assert held[0][0] == a and held[-1][1] == b and all(x[1] == y[0] for x, y in zip(held, held[1:]))
        assert len(nodes) <= 2 * 17 and sum(y - x for x, y in runs) < 2 * base


def test_geometry_and_points(spark):
    cols = spark.createDataFrame([("a", 2, 5, 10, 1.0, 14, 3.0, 0.0, 13, 9.0, 11), ("a", 3, 1, 15, 4.0, 15, 4.0, 4.0, 15, 4.0, 15)], "track string, pixel int, n long, start long, first double, stop long, last double, low double, low_at long, high double, high_at long")
    shaped = pyramid.geometry(cols, 10, 100.0)
    a, b = shaped.orderBy("pixel").collect()
    assert (a.x, a.x1, a.low_x, a.high_x) == (20.0, 30.0, 27.5, 22.5) and (a.low_from, a.high_from) == (2.5, 1.5) and b.low_from is None and b.high_from is None
    points = [(r.pixel, r.x, r.value) for r in pyramid.ordered_points(shaped).orderBy("pixel", "k").collect()]
    assert points == [(2, 20.0, 1.0), (2, 22.5, 9.0), (2, 27.5, 0.0), (2, 30.0, 3.0), (3, 30.0, 4.0), (3, 40.0, 4.0)]


@pytest.mark.parametrize("lengths", [{0: 29, 1: 3, None: 5}, {2: 57, 3: 57}, {4: 4}])
def test_cover_of_whole_recordings(spark, tmp_path, lengths):
    """29 or 57 vectors of 64 samples, divided by 200 and multiplied again, give one sample less; a track may have no label."""
    import duckdb

    from lanternfish.catalog import ORACLE, QUERIES

    rows = [(label, n) for label, n in lengths.items() for _ in range(n)]
    made = f"select k as vec_id, cast(labels[k + 1] as int) as label, list_transform(range(0, 64), lambda j: cast((j * 7 + k * 5) % 23 - 11 as float)) as embedding from (select {[label for label, _ in rows]!r} as labels), range(0, {len(rows)}) r(k)".replace("None", "null")
    con = duckdb.connect()
    con.sql(f"copy ({made}) to '{tmp_path}/embeddings.parquet' (format parquet)")
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    for name in ("columns_cover", "viewport_columns"):
        got, want = QUERIES[name](spark, str(tmp_path)), con.sql(ORACLE[name])
        order = lambda rows: sorted(rows, key=str)
        assert order(tuple(r) for r in got.select(*want.columns).collect()) == order(want.fetchall())


def test_whole_view_ends_after_the_last_sample():
    short = 0
    for fs in (200.0, 256.0, 99.7):
        for n in (*range(0, 5000), 13_298 * 64, 2**40 + 9):
            view = View.whole(n, fs)
            assert int(view.seconds * fs // 1) == n and view.total == view.seconds
            short += int(n / fs * fs // 1) < n
    assert short > 100


@pytest.mark.parametrize("pixels", [7, 60, 3000])
def test_samples_at_one_place_are_all_seen(spark, pixels):
    """Repeated places, and pixels narrower than a sample: each sample counts once, a missing column is told."""
    twice = spark.createDataFrame([("a", i, float(i % 7)) for i in range(400)] + [("a", i, 3.0) for i in range(0, 400, 4)] + [(None, i, 1.0) for i in range(50)], "track string, i long, v double")
    view = View.whole(400, 200.0)
    cols = pyramid.columns(pyramid.build(twice), twice, 200.0, view, pixels, 400).cache()
    checked = lambda cols: {r.track: (r.seen, r.outside, r.covers) for r in pyramid.covered(twice, cols, 200.0, view, pixels, 400).collect()}
    assert checked(cols) == {"a": (500, 0, True), None: (50, 0, True)}
    few = checked(cols.where("track is null or start < 300"))
    assert few[None] == (50, 0, True) and not few["a"][2] and few["a"][0] < 500


def test_cover_does_not_hang_on_the_order_of_vectors_of_one_id(spark, tmp_path, monkeypatch):
    """Samples and columns are read apart: in a cluster rows of one vec_id come in another order each time."""
    from lanternfish import catalog_chunks
    from lanternfish.operators import pyramid as P

    rows = [(k // 10, k % 2, [float((k * 13 + j * 7) % 101) for j in range(8)]) for k in range(300)]
    for name, order in (("a", rows), ("b", rows[::-1])):
        spark.createDataFrame(order, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
    asked, signal = [], catalog_chunks.V.signal
    monkeypatch.setattr(catalog_chunks.V, "signal", lambda spark, sf_dir, *ties: asked.append(ties) or signal(spark, sf_dir, *ties))
    monkeypatch.setattr(catalog_chunks.pyramid, "covered", lambda s, *more, covered=P.covered: covered(signal(spark, f"{tmp_path}/b", *asked[0]), *more))
    got = catalog_chunks.columns_cover(spark, f"{tmp_path}/a").collect()
    assert sorted((r.track, r.seen, r.outside, r.covers) for r in got) == [(0, 1200, 0, True), (1, 1200, 0, True)]
