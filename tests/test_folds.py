"""Order-dependent rules against plain loops, montage cases and streams."""

import random

from lanternfish.operators import intervals as I
from lanternfish.operators import montage as G
from lanternfish.streaming import windows as R


def test_refractory_and_quota(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice("ab"), round(rng.random() * 5, 3), round(rng.random(), 2)) for k in range(200)]
    got = {(r.track, r.peak, r.score) for r in I.refractory(spark.createDataFrame(rows, "id long, track string, peak double, score double")).collect()}
    want = set()
    for name in "ab":
        kept = []
        for _, _, p, s in sorted((r for r in rows if r[1] == name), key=lambda r: (r[2], -r[3], r[0])):
            if not kept or p - kept[-1][0] >= 0.2:
                kept.append((p, s))
            elif s > kept[-1][1]:
                kept[-1] = (p, s)
        want |= {(name, *k) for k in kept}
    assert got == want
    events = [(k, t * 10, s, [name, "c"] if k % 3 == 0 else [name]) for k, name, t, s in rows]
    left = {r.id for r in I.quota(spark.createDataFrame(events, "id long, start double, confidence double, tracks array<string>")).collect()}
    used, count, keep = {}, {}, set()
    for k, start, _, tracks in sorted(events, key=lambda e: (-e[2], e[1], e[0])):
        b = int(start // 30)
        if count.get(b, 0) >= 8 or any(used.get((b, x), 0) >= 3 for x in tracks):
            continue
        count[b] = count.get(b, 0) + 1
        for x in tracks:
            used[b, x] = used.get((b, x), 0) + 1
        keep.add(k)
    assert left == keep


def test_montage_aliases_rates_and_missing(spark):
    c = spark.createDataFrame([(0, "EEG Fp1", "uV", 200.0), (1, "F7", "uV", 200.0), (2, "T7", "uV", 256.0), (3, "EOG LOC", "uV", 200.0), (4, "EOG ROC", "uV", 200.0), (5, "EKG", "uV", 200.0)], "idx long, label string, unit string, fs double")
    m = {r.id: r for r in G.pairs_montage(G.pair_table(spark, G.LONGITUDINAL), c, "banana").collect()}
    assert m["banana:Fp1-F7"].available and not m["banana:F7-T3"].available
    assert m["banana:F7-T3"].missing == ["matching sample rates"] and m["banana:T5-O1"].missing == ["T5", "O1"]
    assert [r.id for r in G.auxiliary(c).collect()] == ["aux:eog-l-r", "aux:ekg:5"]
    s = spark.createDataFrame([(k, i, v) for k, x in ((0, (10.0, 20.0, 30.0)), (1, (1.0, 2.0, 3.0))) for i, v in enumerate(x)], "track long, i long, v double")
    got = G.derived(s, G.pairs_montage(G.pair_table(spark, [("Fp1", "F7")]), c, "x"))
    assert sorted((r.i, r.v) for r in got.collect()) == [(0, 9.0), (1, 18.0), (2, 27.0)]


def test_stream_agrees_with_batch(spark, tmp_path):
    rng = random.Random(6)
    rows = sorted((round(rng.random() * 20, 3), rng.choice("ab"), round(rng.random(), 2)) for _ in range(100))
    src = str(tmp_path / "in")
    df = spark.createDataFrame([(b, a, c) for a, b, c in rows], "track string, peak double, score double")
    df.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = R.refractory(stream).writeStream.format("memory").queryName("kept").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.track, r.peak, r.score) for r in spark.sql("select * from kept").collect()}
    want = {(r.track, r.peak, r.score) for r in I.refractory(df.selectExpr("row_number() over (order by peak) id", "*").withColumn("id", __import__("pyspark").sql.functions.col("id").cast("long"))).collect()}
    # The last event of each track waits for what may still come.
    assert got < want and len(want - got) == 2


def test_windows_drop_late_rows(spark, tmp_path):
    for k, times in enumerate((("00:00:00", "00:00:01", "00:00:30"), ("00:00:02", "00:01:30"))):
        spark.createDataFrame([("a", f"2024-01-01 {x}", 1.0) for x in times], "track string, at string, v double").selectExpr("track", "cast(at as timestamp) ts", "v").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema("track string, ts timestamp, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = R.feature_windows(stream, "2 seconds", "10 seconds").writeStream.format("memory").queryName("wins").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.n for r in spark.sql("select n from wins order by start").collect()][:1] == [2]


def test_thinned_clusters_and_fields_are_what_a_walk_finds():
    """The detectors' choices among close peaks, on a grid where gaps are met exactly."""
    from lanternfish.operators import detectors as D

    for seed in range(60):
        rng = random.Random(seed)
        found = [{"type": rng.choice(["spike", "sharp"]), "track": rng.choice("abc"), "peak": rng.randrange(0, 900) / 200, "score": rng.choice([0.5, 0.6, 0.75]), "start": 0.0, "end": 1.0, "total": 9.0, "text": str(k)} for k in range(rng.randrange(0, 80))]
        kept = []
        for e in sorted(found, key=lambda e: (e["peak"], -e["score"])):
            free = not kept or e["peak"] - kept[-1]["peak"] >= 0.2
            if free or e["score"] > kept[-1]["score"]:
                kept = [*(kept if free else kept[:-1]), e]
        assert D.thinned(found) == kept
        runs = []
        for e in sorted(found, key=lambda e: (e["peak"], e["type"])):
            joins = runs and runs[-1][-1]["type"] == e["type"] and e["peak"] - runs[-1][-1]["peak"] <= 0.08 and e["track"] not in {m["track"] for m in runs[-1]}
            runs = [*runs[:-1], [*runs[-1], e]] if joins else [*runs, [e]]
        assert [g["text"].tolist() for _, g in D.clusters(found).groupby("cluster")] == [[e["text"] for e in r] for r in runs]
        assert len(D.cluster_events(found, {"a": 0, "b": 1})) <= len(runs)
