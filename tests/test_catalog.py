"""Every registered query of the package's own operators against its SQL twin, on the smallest tables."""

import math

import duckdb
import pytest

from lanternfish.catalog import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def told(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return ""
    return f"{x:.5f}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, sf, db, name):
    got, want = QUERIES[name](spark, sf).toPandas(), db.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    as_rows = lambda d: sorted(map(tuple, d[columns].map(told).values))
    assert as_rows(got) == as_rows(want)


@pytest.mark.parametrize("name", ["iir_zero_phase", "screening_evaluations", "deterministic_annotations", "refractory_fold"])
def test_queries_without_sql_give_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_render_pcm_sounds_every_sample_of_every_track(spark, sf):
    import numpy as np

    from lanternfish.operators import mapping as M
    from lanternfish.operators import windows as W
    from lanternfish.plans import views as V

    n = {r["track"]: r["n"] for r in V.signal(spark, sf).groupBy("track").count().withColumnRenamed("count", "n").collect()}
    got = QUERIES["render_pcm"](spark, sf).toPandas()
    assert len(got) == max(n.values()) * 8000 // 200 == len(got[["region", "i"]].drop_duplicates())
    assert got[["left", "right"]].abs().to_numpy().max() <= 0.89 + 1e-9
    # Region by region and track by track it is what one region's rendering gives.
    s = spark.createDataFrame([(t, i, float((i * (t + 3)) % 17 - 8) * (1 + i // 200)) for t in range(3) for i in range(500 - 90 * t)], "track long, i long, v double")
    at = {"start": W.F.col("sample_start") / 200.0, "end": W.F.col("sample_end") / 200.0}
    made = M.rendered_regions(M.mapped(W.region_features(s, 200.0, 50, 1.0)).withColumns(at), 1000, 1.0).toPandas()
    for k in range(3):
        own = made[made.region == k].sort_values("i")
        f = W.features(s, 200.0, 50, float(k), float(k + 1))
        want = M.rendered(M.mapped(f).withColumns(at), 1000, float(k), float(k + 1)).toPandas().sort_values("i")
        assert len(own) and own.i.tolist() == want.i.tolist() and np.allclose(own[["left", "right"]], want[["left", "right"]])


def test_regions_sound_in_many_tasks_that_hold_one_region(spark):
    """Few events make much sound: adaptive execution must not join them into one task, nor a task sort or hash samples."""
    from pyspark.sql import functions as F

    from lanternfish.operators import mapping as M

    tone = lambda region, start, hz, amplitude=0.2: (region, region + start, region + start + 0.5, hz, amplitude, 0.5, "soft-sine")
    rows = [tone(r, s / 4, 200.0 + r) for r in range(40) for s in range(3)] + [tone(40, 0.0, None), tone(40, 0.25, 300.0, 5.0)]
    events = spark.createDataFrame(rows, "region long, start double, end double, hz double, amplitude double, pan double, wave string").coalesce(1)
    made = M.rendered_regions(events, 1000, 1.0)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan and "Window" not in plan
    assert made.groupBy(F.spark_partition_id()).count().count() > 1
    got = made.toPandas()
    assert got.groupby("region").i.count().tolist() == [1000] * 40 + [750]
    last = got[got.region == 40].sort_values("i")
    # A tone without pitch holds its time, but has no sound of its own; the loud one is brought under the ceiling.
    assert last.left.isna().tolist() == [i < 250 for i in last.i] and abs(last[["left", "right"]].abs().max().max() - 0.89) < 1e-9
    one = M.rendered(events.where("region = 40"), 1000, 40.0, 41.0).toPandas().sort_values("i")
    assert (last.i.tolist(), last.left.isna().tolist()) == (one.i.tolist(), one.left.isna().tolist()) and abs(last.left.to_numpy() - one.left.to_numpy())[250:].max() < 1e-12
