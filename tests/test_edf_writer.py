"""The EDF sink: what is written is read back, and a failed job leaves nothing."""

import numpy as np
import pytest

from lanternfish.sources import edf, edf_writer


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, "EEG Fp1", "uV"), (1, "EEG O2", "uV")], "track long, label string, unit string")


def frame(spark, waves):
    return spark.createDataFrame([(r, k, i, float(x)) for (r, k), v in waves.items() for i, x in enumerate(v)], "recording string, track long, i long, v double").repartition(3)


def test_round_trip(spark, tmp_path, labels):
    """Two recordings in segments of three records; a signal that ends early and a last record that isn't full end in zeros."""
    rng = np.random.default_rng(1)
    waves = {("a", 0): rng.normal(0, 90, 1030), ("a", 1): rng.normal(0, 90, 400), ("b", 0): rng.normal(0, 5000, 100), ("b", 1): np.array([np.nan] + [1.0] * 99)}
    edf.register(spark)
    rows = edf_writer.records(frame(spark, waves), labels, 100.0, 1.0, segment=3)
    rows.write.format("edf").option("path", str(tmp_path)).mode("append").save()
    names = sorted(p.name for p in tmp_path.iterdir())
    assert names == ["a-00000.edf", "a-00001.edf", "a-00002.edf", "a-00003.edf", "b-00000.edf"]
    headers = {r.recording.rpartition("/")[2]: r for r in edf.recordings(spark, str(tmp_path)).collect()}
    assert [headers[n].record_count for n in names] == [3, 3, 3, 2, 1]
    own = edf.samples(spark.read.format("edf").option("bytes", 500).load(str(tmp_path)), edf.signals(spark, str(tmp_path))).collect()
    got = {}
    for r in own:
        name, _, segment = r.recording.rpartition("/")[2].removesuffix(".edf").partition("-")
        got[name, r.track, r.i + 300 * int(segment)] = r.v
    assert len(got) == 2 * 1100 + 2 * 100
    for (name, track), v in waves.items():
        full = np.zeros(1100 if name == "a" else 100)
        full[: len(v)] = np.nan_to_num(np.clip(v, -3200, 3200))
        assert np.abs(np.array([got[name, track, i] for i in range(len(full))]) - full).max() < 6400 / 65535


def test_overwrite_replaces_and_a_failed_job_leaves_nothing(spark, tmp_path, labels):
    edf.register(spark)
    write = lambda df, mode: df.write.format("edf").option("path", str(tmp_path)).mode(mode).save()
    write(edf_writer.records(frame(spark, {("a", 0): np.ones(50), ("a", 1): np.ones(50)}), labels, 50.0), "append")
    write(edf_writer.records(frame(spark, {("c", 0): np.ones(50), ("c", 1): np.ones(50)}), labels, 50.0), "overwrite")
    assert [p.name for p in tmp_path.iterdir()] == ["c-00000.edf"]
    # One recording is whole, the other lacks its first record: the job fails, and the whole one isn't left behind.
    good = edf_writer.records(frame(spark, {("d", 0): np.ones(100), ("d", 1): np.ones(100)}), labels, 50.0)
    bad = good.unionByName(good.where("record_index = 1").selectExpr("'e' as recording", *good.columns[1:])).repartition(2, "recording").sortWithinPartitions("recording", "record_index", "signal_index")
    with pytest.raises(Exception, match="record 0 of e is missing"):
        write(bad, "append")
    assert [p.name for p in tmp_path.iterdir()] == ["c-00000.edf"]
    gap = frame(spark, {("f", 0): np.ones(50)}).where("i <> 7")
    with pytest.raises(Exception, match="a record has a gap"):
        edf_writer.records(gap, labels, 50.0).collect()
