"""Registered queries over the test tables and the SQL that each must agree with.

A query is an operator applied to a view of a whole table; its SQL is written on
its own for DuckDB. Doubles are rounded to six digits on both sides, as engines
add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanternfish.functions import labels as L
from lanternfish.functions import scalars as S
from lanternfish.operators import aggregates as A
from lanternfish.operators import intervals as I
from lanternfish.operators import mapping as M
from lanternfish.operators import montage as G
from lanternfish.operators import windows as W
from lanternfish.plans import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Registers a query under its function's name, with SQL after the named views."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = ("with " + ",\n".join(V.SQL[v] for v in views) + "\n" if views else "") + sql
        return fn

    return add


def r6(*names: str):
    """The named columns rounded; adding zero makes -0 a plain 0."""
    return {n: F.round(F.col(n), 6) + F.lit(0.0) for n in names}


def q6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 as {n.split('.')[-1]}" for n in names)


MEASURES_SQL = """, k as (
  select track, i, v, cast({s} as double) as ctx, i // greatest(8, cast(floor({s} * 200 + 0.5) as bigint)) as win from {view}
), c as (
  select track, ctx, win, count(*) as n, median(v) as median, avg(v) as mean, quantile_cont(v, 0.05) as p05, quantile_cont(v, 0.95) as p95, sqrt(avg(v * v)) as rms
  from k group by all having count(*) >= 8
), d as (
  select k.track, k.ctx, k.win, greatest(1e-12, median(abs(v - median)) * 1.4826) as scale from k join c using (track, ctx, win) group by all
), t as (
  select k.*, scale, abs(v - lag(v) over (partition by k.track, k.ctx, k.win order by i)) as step from k join d using (track, ctx, win)
), u as (
  select *, sum(case when step <= greatest(scale * 0.02, 1e-9) then 0 else 1 end) over (partition by track, ctx, win order by i) as island from t
), w as (
  select track, ctx, win, island, count(*) as run, sum(case when step > greatest(scale * 8, 1e-9) then 1 else 0 end) as jumps from u group by all
), f as (
  select track, ctx, win, max(run) as flat_run, sum(jumps) as jumps from w group by all
), m as (
  select track, ctx, win, n, mean, median, scale, p05, p95, rms, p95 - p05 as peak_to_peak, cast(jumps as double) / greatest(1, n - 1) as jump_ratio, flat_run::double / n as flat_ratio,
    case when greatest(0, p95) < 1e-9 and greatest(0, -p05) < 1e-9 then 'unknown' when greatest(0, p95) > greatest(0, -p05) * 1.25 then 'positive'
      when greatest(0, -p05) > greatest(0, p95) * 1.25 then 'negative' else 'mixed' end as polarity
  from c join d using (track, ctx, win) join f using (track, ctx, win)
)"""
REPRESENT_SQL = """, rep as (
  select track, ctx, count(*) as windows, cast(floor(avg(n) + 0.5) as bigint) as n, median(median) as median, median(scale) as scale, median(p05) as p05, median(p95) as p95, median(rms) as rms,
    median(peak_to_peak) as peak_to_peak, median(jump_ratio) as jump_ratio, median(flat_ratio) as flat_ratio, arg_min(polarity, win) as polarity
  from m group by track, ctx
), co as (select median(scale) as cohort_scale, median(rms) as cohort_rms, median(peak_to_peak) as cohort_peak from rep
), fl as (
  select *, peak_to_peak / greatest(cohort_peak, 1e-9) as peak_ratio, peak_to_peak < 10 and rms < 5 as suppressed,
    flat_ratio >= 0.95 or 1 - jump_ratio < 0.5 as disconnected from rep, co
)"""
FLAGS = ("median", "scale", "rms", "peak_to_peak", "jump_ratio", "flat_ratio", "peak_ratio")
FLAGS_SQL = f"select track, windows, n, polarity, {q6(*FLAGS)}, suppressed, disconnected, peak_ratio >= 4 as outlying from fl"


def screen(samples: DataFrame) -> DataFrame:
    rep = W.cohort_flags(W.representative(W.measures(W.contexts(samples, V.FS, (2.0,)))))
    return rep.select("track", "windows", "n", "polarity", *FLAGS, "suppressed", "disconnected", "outlying").withColumns(r6(*FLAGS))


@query(MEASURES_SQL.format(s=2, view="signal") + REPRESENT_SQL + FLAGS_SQL, "signal")
def window_screen(spark, sf_dir):
    return screen(V.signal(spark, sf_dir))


@query(MEASURES_SQL.format(s=2, view="event_signal") + REPRESENT_SQL + FLAGS_SQL, "event_signal")
def window_screen_events(spark, sf_dir):
    return screen(V.event_signal(spark, sf_dir))


@query(MEASURES_SQL.format(s=10, view="event_signal") + f"select track, win, n, polarity, {q6('mean', 'median', 'scale', 'p05', 'p95', 'rms', 'jump_ratio', 'flat_ratio')} from m", "event_signal")
def window_measures(spark, sf_dir):
    names = ("mean", "median", "scale", "p05", "p95", "rms", "jump_ratio", "flat_ratio")
    made = W.measures(W.contexts(V.event_signal(spark, sf_dir), V.FS, (10.0,)))
    return made.select("track", "win", "n", "polarity", *names).withColumns(r6(*names))


CALIBRATE = "select l_orderkey, l_linenumber, round((((cast(l_quantity as double) - (-32768)) / 65535) * 6400 - 3200) * (case l_returnflag when 'A' then 1e6 when 'N' then 1e3 else 1.0 end), 6) + 0.0 as v from lineitem"


@query(CALIBRATE)
def calibrate_affine(spark, sf_dir):
    from lanternfish.sources.edf import physical

    t = V.table(spark, sf_dir, "lineitem")
    scale = F.when(F.col("l_returnflag") == "A", 1e6).when(F.col("l_returnflag") == "N", 1e3).otherwise(1.0)
    v = physical(F.col("l_quantity").cast("double"), F.lit(-32768), F.lit(32767), F.lit(-3200.0), F.lit(3200.0), scale)
    return t.select("l_orderkey", "l_linenumber", v.alias("v")).withColumns(r6("v"))


LABELS = ("EEG Fp1-REF", "EEG FP1-LE", "EEG T3", "EEG T5-REF", "T6", "FZ", "F4-REF", "Cz", "EKG", "ECG 1", "EOG LOC", "PG1", "E2", "EMG Chin", "X1", "X5", "DC3", "EEG Annotations", "FCZ", "A1", "T1", "Resp", " eeg  c3 - a2", "E")


@query(
    """select label, case key when 'FP1' then 'Fp1' else canonical end as canonical, laterality, kind, pan from (values """
    + ", ".join(
        f"('{a}', '{b.upper()}', '{b}', '{c}', '{d}', cast({ {'left': -1, 'right': 1}.get(c, 0) } as integer))"
        for a, b, c, d in (
            ("EEG Fp1-REF", "Fp1", "left", "eeg"), ("EEG FP1-LE", "Fp1", "left", "eeg"), ("EEG T3", "T7", "left", "eeg"), ("EEG T5-REF", "P7", "left", "eeg"), ("T6", "P8", "right", "eeg"), ("FZ", "Fz", "midline", "eeg"),
            ("F4-REF", "F4", "right", "eeg"), ("Cz", "Cz", "midline", "eeg"), ("EKG", "EKG", "unknown", "ekg"), ("ECG 1", "1", "left", "ekg"), ("EOG LOC", "LOC", "unknown", "eog"), ("PG1", "PG1", "left", "eog"), ("E2", "E2", "right", "eog"),
            ("EMG Chin", "CHIN", "unknown", "emg"), ("X1", "X1", "left", "ekg"), ("X5", "X5", "left", "extra"), ("DC3", "DC3", "left", "dc"), ("EEG Annotations", "ANNOTATIONS", "unknown", "other"), ("FCZ", "Fz", "midline", "eeg"), ("A1", "A1", "left", "eeg"),
            ("T1", "FT9", "left", "eeg"), ("Resp", "RESP", "unknown", "extra"), (" eeg  c3 - a2", "C3-A2", "right", "extra"), ("E", "E", "unknown", "other"),
        )
    )
    + ") t(label, key, canonical, laterality, kind, pan)"
)
def label_rules(spark, sf_dir):
    t = spark.createDataFrame([(x,) for x in LABELS], "label string")
    made = G.described(t.withColumn("unit", F.lit("uV")))
    return made.select("label", "canonical", "laterality", "kind", L.pan(F.col("laterality")).alias("pan"))


@query(
    """, p as (select c_custkey, case c_mktsegment when 'BUILDING' then 'EEG ' when 'MACHINERY' then 'eog ' else '' end || c_name || case when c_nationkey % 2 = 0 then '-REF' else '-LE' end as raw from customer)
select c_custkey, upper(replace(c_name, ' ', '')) as name, case when regexp_extract(upper(c_name), '(\\d+)$', 1) = '' then 'unknown' when cast(right(c_name, 1) as integer) % 2 = 1 then 'left' else 'right' end as side from p join customer using (c_custkey)""".replace(", p as", "with p as", 1)
)
def label_canonical(spark, sf_dir):
    t = V.table(spark, sf_dir, "customer")
    prefix = F.when(F.col("c_mktsegment") == "BUILDING", "EEG ").when(F.col("c_mktsegment") == "MACHINERY", "eog ").otherwise("")
    raw = F.concat(prefix, "c_name", F.when(F.col("c_nationkey") % 2 == 0, "-REF").otherwise("-LE"))
    return t.select("c_custkey", L.canonical(raw).alias("name"), L.laterality(raw).alias("side"))


PAIR_SQL = """, sig as (select track, i, v from signal),
p as (select * from (values {pairs}) t(ord, a, b)),
n as (select idx, case label when 'EKG' then 'EKG' else regexp_extract(label, 'EEG (.*)-REF', 1) end as name from channels)
"""


def _pairs_sql(pairs) -> str:
    return ", ".join(f"(cast({k} as bigint), '{a}', '{b}')" for k, (a, b) in enumerate(pairs))


@query(
    PAIR_SQL.format(pairs=_pairs_sql(G.LONGITUDINAL))
    + """select ord, 'banana:' || a || '-' || b as id, coalesce(x.idx, -1) as source_a, coalesce(y.idx, -1) as source_b, x.idx is not null and y.idx is not null as available,
  concat_ws(',', case when x.idx is null then a end, case when y.idx is null then b end) as missing
from p left join n x on x.name = a left join n y on y.name = b""",
    "signal",
    "channels",
)
def montage_missing(spark, sf_dir):
    m = G.pairs_montage(G.pair_table(spark, G.LONGITUDINAL), V.channels(spark), "banana")
    return m.select("ord", "id", "source_a", "source_b", "available", F.array_join("missing", ",").alias("missing"))


@query(
    PAIR_SQL.format(pairs=_pairs_sql(G.LONGITUDINAL))
    + """select 'banana:' || a || '-' || b as track, s.i, round(cast(cast(s.v - t.v as float) as double), 6) + 0.0 as v
from p join n x on x.name = a join n y on y.name = b join sig s on s.track = x.idx join sig t on t.track = y.idx and t.i = s.i""",
    "signal",
    "channels",
)
def montage_bipolar(spark, sf_dir):
    m = G.pairs_montage(G.pair_table(spark, G.LONGITUDINAL), V.channels(spark), "banana")
    return G.derived(V.signal(spark, sf_dir), m).withColumns(r6("v"))


@query("select track, count(*) as n, round(avg(v), 6) + 0.0 as dc, round(sum(v - m), 3) + 0.0 as rest from (select *, avg(v) over (partition by track) as m from signal) group by track", "signal")
def dc_offset(spark, sf_dir):
    s = V.signal(spark, sf_dir)
    rest = A.without_dc(s).groupBy("track").agg((F.round(F.sum("v"), 3) + F.lit(0.0)).alias("rest"))
    return s.groupBy("track").agg(F.count("*").alias("n"), F.avg("v").alias("dc")).withColumns(r6("dc")).join(rest, "track")


@query("select track, round(coalesce(nullif(case when list_sort(list(abs(v)))[cast(floor(0.97 * (count(*) - 1)) as bigint) + 1] > 1e-12 then list_sort(list(abs(v)))[cast(floor(0.97 * (count(*) - 1)) as bigint) + 1] end, 0), 1), 6) + 0.0 as p97, round(list_sort(list(v))[count(*) // 2 + 1], 6) + 0.0 as upper_median from event_signal group by track", "event_signal")
def percentile_abs_floor(spark, sf_dir):
    return V.event_signal(spark, sf_dir).groupBy("track").agg(A.percentile_abs(F.col("v"), 0.97).alias("p97"), A.upper_median(F.col("v")).alias("upper_median")).withColumns(r6("p97", "upper_median"))


@query(
    """, k as (select track, i // 6000 as bucket, i % 6000 as pos, v from event_signal), n as (select track, bucket, max(pos) + 1 as cnt from k group by all),
p as (select k.track, k.bucket, v from k join n using (track, bucket) where cnt <= 4096 or floor(floor(pos * 4095.0 / greatest(cnt - 1, 1) + 0.5) * (cnt - 1) / 4095.0 + 0.5) = pos),
c as (select track, bucket, count(*) as n, median(v) as center from p group by all)
select track, bucket, n, round(center, 6) + 0.0 as center, round(median(abs(v - center)) * 1.4826, 6) + 0.0 as scale from p join c using (track, bucket) where n >= 4 group by track, bucket, n, center having median(abs(v - center)) * 1.4826 > 1e-12""",
    "event_signal",
)
def robust_baseline_30s(spark, sf_dir):
    return W.robust_baseline(V.event_signal(spark, sf_dir), 6000).select("track", "bucket", "n", "center", "scale").withColumns(r6("center", "scale"))


@query("""select track, bin, round(sum(case when p <= 0 and v > 0 then 1 else 0 end) * 200.0 / count(*), 6) + 0.0 as hz from (select *, i // 100 as bin, lag(v) over (partition by track, i // 100 order by i) as p from signal) group by track, bin""", "signal")
def zero_cross_hz(spark, sf_dir):
    return W.zero_cross_hz(V.signal(spark, sf_dir), V.FS, 100).withColumns(r6("hz"))


@query("select track, i, round(avg(v) over (partition by track order by i rows between 3 preceding and 3 following), 6) + 0.0 as smooth from event_signal", "event_signal")
def smooth_centered(spark, sf_dir):
    return W.moving_mean(V.event_signal(spark, sf_dir), 3).select("track", "i", "smooth").withColumns(r6("smooth"))


@query("select track, i // 50 as bin, count(*) as n, round(arg_min(v, i), 6) + 0.0 as first, round(arg_max(v, i), 6) + 0.0 as last, round(min(v), 6) + 0.0 as low, round(max(v), 6) + 0.0 as high, arg_min(i, (v, i)) as low_at, arg_min(i, (-v, i)) as high_at from event_signal group by all", "event_signal")
def envelope_minmax(spark, sf_dir):
    return W.envelope(V.event_signal(spark, sf_dir), 50).withColumns(r6("first", "last", "low", "high"))


FEATURES_SQL = """, k as (select track, i // 6000 as region, i % 6000 // 50 as win, i, v, abs(v - lag(v) over (partition by track, i // 50 order by i)) as step from signal),
f as (select track, region, win, min(i) as sample_start, max(i) + 1 as sample_end, avg(v) as mean, sqrt(avg(v * v)) as rms, sum(coalesce(step, 0)) as line_length, max(abs(v)) as peak from k group by all),
g as (select *, greatest(max(peak) over (partition by track, region), 1e-12) as scale from f), e as (select *, least(1, greatest(0, rms / scale)) as size, least(1, greatest(-1, mean / scale)) as signed from g)
"""


@query(FEATURES_SQL + f"select track, region, win as \"window\", sample_start, sample_end, {q6('mean', 'rms', 'line_length', 'scale')} from g", "signal")
def feature_windows(spark, sf_dir):
    return W.region_features(V.signal(spark, sf_dir), V.FS, 50).withColumns(r6("mean", "rms", "line_length", "scale"))


@query(FEATURES_SQL + "select track, region, win as \"window\", round(420.0 * pow(2.0, signed), 6) as hz, round(0.07 + size * 0.23, 6) as amplitude, 'sine' as wave from e", "signal")
def contour_map(spark, sf_dir):
    made = M.styled(M.mapped(W.region_features(V.signal(spark, sf_dir), V.FS, 50)), "plain-v1")
    return made.select("track", "region", "window", "hz", "amplitude", "wave").withColumns(r6("hz", "amplitude"))


@query(FEATURES_SQL + "select track, region, win as \"window\", round(130 + 520 * size, 6) as hz, round((0.05 + size * 0.28) * 0.72, 6) as amplitude, 'sine' as wave from e", "signal")
def pulse_map_soft(spark, sf_dir):
    made = M.styled(M.mapped(W.region_features(V.signal(spark, sf_dir), V.FS, 50), "rms-pulse-v1"), "soft-v1")
    return made.select("track", "region", "window", "hz", "amplitude", "wave").withColumns(r6("hz", "amplitude"))


@query("""with m as (select p_partkey, 69.0::double + 12.0::double * log2(greatest(p_retailprice, 1) / 440.0::double) as midi from part), s as (select o * 12 + d as c from (select unnest(range(-2, 13)) as o), (select unnest([0, 2, 4, 7, 9]) as d))
select p_partkey, round(440.0::double * pow(2.0::double, (arg_min(c, (abs(c - midi), c)) - 69) / 12.0::double), 6) as hz from m, s group by p_partkey""")
def pentatonic_snap(spark, sf_dir):
    return V.table(spark, sf_dir, "part").select("p_partkey", S.pentatonic_hz(F.col("p_retailprice")).alias("hz")).withColumns(r6("hz"))


@query(
    """, b as (select track, i // 2560 as epoch, min(v) as low, max(v) as high from event_signal group by all),
p as (select e.track, e.i, epoch, case when high - low > 1e-12 then 1 + 39 * (v - low) / (high - low) else 20.5 end as x from event_signal e join b on e.track = b.track and e.i // 2560 = epoch where (e.i % 2560) % 20 = 0),
s as (select c from (select unnest(range(0, 41)) as c) where c % 12 in (0, 2, 4, 7, 9))
select track, i, epoch, cast(arg_min(c, (abs(c - x), c)) as integer) as offset_, cast(85 + (((i + 1) * 2654435761) & 4294967295) % 43 as bigint) as velocity from p, s group by track, i, epoch""",
    "event_signal",
)
def loui_epoch_events(spark, sf_dir):
    return M.scale_events(V.event_signal(spark, sf_dir)).select("track", "i", "epoch", F.col("offset").cast("int").alias("offset_"), F.col("velocity").cast("long").alias("velocity"))


DFT_SQL = """, c as (select track, samples, list_avg(samples) as m from vectors), b as (select unnest(range(1, 33)) as k), j as (select unnest(range(0, 64)) as j),
x as (select track, j, samples[j + 1] - m as d from c, j),
p as (select track, k, (pow(sum(d * cos(2 * pi() * k * j / 64)), 2) + pow(sum(d * sin(2 * pi() * k * j / 64)), 2)) / 4096 as w from x, b group by track, k)
select track, round(sum(case when k >= 1 and k < 4 then w else 0 end), 6) + 0.0 as delta, round(sum(case when k >= 4 and k < 8 then w else 0 end), 6) + 0.0 as theta, round(sum(case when k >= 8 and k < 13 then w else 0 end), 6) + 0.0 as alpha,
  round(sum(case when k >= 13 and k < 30 then w else 0 end), 6) + 0.0 as beta, round(sum(case when k >= 30 and k < 32 then w else 0 end), 6) + 0.0 as gamma from p group by track"""


@query(DFT_SQL, "vectors")
def band_power_dft(spark, sf_dir):
    from pyspark.sql import types as T

    from lanternfish.operators.spectral import BANDS, band_powers
    from lanternfish.operators.tracks import rows_of

    schema = T.StructType([T.StructField("track", T.LongType())] + [T.StructField(b, T.DoubleType()) for b in BANDS])
    made = rows_of(V.vectors(spark, sf_dir), lambda r: [{"track": r["track"], **band_powers(r["samples"], 64.0)}], schema)
    return made.withColumns(r6(*BANDS))


@query("select track, i, round(v - avg(v) over (partition by i), 6) + 0.0 as v from signal qualify count(*) over (partition by i) >= 2 union all select track, i, round(v, 6) + 0.0 from signal qualify count(*) over (partition by i) < 2", "signal")
def common_average(spark, sf_dir):
    return G.common_average(V.signal(spark, sf_dir)).withColumns(r6("v"))


@query(
    """, r as (select i, v as r from signal where track = 9), f as (select track, covar_pop(v, r) as c, var_pop(r) as q, avg(r) as m from signal join r using (i) where track <> 9 group by track)
select s.track, s.i, round(s.v - coalesce(case when q > 1e-12 then c / q else 0 end * (r - m), 0), 6) + 0.0 as v from signal s join f using (track) left join r using (i) where s.track <> 9""",
    "signal",
)
def regress_one_ref(spark, sf_dir):
    s = V.signal(spark, sf_dir)
    return G.regressed(s.where("track <> 9"), s.where("track = 9").select("i", F.col("v").alias("r"))).withColumns(r6("v"))


@query(
    """, e as (select * from annotations where type in ('view', 'click')), a as (select * from annotations where type = 'error' or type = 'purchase')
select id, track, type from e where not exists (select 1 from a where a.track = e.track and e.start < a."end" and a.start < e."end")""",
    "annotations",
)
def veto_overlap(spark, sf_dir):
    a = V.annotations(spark, sf_dir)
    # Half-minute buckets by default; events here are minutes apart and seconds long.
    return I.veto(a.where("type in ('view', 'click')"), a.where("type in ('error', 'purchase')")).select("id", "track", "type")


@query("""select id, type, track from annotations qualify row_number() over (partition by type, track, floor(confidence * 20) order by start, id) = 1""", "annotations")
def dedupe_first(spark, sf_dir):
    a = V.annotations(spark, sf_dir).withColumn("near", F.floor(F.col("confidence") * 20))
    # Events here never coincide to the millisecond; the key is coarsened through start and end.
    a = a.withColumns({"s": F.col("start"), "start": F.col("near") / 1000, "end": F.col("near") / 1000})
    return I.first_of_key(a, "s", "id").select("id", "type", "track")


@query(
    """, a as (select *, floor(start / 864000) as bucket from annotations), b as (select * from a qualify row_number() over (partition by type, bucket order by confidence desc, start, id) <= 3),
c as (select * from b qualify row_number() over (partition by type order by confidence desc, start, id) <= 40)
select id, type, cast(bucket as bigint) as bucket from c order by confidence desc, start, id limit 120""",
    "annotations",
)
def bucket_topk(spark, sf_dir):
    return I.top_of_buckets(V.annotations(spark, sf_dir), 3, 40, 120, 864000).select("id", "type", "bucket")


@query("""select id, type, source from annotations where contains(lower(concat_ws(' ', type, text, cast(track as varchar))), 'k": 7') and source <> 'auto'""", "annotations")
def event_search(spark, sf_dir):
    return I.search(V.annotations(spark, sf_dir), ' K": 7 ', show_auto=False).select("id", "type", "source")


@query("""select type, count(g) as n, round(median(g), 6) + 0.0 as interval, round(case when median(g) > 0 then stddev_pop(g) / median(g) end, 6) + 0.0 as cv from (select type, start - lag(start) over (partition by type order by start, id) as g from annotations) group by type""", "annotations")
def interval_stats_cv(spark, sf_dir):
    return A.interval_stats(V.annotations(spark, sf_dir).withColumn("t", F.col("start")), "type").withColumns(r6("interval", "cv"))


@query("""select track, id, coalesce(lead(id) over w, first_value(id) over e) as next_id, coalesce(lag(id) over w, last_value(id) over e) as previous_id from annotations
window w as (partition by track order by start, id), e as (partition by track order by start, id rows between unbounded preceding and unbounded following)""", "annotations")
def next_event(spark, sf_dir):
    return I.neighbours(V.annotations(spark, sf_dir))


SIDES_SQL = """, p as (select * from (values (0, 1), (2, 3), (4, 5), (6, 7)) t(l, r)), w as (select track, avg(v * v) as power, avg(abs(v)) as slow from signal group by track)
"""


@query(SIDES_SQL + "select cast(l as bigint) as track, round(a.slow / greatest(b.slow, 0.02), 6) as ratio from p join w a on a.track = l join w b on b.track = r union all select cast(r as bigint), round(b.slow / greatest(a.slow, 0.02), 6) from p join w a on a.track = l join w b on b.track = r", "signal")
def homologous_ratio(spark, sf_dir):
    w = V.signal(spark, sf_dir).groupBy("track").agg(F.avg(F.abs("v")).alias("slow"))
    return beside(spark, w).select("track", S.safe_ratio(F.col("slow"), F.greatest(F.col("other"), F.lit(0.02))).alias("ratio")).withColumns(r6("ratio"))


def beside(spark, measures: DataFrame) -> DataFrame:
    """Each track's measure with that of its counterpart on the other side."""
    pairs = spark.createDataFrame([(a, b) for a, b in ((0, 1), (2, 3), (4, 5), (6, 7))], "l long, r long")
    both = pairs.select(F.col("l").alias("track"), F.col("r").alias("mate")).union(pairs.select("r", "l"))
    other = measures.select(F.col("track").alias("mate"), F.col("slow").alias("other"))
    return measures.join(F.broadcast(both), "track").join(other, "mate")


@query(SIDES_SQL + "select cast(l as bigint) as l, cast(r as bigint) as r, round(greatest(a.power, b.power) / least(a.power, b.power), 6) as ratio, a.power > b.power as left_greater from p join w a on a.track = l join w b on b.track = r", "signal")
def asymmetry(spark, sf_dir):
    w = V.signal(spark, sf_dir).groupBy("track").agg(F.avg(F.col("v") * F.col("v")).alias("power"))
    pairs = spark.createDataFrame([(0, 1), (2, 3), (4, 5), (6, 7)], "l long, r long")
    a, b = w.select(F.col("track").alias("l"), F.col("power").alias("pa")), w.select(F.col("track").alias("r"), F.col("power").alias("pb"))
    both = F.broadcast(pairs).join(a, "l").join(b, "r")
    return both.select("l", "r", S.safe_ratio(F.greatest("pa", "pb"), F.least("pa", "pb")).alias("ratio"), (F.col("pa") > F.col("pb")).alias("left_greater")).withColumns(r6("ratio"))


@query("""select track, max(run) as flat_run from (select track, island, count(*) as run from (select *, sum(case when step <= 5 then 0 else 1 end) over (partition by track order by i) as island from (select *, abs(v - lag(v) over (partition by track order by i)) as step from event_signal)) group by all) group by track""", "event_signal")
def flat_run(spark, sf_dir):
    return W.flat_runs(V.event_signal(spark, sf_dir), 5.0)


@query(
    """with recursive s as (select n_nationkey, n_name as t from nation), h as (
  select n_nationkey, t, 0 as k, cast(2166136261 as bigint) as x from s
  union all select n_nationkey, t, k + 1, ((xor(x, ascii(substr(t, k + 1, 1))::bigint)) * 16777619) & 4294967295 from h where k < length(t))
select n_nationkey, lpad(lower(printf('%x', x)), 8, '0') as hash from h where k = length(t)"""
)
def fnv_ids(spark, sf_dir):
    return V.table(spark, sf_dir, "nation").select("n_nationkey", S.fnv1a(F.col("n_name")).alias("hash"))


@query("""select id, case when start < 0 then 'start' when "end" < start or "end" > 2500000 then 'end' when type not in ('view', 'click', 'purchase') then 'type' when confidence > 0.999 then 'confidence' end as problem from annotations""", "annotations")
def annotation_validate(spark, sf_dir):
    a = V.annotations(spark, sf_dir).withColumn("idx", F.col("id"))
    a = a.withColumn("confidence", F.when(F.col("confidence") > 0.999, F.lit(2.0)).otherwise(F.col("confidence")))
    return I.problems(a, 2500000.0, types=("view", "click", "purchase")).select("id", "problem")


@query("""with t as (select o_orderkey, strftime(o_orderdate, '%d.%m.%y') as d, '10.20.30' as t, o_totalprice / 10 as s, year(o_orderdate) % 100 as yy, o_orderdate from orders)
select o_orderkey, strftime(make_timestamp(case when yy >= 85 then 1900 + yy else 2000 + yy end, month(o_orderdate), day(o_orderdate), 10, 20, 30) + to_milliseconds(cast(floor(s * 1000 + 0.5) as bigint)), '%Y-%m-%d %H:%M:%S') as clock from t""")
def clock_at(spark, sf_dir):
    t = V.table(spark, sf_dir, "orders")
    start = S.parse_clock(F.date_format("o_orderdate", "dd.MM.yy"), F.lit("10.20.30"))
    return t.select("o_orderkey", F.substring(S.format_clock(S.clock_at(start, F.col("o_totalprice") / 10)), 1, 19).alias("clock"))


@query("select l_suppkey as recording, list_sort(list(distinct floor(l_quantity * 1000 + 0.5) / 1000))[1] as low, len(list(distinct floor(l_quantity * 1000 + 0.5) / 1000)) > 1 as mixed, arg_min(floor(l_quantity * 1000 + 0.5) / 1000, (l_orderkey, l_linenumber, floor(l_quantity * 1000 + 0.5) / 1000)) as main from lineitem group by l_suppkey")
def rate_summary(spark, sf_dir):
    from lanternfish.sources.edf import rate_summary as summary

    t = V.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("recording"), F.struct("l_orderkey", "l_linenumber").alias("signal_index"), F.lit("uV").alias("unit"), F.lit(False).alias("is_annotation"), F.col("l_quantity").cast("double").alias("fs"))
    return summary(t).select("recording", F.col("rates")[0].alias("low"), "mixed", F.col("primary").alias("main"))


@query("select label % 2 as side, (vec_id % 64) as t, round(pow(avg(pow(abs(cast(x as double)), 1.35)), 1 / 1.35), 6) + 0.0 as power from (select label, vec_id, unnest(embedding) as x from embeddings) group by all")
def generalized_mean_power(spark, sf_dir):
    e = V.table(spark, sf_dir, "embeddings").select((F.col("label") % 2).alias("side"), (F.col("vec_id") % 64).alias("t"), F.explode("embedding").alias("x"))
    return e.groupBy("side", "t").agg(A.generalised_mean(F.abs(F.col("x").cast("double"))).alias("power")).withColumns(r6("power"))


@query("""select id, cast(least(1399, greatest(0, floor((greatest(start / 1000, 0) - 1.28) / 0.64))) as bigint) as frame from annotations""", "annotations")
def asof_frame(spark, sf_dir):
    from lanternfish.operators.spectral import frame_at

    return V.annotations(spark, sf_dir).select("id", frame_at(F.col("start") / 1000, 2.56, 0.64, 1400).cast("long").alias("frame"))


@query("""select type, track, cast(island as bigint) as island, min(start) as start, max("end") as "end", count(*) as n from (select *, sum(case when start <= latest + 60 then 0 else 1 end) over (partition by type, track order by start, "end", id) as island from
(select *, max("end") over (partition by type, track order by start, "end", id rows between unbounded preceding and 1 preceding) as latest from annotations)) group by all""", "annotations")
def merge_runs(spark, sf_dir):
    return I.merged(V.annotations(spark, sf_dir), 60.0).drop("confidence")


@query("""select track, i, round(far, 6) + 0.0 as far from (select track, i, abs(v - 100) as far, lag(abs(v - 100)) over w as p, lead(abs(v - 100)) over w as q from event_signal window w as (partition by track order by i)) where far >= 200 and far >= p and far >= q""", "event_signal")
def local_peaks(spark, sf_dir):
    return W.local_peaks(V.event_signal(spark, sf_dir), F.lit(100.0), F.lit(200.0)).select("track", "i", "far").withColumns(r6("far"))


@query("""select track, i, last_value(c ignore nulls) over (partition by track order by i rows between 50 preceding and current row) as "left", first_value(c ignore nulls) over (partition by track order by i rows between 1 following and 50 following) as "right"
from (select *, case when (v - 100) * (p - 100) <= 0 or v = 100 then i end as c from (select *, lag(v) over (partition by track order by i) as p from event_signal))""", "event_signal")
def nearest_crossings(spark, sf_dir):
    return W.nearest_crossings(V.event_signal(spark, sf_dir), 100.0, 50).select("track", "i", "left", "right")


@query("""select track, i, coalesce(case when v < 100 then max(v - 100) over w else max(100 - v) over w end >= 60, false) as after_going from event_signal window w as (partition by track order by i rows between 14 following and 100 following)""", "event_signal")
def after_going(spark, sf_dir):
    return W.after_going(V.event_signal(spark, sf_dir), 100.0, 30.0, V.FS).select("track", "i", "after_going")


@query("""select track, count(*) as n, round(kurtosis_pop(v), 4) + 0.0 as kurtosis, round(max(abs(v)), 6) as peak, round(sqrt(avg(v * v)), 6) as rms from signal group by track""", "signal")
def track_moments(spark, sf_dir):
    s = V.signal(spark, sf_dir).groupBy("track").agg(F.count("*").alias("n"), (F.round(A.excess_kurtosis(F.col("v")), 4) + F.lit(0.0)).alias("kurtosis"), F.max(F.abs("v")).alias("peak"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"))
    return s.withColumns(r6("peak", "rms"))


@query("""select a.track as track, b.track as other, round(corr(a.v, b.v), 6) + 0.0 as r from signal a join signal b on a.i = b.i and a.track < b.track group by all""", "signal")
def track_correlations(spark, sf_dir):
    s = V.signal(spark, sf_dir)
    b = s.select("i", F.col("track").alias("other"), F.col("v").alias("w"))
    return s.join(b, "i").where("track < other").groupBy("track", "other").agg(A.correlation(F.col("v"), F.col("w")).alias("r")).withColumns(r6("r"))


@query("""select i, round(sum(v * (0.5 + track / 10.0) * cos((((track % 3) - 1) + 1) * pi() / 4)), 6) + 0.0 as "left", round(sum(v * (0.5 + track / 10.0) * sin((((track % 3) - 1) + 1) * pi() / 4)), 6) + 0.0 as "right" from signal where track <> 9 group by i""", "signal")
def stereo_mix(spark, sf_dir):
    controls = spark.range(10).select(F.col("id").alias("track"), (F.lit(0.5) + F.col("id") / 10).alias("gain"), ((F.col("id") % 3) - 1).cast("double").alias("pan"), (F.col("id") == 9).alias("mute"))
    return G.stereo_mix(V.signal(spark, sf_dir), controls).withColumns(r6("left", "right"))


@query("""with s as (select o_custkey, list(distinct o_orderpriority) as p from orders group by o_custkey) select o_custkey, len(p) as n, list_contains(p, '1-URGENT') as urgent from s""")
def category_sets(spark, sf_dir):
    return V.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p")).select("o_custkey", F.size("p").cast("long").alias("n"), F.array_contains("p", "1-URGENT").alias("urgent"))


@query("""select event_type as track, time_bucket(interval '1 hour', ts) as "start", count(*) as n, round(avg(value), 6) as mean, round(min(value), 6) as low, round(max(value), 6) as high from events group by all""")
def hourly_windows(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").select(F.col("event_type").alias("track"), "ts", F.col("value").alias("v"))
    out = e.groupBy("track", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"))
    return out.select("track", F.col("w.start").alias("start"), "n", "mean", "low", "high").withColumns(r6("mean", "low", "high"))


@query(
    """, b as (select p as pixel, cast(floor((1 + p / 100.0::double * 8) * 200) as bigint) as a, cast(floor((1 + (p + 1) / 100.0::double * 8) * 200) as bigint) as z from (select unnest(range(0, 100)) as p))
select track, pixel, count(*) as n, round(arg_min(v, i), 6) + 0.0 as first, round(min(v), 6) + 0.0 as low, round(max(v), 6) + 0.0 as high, arg_min(i, (v, i)) as low_at from event_signal join b on i >= a and i < greatest(z, a + 1) group by track, pixel""",
    "event_signal",
)
def pixel_envelope(spark, sf_dir):
    from lanternfish.operators.display import View, pixel_traces

    out = pixel_traces(V.event_signal(spark, sf_dir), V.FS, View(1.0, 8.0, 10.0), 100)
    return out.select("track", F.col("pixel").cast("long").alias("pixel"), "n", "first", "low", "high", "low_at").withColumns(r6("first", "low", "high"))


@query(
    """, n as (select track, greatest(1, count(*) // 12000) as step from event_signal group by track), v as (select e.track, v from event_signal e join n on e.track = n.track where i % step = 0),
b as (select track, list_sort(list(v))[count(*) // 2 + 1] as baseline from v group by track), d as (select v.track, baseline, list_sort(list(abs(v - baseline))) as d from v join b on v.track = b.track group by all)
select track, round(baseline, 6) + 0.0 as baseline, round(greatest(1e-6, d[cast(floor(0.995 * (len(d) - 1)) as bigint) + 1] * 1.12, d[cast(floor(0.9 * (len(d) - 1)) as bigint) + 1] * 1.65, d[cast(floor(0.75 * (len(d) - 1)) as bigint) + 1] * 4), 6) + 0.0 as peak from d""",
    "event_signal",
)
def ekg_profile(spark, sf_dir):
    from lanternfish.operators.display import ekg_profile as profile

    return profile(V.event_signal(spark, sf_dir)).select("track", "baseline", "peak").withColumns(r6("baseline", "peak"))


@query(
    """, n as (select track, greatest(1, count(*) // 6000) as step from signal group by track), v as (select e.track, list_sort(list(abs(v))) as d from signal e join n on e.track = n.track where i % step = 0 group by all),
w as (select least(2000, greatest(1, floor(max(d[least(len(d), cast(floor(len(d) * 0.97) as bigint) + 1)]) * 2 / 10 + 0.5))) as w from v),
p as (select unnest([1, 2, 3, 5, 7, 9, 10, 15, 20, 30, 50, 70, 100, 150, 200, 300, 500, 1000, 2000]) as p)
select cast(arg_min(p, (abs(p - w), p)) as double) as uv from p, w""",
    "signal",
)
def sensitivity_fit(spark, sf_dir):
    from lanternfish.operators.display import fitted_sensitivity

    return fitted_sensitivity(V.signal(spark, sf_dir).withColumn("kind", F.lit("eeg")))


@query("""with c as (select s_suppkey, s_nationkey % 5 = 0 as mute, s_nationkey % 7 = 3 as solo from supplier) select s_suppkey as track from c where not mute and (solo or not (select coalesce(bool_or(solo), false) from c))""")
def audible_tracks(spark, sf_dir):
    c = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("track"), (F.col("s_nationkey") % 5 == 0).alias("mute"), (F.col("s_nationkey") % 7 == 3).alias("solo"))
    return G.audible(c)


@query("""select id, l.track, round(greatest(start, 100000), 6) as x0, round(least("end", 400000), 6) as x1 from annotations a join (select unnest(range(0, 5)) as track) l on a.type = 'view' or a.track = l.track where "end" >= 100000 and start <= 400000""", "annotations")
def lane_overlap(spark, sf_dir):
    events = V.annotations(spark, sf_dir).withColumn("tracks", F.when(F.col("type") != "view", F.array("track"))).drop("track")
    lanes = spark.range(5).select(F.col("id").alias("track"))
    return I.overlapping_lanes(events, lanes, 100000.0, 400000.0).select("id", "track", "x0", "x1").withColumns(r6("x0", "x1"))


@query("""select p_partkey, round(10 * log10(greatest(1e-20, p_retailprice / 1e6)), 6) as db, round(least(1, greatest(0, (10 * log10(greatest(1e-20, p_retailprice / 1e6)) + 40) / 20)), 6) + 0.0 as shade, case when p_size < 4 then 'delta' when p_size < 8 then 'theta' when p_size < 13 then 'alpha' when p_size < 30 then 'beta' else 'gamma' end as band,
  round(440 * pow(2.0::double, (p_size - 69) / 12.0::double), 6) as hz from part""")
def power_shades(spark, sf_dir):
    t = V.table(spark, sf_dir, "part")
    db = S.decibels(F.col("p_retailprice") / 1e6)
    return t.select("p_partkey", db.alias("db"), S.unit_of(db, F.lit(-40.0), F.lit(-20.0)).alias("shade"), S.band_of(F.col("p_size")).alias("band"), S.midi_to_hz(F.col("p_size")).alias("hz")).withColumns(r6("db", "shade", "hz"))


def named_tracks(spark) -> DataFrame:
    return F.broadcast(G.described(V.channels(spark)).select(F.col("idx").alias("track"), F.col("canonical").alias("label"), "laterality", "kind", "fs", F.col("idx").alias("ord")))


def recording(spark, sf_dir) -> DataFrame:
    """The dense tracks as one recording in array form."""
    from lanternfish.operators.tracks import to_arrays

    t = to_arrays(V.signal(spark, sf_dir)).join(named_tracks(spark), "track")
    return t.select(F.lit("embeddings").alias("recording"), F.col("track").cast("string").alias("track"), "label", "laterality", "kind", "fs", "samples", "ord")


@query()
def iir_zero_phase(spark, sf_dir):
    """Rows only: recursive filters; tests hold them against a sample-by-sample recursion."""
    from lanternfish.operators.dsp import filtered
    from lanternfish.operators.tracks import to_samples

    return to_samples(filtered(recording(spark, sf_dir).select("track", "fs", "samples")))


@query()
def fast_ica(spark, sf_dir):
    """Rows only: iterative; tests hold it against mixed sources."""
    from lanternfish.operators.spatial import cleaned
    from lanternfish.operators.tracks import to_samples

    return to_samples(cleaned(recording(spark, sf_dir), regression=False, ica=True, group=("recording", "fs")))


@query()
def spectral_summary(spark, sf_dir):
    """Rows only: hemispheric spectra's bands; tests hold a frame against a direct transform."""
    from lanternfish.operators.spectral import chosen_for_summary, column_bands, framed, hemispheres, pieces, spectra

    samples = V.signal(spark, sf_dir)
    counted = pieces(samples)
    chosen = chosen_for_summary(framed(named_tracks(spark).where("kind = 'eeg'"), counted))
    plan = spark.createDataFrame(chosen.collect(), chosen.schema)  # at most eight rows a side, used in several places
    return column_bands(hemispheres(spectra(samples, counted, plan), plan))


@query()
def temporal_phenomena(spark, sf_dir):
    """Rows only: sequential rules; tests hold them against constructed signals."""
    from lanternfish.operators.screening import temporal

    return temporal(recording(spark, sf_dir)).drop("evidence", "artifact")


@query()
def screening_findings(spark, sf_dir):
    """Rows only."""
    from lanternfish.operators.screening import findings

    return findings(recording(spark, sf_dir)).drop("evidence", "thresholds")


@query()
def screening_evaluations(spark, sf_dir):
    """Rows only."""
    from lanternfish.operators.screening import evaluations

    return evaluations(recording(spark, sf_dir))


@query()
def deterministic_annotations(spark, sf_dir):
    """Rows only: the composed review list."""
    from lanternfish.operators.screening import annotations

    return annotations(recording(spark, sf_dir))


@query(
    """, e as (select id, type, track, cast(floor(start / 86400) as bigint) as bucket, row_number() over (partition by cast(floor(start / 86400) as bigint) order by confidence desc, start, id) as k from annotations),
g as (select bucket, 0::bigint as k, null::bigint as id, [null::bigint][2:] as used from (select distinct bucket from e)
  union all
  select g.bucket, e.k, case when len(g.used) < 8 and len(list_filter(g.used, lambda x: x = e.track)) < 3 then e.id end, case when len(g.used) < 8 and len(list_filter(g.used, lambda x: x = e.track)) < 3 then list_append(g.used, e.track) else g.used end
  from g join e on e.bucket = g.bucket and e.k = g.k + 1)
select id, type, track from annotations where id in (select id from g where id is not null)""",
    "annotations",
)
def greedy_quota(spark, sf_dir):
    """A fold; its twin goes through each bucket by recursion."""
    a = V.annotations(spark, sf_dir).withColumn("tracks", F.array(F.col("track").cast("string")))
    return I.quota(a, seconds=86400.0).select("id", "type", "track")


@query(
    """, e as (select id, cast(track as varchar) as track, start as peak, confidence as score, row_number() over (partition by track order by start, confidence desc, id) as k from annotations),
g as (select track, k, id, peak, score, true as opens, 0::bigint as kept from e where k = 1
  union all
  select g.track, e.k, case when e.peak - g.peak >= 3600 or e.score > g.score then e.id else g.id end, case when e.peak - g.peak >= 3600 or e.score > g.score then e.peak else g.peak end,
    case when e.peak - g.peak >= 3600 or e.score > g.score then e.score else g.score end, e.peak - g.peak >= 3600, g.kept + cast(e.peak - g.peak >= 3600 as bigint)
  from g join e on e.track = g.track and e.k = g.k + 1)
select track, arg_max(id, k) as id, arg_max(peak, k) as peak, arg_max(score, k) as score from g group by track, kept""",
    "annotations",
)
def refractory_fold(spark, sf_dir):
    """A fold; its twin goes through each track by recursion."""
    a = V.annotations(spark, sf_dir).select("id", F.col("track").cast("string").alias("track"), F.col("start").alias("peak"), F.col("confidence").alias("score"))
    return I.refractory(a, 3600.0)


@query()
def render_pcm(spark, sf_dir):
    """Rows only: sound at 8 kHz of all tracks, by regions of 30 s."""
    f = W.region_features(V.signal(spark, sf_dir), V.FS, 50)
    e = M.styled(M.mapped(f), "loui-soft-v1").withColumns({"start": F.col("sample_start") / V.FS, "end": F.col("sample_end") / V.FS})
    return M.rendered_regions(e, 8000)


for _name in ("greedy_quota", "refractory_fold"):
    ORACLE[_name] = ORACLE[_name].replace("with ", "with recursive ", 1)

from lanternfish import catalog_chunks, catalog_sessions, catalog_voices  # noqa: E402, F401  they register their queries
