"""Registered queries that work through chunks, levels and buckets: playback, viewports, read-outs, recurrences, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanternfish.catalog import ORACLE, query, r6
from lanternfish.operators import chunks, pyramid, running, segments, spectral, unmixing
from lanternfish.operators import montage as G
from lanternfish.operators.display import View
from lanternfish.operators.dsp import Filters, highpass
from lanternfish.operators.playback import played, taps
from lanternfish.plans import views as V

FS = V.FS
#: Columns of a screen, and samples of a chunk: small, so that the test tables have many chunks.
PIXELS, SMALL = 1000, 500


@query(
    """, s as (select track, i * 5000 as spike from signal where abs(v) >= 30), t as (select distinct i * 5000 as eeg from signal where i % 3 = 0),
f as (select track, eeg, min(spike) as spike from s join t on eeg >= spike and eeg <= spike + 50000 group by track, eeg)
select track, eeg, spike, eeg - spike as lag, round(exp((eeg - spike) / 1e6 * -55), 6) as level from f where eeg - spike < 45000""",
    "signal",
)
def playback_taps(spark, sf_dir):
    """Large samples as spikes; a clock of 10 ms at one and a half times the recording's speed."""
    s = V.signal(spark, sf_dir)
    ticks = played(s.where("i % 3 = 0").select((F.col("i") / 3 * 10_000).cast("long").alias("at")).distinct(), speed=1.5)
    return taps(s.where(F.abs("v") >= 30).select("track", (F.col("i") * 5000).alias("spike")), ticks).withColumns(r6("level"))


COLUMNS_SQL = """, n as (select max(i) + 1 as total from signal),
p as (select p, greatest(0, cast(floor((0.0 + p / 1000.0::double * (total / 200.0::double)) * 200.0::double) as bigint)) as a, least(total, cast(floor((0.0 + (p + 1) / 1000.0::double * (total / 200.0::double)) * 200.0::double) as bigint)) as b from (select unnest(range(0, 1000)) as p), n),
q as (select p, a, least((select total from n), greatest(b, a + 1)) as b from p where a < (select total from n))"""


def _columns(spark, sf_dir, viewed, *ties):
    s = V.signal(spark, sf_dir, *ties)
    total = s.agg(F.max("i")).first()[0] + 1
    view = viewed(total)
    return s, pyramid.columns(pyramid.build(s), s, FS, view, PIXELS, total), view, total


@query(
    COLUMNS_SQL
    + """, c as (select track, p, count(*) as n, min(i) as start, max(i) as stop, arg_min(v, i) as first, arg_max(v, i) as last, min(v) as low, max(v) as high, arg_min(i, (v, i)) as low_at, arg_min(i, (-v, i)) as high_at
  from q join signal s on s.i >= q.a and s.i < q.b group by track, p),
g as (select *, (low_at - start) / greatest(1, stop - start)::double as ls, (high_at - start) / greatest(1, stop - start)::double as hs from c)
select track, cast(p as integer) as pixel, n, low_at, high_at, round(low, 6) + 0.0 as low, round(high, 6) + 0.0 as high, round(p * 1.2 + ls * 1.2, 6) as low_x, round(p * 1.2 + hs * 1.2, 6) as high_x,
  case when abs(low - (first + (last - first) * ls)) > 1e-7 then round(first + (last - first) * ls, 6) + 0.0 end as low_from,
  case when abs(high - (first + (last - first) * hs)) > 1e-7 then round(first + (last - first) * hs, 6) + 0.0 end as high_from from g""",
    "signal",
)
def viewport_columns(spark, sf_dir):
    """The whole recording on a screen of 1000 columns, 1200 wide, read from the pyramid.

    Its SQL ends at total / 200 * 200, which for some totals is rounded to one sample less; so does this view.
    """
    _, cols, _, _ = _columns(spark, sf_dir, lambda total: View(0.0, total / FS, total / FS))
    out = pyramid.geometry(cols, PIXELS, 1200.0)
    return out.select("track", "pixel", "n", "low_at", "high_at", "low", "high", "low_x", "high_x", "low_from", "high_from").withColumns(r6("low", "high", "low_x", "high_x", "low_from", "high_from"))


@query("select track, count(*) as seen, cast(0 as bigint) as outside, true as covers from signal group by track", "signal")
def columns_cover(spark, sf_dir):
    """Whether columns of the whole recording, to its last sample at any total, hold every sample.

    Both are made from numbered vectors, each by itself, so those of one vec_id are numbered by what they hold.
    """
    s, cols, view, total = _columns(spark, sf_dir, lambda total: View.whole(total, FS), "embedding")
    return pyramid.covered(s, cols, FS, view, PIXELS, total)


CENTRED_SQL = """, n as (select track, max(i) + 1 as n from signal group by track),
c as (select s.track, s.i / 200.0::double as t, n from signal s join n on n.track = s.track where s.i % 37 = 0),
e as (select track, t, greatest(0, cast(floor((t - 0.5) * 200) as bigint)) as a, least(n, cast(floor((t + 0.5) * 200) as bigint)) as b,
  greatest(0, cast(floor((t - 0.125) * 200) as bigint)) as c, least(n, cast(floor((t + 0.125) * 200) as bigint)) as d from c),
l as (select track, i, v, lag(v) over (partition by track order by i) as before from signal),
m as (select e.track, t, a, b, c, d, count(*) filter (where i > a and i < b and before <= 0 and v > 0) as ups, sum(v * v) filter (where i >= c and i < d) as squares
  from e join l on l.track = e.track and i >= a and i < b group by all),
w as (select track, t, case when b - a < 8 then 0 else ups / ((b - a) / 200.0::double) end as hz, case when d <= c then 0 else sqrt(squares / (d - c)) end as rms from m)"""


@query(CENTRED_SQL + " select track, t, round(hz, 6) + 0.0 as hz, round(rms, 6) + 0.0 as rms from w", "signal")
def centred_windows(spark, sf_dir):
    """Rhythm over a second and root mean square over a quarter around every 37th sample, from running totals."""
    s = V.signal(spark, sf_dir)
    return running.centred(running.totals(s), s.where("i % 37 = 0").select("track", (F.col("i") / FS).alias("t")), FS).withColumns(r6("hz", "rms"))


@query(
    CENTRED_SQL.replace("where s.i % 37 = 0", "").replace("from signal s join n on n.track = s.track ", "from n, (select distinct i from signal where i % 37 = 0) s ").replace("s.track, s.i", "n.track, s.i")
    + """, k as (select track, t from c), z as (select k.track, k.t, coalesce(hz, 0) as hz, coalesce(rms, 0) as rms from k left join w on w.track = k.track and w.t = k.t)
select t, round(avg(hz), 6) + 0.0 as hz, case when round(avg(hz), 9) < 4 then 'delta' when round(avg(hz), 9) < 8 then 'theta' when round(avg(hz), 9) < 13 then 'alpha' when round(avg(hz), 9) < 30 then 'beta' else 'gamma' end as band, round(avg(rms), 6) + 0.0 as uv from z group by t""",
    "signal",
)
def cursor_readout(spark, sf_dir):
    s = V.signal(spark, sf_dir)
    times = s.where("i % 37 = 0").select((F.col("i") / FS).alias("t")).distinct()
    return running.readout(running.totals(s), times, FS).withColumns(r6("hz", "uv"))


@query(
    """, e as (select cast(label as varchar) as side, row_number() over (partition by label order by vec_id) - 1 as t, list_transform(embedding, lambda x: cast(x as double) * 100) as x from embeddings),
p as (select side, t, list_transform(range(0, 33), lambda f: pow(list_sum(list_transform(range(0, 64), lambda j: x[j + 1] * cos(2 * pi() * f * j / 64))), 2) + pow(list_sum(list_transform(range(0, 64), lambda j: x[j + 1] * sin(2 * pi() * f * j / 64))), 2)) as power from e),
l as (select side, max(t) as last from p group by side), g as (select side, last, unnest(range(0, (select max(last) + 1 from l))) as t from l)
select g.side, g.t, unnest(range(0, 24)) as bin, round(unnest(list_transform(range(0, 24), lambda f: power[least(33, cast(floor(f / 23.0::double * 32 + 0.5) as bigint) + 1)])), 4) + 0.0 as power from g join p on p.side = g.side and p.t = least(g.last, g.t)""",
    "signal",
)
def regridded_spectra(spark, sf_dir):
    """Power of each vector of 64 samples at 33 frequencies, on a grid of 24 for as many times as the longest track has."""
    s = V.signal(spark, sf_dir)
    frames = s.select(F.col("track").cast("string").alias("side"), F.floor(F.col("i") / 64).alias("t"), (F.col("i") % 64).alias("j"), "v")
    held = frames.groupBy("side", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda r: r["v"]).alias("x"))
    angle = lambda f, j: F.lit(2 * 3.141592653589793) * f * j / 64
    total = lambda wave: lambda f: F.aggregate(F.transform("x", lambda x, j: x * wave(angle(f, j))), F.lit(0.0), lambda a, b: a + b)
    power = F.transform(F.sequence(F.lit(0), F.lit(32)), lambda f: F.pow(total(F.cos)(f), F.lit(2.0)) + F.pow(total(F.sin)(f), F.lit(2.0)))
    held = held.select("side", "t", power.alias("power"))
    times = int(s.agg(F.max(F.floor(F.col("i") / 64))).first()[0]) + 1
    out = spectral.regridded(held, times, 24).select("side", "t", F.posexplode("power").alias("bin", "power"))
    return out.select("side", "t", F.col("bin").cast("long").alias("bin"), (F.round("power", 4) + F.lit(0.0)).alias("power"))


@query(
    """, n as (select track, count(*) as n, floor(count(*) * 10.0 / 200.0 + 0.5) as k from signal group by track)
select s.track, n.n, round(sqrt(pow(sum(v * cos(2 * pi() * k * i / n.n)), 2) + pow(sum(v * sin(2 * pi() * k * i / n.n)), 2)), 4) as magnitude from signal s join n on n.track = s.track group by s.track, n.n""",
    "signal",
)
def single_bin(spark, sf_dir):
    """The bin at 10 Hz of each whole track, from what chunks of 500 samples leave."""
    return chunks.single_bin(chunks.in_chunks(V.signal(spark, sf_dir), SMALL), FS, 10.0, SMALL).withColumn("magnitude", F.round("magnitude", 4))


def recursion(source: str, out: str, section, back: bool) -> str:
    """SQL of one pass of a section over source(track, x list in single precision): out(track, x), one step a sample."""
    b0, b1, b2, a1, a2 = (f"({float(c)!r}::double)" for c in section)
    x = "list_reverse(x)" if back else "x"
    y = "cast(list(y order by i) as float[])"
    return f""", {out}_a as materialized (select track, {x} as x, len(x) as n from {source}),
{out}_r as (
  select track, 0 as i, {b0} * x[1] as y, {b1} * x[1] - {a1} * ({b0} * x[1]) as s1, {b2} * x[1] - {a2} * ({b0} * x[1]) as s2 from {out}_a
  union all
  select r.track, r.i + 1, {b0} * a.x[r.i + 2] + r.s1, r.s2 + {b1} * a.x[r.i + 2] - {a1} * ({b0} * a.x[r.i + 2] + r.s1), {b2} * a.x[r.i + 2] - {a2} * ({b0} * a.x[r.i + 2] + r.s1)
  from {out}_r r join {out}_a a on a.track = r.track where r.i + 1 < a.n
), {out} as (select track, {"list_reverse(" + y + ")" if back else y} as x from {out}_r group by track)"""


#: A low cut alone: each sample of its twin is one step of a recursion.
LOW_CUT = Filters(hff=0, notch60=False)
BIPOLAR = ((0, 4), (1, 5), (2, 8), (3, 9), (4, 6), (5, 7))


def _montage(spark):
    return spark.createDataFrame([(f"{V.CHANNELS[a]}-{V.CHANNELS[b]}", a, b, True) for a, b in BIPOLAR], "id string, source_a long, source_b long, available boolean")


BIPOLAR_SQL = (
    ", b as (select * from (values "
    + ", ".join(f"('{V.CHANNELS[a]}-{V.CHANNELS[b]}', {a}, {b})" for a, b in BIPOLAR)
    + ") t(track, p, q)), raw as (select b.track, s.i, cast(cast(s.v - t.v as float) as double) as v from b join signal s on s.track = p join signal t on t.track = q and t.i = s.i)"
)


@query(
    BIPOLAR_SQL
    + ", x0 as (select track, list(cast(v - m as float) order by i) as x from (select track, i, cast(cast(v as float) as double) as v, avg(cast(cast(v as float) as double)) over (partition by track) as m from raw) group by track)"
    + recursion("x0", "x1", highpass(FS, 1.0), False)
    + recursion("x1", "x2", highpass(FS, 1.0), True)
    + " select track, generate_subscripts(x, 1) - 1 as i, round(cast(unnest(x) as double), 2) + 0.0 as v from x2",
    "signal",
)
def segment_filtered(spark, sf_dir):
    """Six derivations of the whole recording through a low cut, forward and back, in chunks of 500 samples."""
    s = V.signal(spark, sf_dir)
    out = segments.segment(s, _montage(spark), V.channels(spark).select("idx", "fs"), LOW_CUT, SMALL)
    return out.select("track", "i", (F.round("v", 2) + F.lit(0.0)).alias("v"))


ORACLE["segment_filtered"] = ORACLE["segment_filtered"].replace("with ", "with recursive ", 1)


def _pages_sql() -> str:
    """Each page with its margin of 10 s as a list, through all passes of the display's filters, each a recursion."""
    out = BIPOLAR_SQL + """, n as (select max(i) + 1 as n from raw), o as (select track, avg(v) as m from raw group by track),
g as (select unnest(range(0, cast(ceil((select n from n) / 200.0::double / 10) as bigint))) as page, n from n),
x0 as (select raw.track || '#' || page as track, list(cast(v - m as float) order by i) as x from raw join o on o.track = raw.track
  join g on i >= floor(greatest(0, page * 10 - 10) * 200.0::double) and i < ceil(least(n / 200.0::double, (page + 1) * 10 + 10) * 200.0::double) group by all)"""
    plan = chunks.passes(Filters(), FS)
    for k, (section, back) in enumerate(plan):
        out += recursion(f"x{k}", f"x{k + 1}", section, back)
    return out + f""", y as (select split_part(track, '#', 1) as track, cast(split_part(track, '#', 2) as bigint) as page, generate_subscripts(x, 1) - 1 as k, cast(unnest(x) as double) as v from x{len(plan)}),
z as (select track, page, k + greatest(0, page * 10 - 10) * 200 as i, v from y)
select track, page, i // 20 as "column", count(*) as n, round(min(v), 2) + 0.0 as low, round(max(v), 2) + 0.0 as high from z where i // 2000 = page group by all"""


@query(_pages_sql(), "signal")
def display_pages(spark, sf_dir):
    """Extremes by tenth of a second of all pages of 10 s, each with its margin, display filters on."""
    raw = segments.raw(V.signal(spark, sf_dir), _montage(spark), V.channels(spark).select("idx", "fs"))
    out = segments.pages(raw.drop("fs"), FS, 10.0)
    low, high = (F.round(f("v"), 2) + F.lit(0.0) for f in (F.min, F.max))
    return out.groupBy("track", "page", F.floor(F.col("i") / 20).alias("column")).agg(F.count("*").alias("n"), low.alias("low"), high.alias("high"))


ORACLE["display_pages"] = ORACLE["display_pages"].replace("with ", "with recursive ", 1)


#: What is clipped: some samples of the view reach 300.
MOST, RECORD, SEGMENT = 30.0, 0.25, 16


@query(
    f""", n as (select ceil((max(i) + 1) / 50.0::double) * 50 as total from signal), g as (select track, unnest(range(0, cast(total as bigint))) as i from (select distinct track from signal), n),
d as (select g.track, g.i, least(32767, greatest(-32768, floor((coalesce(v, 0) + {MOST}) / (2 * {MOST}) * 65535 - 32768 + 0.5::double))) as d from g left join signal s on s.track = g.track and s.i = g.i)
select track, i, round(cast(cast((d + 32768) / 65535.0::double * (2 * {MOST}) - {MOST} as float) as double), 5) + 0.0 as v from d""",
    "signal",
)
def edf_round_trip(spark, sf_dir):
    """The view as EDF files of 16 records each, written, read back and calibrated."""
    from lanternfish.sources import edf, edf_writer

    edf.register(spark)
    s = V.signal(spark, sf_dir).withColumn("recording", F.lit("view"))
    labels = V.channels(spark).select(F.col("idx").alias("track"), "label", "unit")
    path = edf_writer.scratch(spark, "edf")
    rows = edf_writer.records(s, labels, FS, RECORD, MOST, SEGMENT)
    rows.write.format("edf").option("path", path).option("seconds", RECORD).option("most", MOST).mode("append").save()
    own = edf.samples(spark.read.format("edf").load(path), edf.signals(spark, path))
    segment = F.regexp_extract("recording", r"-(\d+)\.edf$", 1).cast("long")
    return own.select(F.col("track").cast("long").alias("track"), (F.col("i") + segment * round(SEGMENT * RECORD * FS)).alias("i"), (F.round("v", 5) + F.lit(0.0)).alias("v"))


@query(
    """, n as (select min(c) as least from (select count(*) as c from signal where track < 9 group by track)),
r as (select i, a.v as p, b.v as q from signal a join signal b using (i) join n on i < least where a.track = 0 and b.track = 1),
f as (select track, covar_pop(v, p) as vp, covar_pop(v, q) as vq, var_pop(p) as pp, var_pop(q) as qq, covar_pop(p, q) as pq, avg(p) as mp, avg(q) as mq from signal join r using (i) where track between 2 and 8 group by track),
w as (select track, mp, mq, (vp * qq - vq * pq) / (pp * qq - pq * pq) as wp, (vq * pp - vp * pq) / (pp * qq - pq * pq) as wq from f),
o as (select s.track, i, cast(cast(v - wp * (p - mp) - wq * (q - mq) as float) as double) as v from signal s join w using (track) join r using (i)
  union all select track, i, v from signal join n on i >= least or track not between 2 and 8)
select track, i, round(v, 4) + 0.0 as v from o""",
    "signal",
)
def regressed_blocks(spark, sf_dir):
    """Seven channels less what follows both frontal poles, which stand in for eye channels, in blocks of 500 samples."""
    c = G.described(V.channels(spark)).select(F.lit("view").alias("recording"), F.col("idx").alias("track"), F.col("idx").alias("ord"), F.col("canonical").alias("label"), "kind")
    return unmixing.cleaned(V.signal(spark, sf_dir), c, FS, size=SMALL).withColumn("v", F.round("v", 4) + F.lit(0.0))


@query(
    """with c as (select c_custkey // 8 as recording, c_custkey as ord, case when c_custkey % 7 = 0 then 'EEG Fp' || (c_custkey % 2 + 1) || '-' || c_name else c_name end as label,
  case when c_mktsegment = 'MACHINERY' and c_nationkey % 3 = 0 then 'eog' when c_mktsegment = 'FURNITURE' and c_nationkey % 2 = 0 then 'emg' else 'eeg' end as kind, c_custkey % 7 = 0 as pole from customer),
l as (select recording, string_agg(label, ', ' order by ord) filter (where kind = 'eog') as eog, string_agg(label, ', ' order by ord) filter (where kind = 'emg') as emg, string_agg(label, ', ' order by ord) filter (where kind = 'eeg' and pole) as poles from c group by recording),
m as (select recording, eog, emg, case when eog is null then poles end as proxies from l)
select recording, coalesce(eog, '') as eog, coalesce(emg, '') as emg, coalesce(proxies, '') as ocular_proxies, concat_ws(', ', eog, emg, proxies) as used,
  case when eog is not null and emg is not null then 'Using ' || eog || ' and ' || emg || ' as noise references.'
    when eog is not null then 'Using ' || eog || ' as ocular references. No EMG channel in this montage.'
    when emg is not null and proxies is not null then 'Using ' || emg || ' as muscle references and ' || proxies || ' as ocular proxies.'
    when emg is not null then 'Using ' || emg || ' as muscle references. No EOG channel in this montage.'
    when proxies is not null then 'No EOG/EMG channels. Using ' || proxies || ' as ocular proxies.'
    else 'No EOG, EMG, or frontal ocular-proxy channels in this window.' end as summary from m"""
)
def noise_references(spark, sf_dir):
    """The report for recordings of eight channels each, made from customers."""
    c = V.table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    label = F.when(key % 7 == 0, F.concat(F.lit("EEG Fp"), (key % 2 + 1).cast("string"), F.lit("-"), "c_name")).otherwise(F.col("c_name"))
    kind = F.when((F.col("c_mktsegment") == "MACHINERY") & (F.col("c_nationkey") % 3 == 0), "eog").when((F.col("c_mktsegment") == "FURNITURE") & (F.col("c_nationkey") % 2 == 0), "emg").otherwise("eeg")
    out = unmixing.noise_references(c.select(F.floor(key / 8).alias("recording"), key.alias("ord"), label.alias("label"), kind.alias("kind")))
    return out.select("recording", *(F.array_join(x, ", ").alias(x) for x in ("eog", "emg", "ocular_proxies", "used")), "summary")
