"""Queries on scans and centroids, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lcspark.operators import traces as t
from lcspark.operators.regrid import scan_readings
from lcspark.operators.shape import steady_targets
from lcspark.sources.tables import read


def _points(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "points")


def _summary(spark: SparkSession, d: str) -> DataFrame:
    return t.scan_summary(read(spark, d, "scans"), _points(spark, d))


def _times(spark: SparkSession, d: str) -> DataFrame:
    return scan_readings(read(spark, d, "scans"))


def _features(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "aligned_feature_table").select("group_id", "study", "mz", "rt_min", "rt_max")


def _targets(spark: SparkSession, d: str) -> DataFrame:
    """The features of the tables, and the ions that the runs themselves show nearly throughout, those in the middle half of their study's time."""
    own = steady_targets(_points(spark, d))
    span = _times(spark, d).withColumn("study", t.study_of(F.col("run"))).groupBy("study").agg(F.min("minutes").alias("a"), F.max("minutes").alias("b"))
    own = own.join(span, "study").select("group_id", "study", "mz", (F.col("a") + (F.col("b") - F.col("a")) / 4).alias("rt_min"), (F.col("b") - (F.col("b") - F.col("a")) / 4).alias("rt_max"))
    return _features(spark, d).unionByName(own)


def r3(c: str):
    return F.round(c, 3).alias(c)


def q_scans(spark: SparkSession, d: str) -> DataFrame:
    return _summary(spark, d).select("run", "scan", "n_points", r3("tic"), "base_mz", "base_inten")


def q_scan_minutes(spark: SparkSession, d: str) -> DataFrame:
    return _times(spark, d).select("run", "scan", "minutes")


def q_eic(spark: SparkSession, d: str) -> DataFrame:
    """Chromatograms of every target of a run's study, with the scans that count as 0."""
    e = t.chromatogram(_points(spark, d), _targets(spark, d))
    n = read(spark, d, "scans").groupBy("run").agg(F.countDistinct("scan").alias("n_all"))
    out = e.groupBy("run", "group_id").agg(F.count("*").alias("n_scans"), F.max("inten").alias("height"), F.sum("inten").alias("total"))
    return out.join(n, "run").select("run", "group_id", "n_scans", (F.col("n_all") - F.col("n_scans")).alias("n_zero"), "height", r3("total"))


def q_eic_argmax(spark: SparkSession, d: str) -> DataFrame:
    """Scan and m/z of each chromatogram's highest centroid, the earliest on ties."""
    e = t.chromatogram(_points(spark, d), _targets(spark, d))
    best = e.groupBy("run", "group_id").agg(F.max(F.struct("inten", (-F.col("scan")).alias("s"), "mz")).alias("_b"))
    return best.select("run", "group_id", (-F.col("_b.s")).alias("scan"), F.col("_b.mz").alias("mz"), F.col("_b.inten").alias("inten"))


def q_gapfill(spark: SparkSession, d: str) -> DataFrame:
    f = _targets(spark, d)
    return t.boxes(t.chromatogram(_points(spark, d), f), _times(spark, d), f).select("run", "group_id", "n_scans", "height", r3("area"))


def q_noise_cells(spark: SparkSession, d: str) -> DataFrame:
    return t.noise_cells(_points(spark, d), _times(spark, d)).select("run", "band", "block", "n", r3("noise"))


def q_sideband(spark: SparkSession, d: str) -> DataFrame:
    """Centroids beside a ten times stronger one, a tenth of a percent in m/z to both sides."""
    return t.sidebands(_points(spark, d), 1000.0).groupBy("run").agg(F.count("*").alias("n"))


def q_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return t.next_neighbours(_points(spark, d)).groupBy("run").agg(F.count("*").alias("n_linked"), F.round(F.avg(F.abs("ppm")), 6).alias("mean_ppm"))


def q_smooth121(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("run").orderBy("scan")
    return _summary(spark, d).select("run", "scan", F.round(t.smooth121(F.col("tic"), w), 3).alias("smooth"))


def q_savgol(spark: SparkSession, d: str) -> DataFrame:
    """Median absolute Savitzky-Golay residual of each run's total ion current."""
    w = Window.partitionBy("run").orderBy("scan")
    s = _summary(spark, d).select("run", t.savgol_residual(F.col("tic"), w).alias("r"))
    return s.groupBy("run").agg(F.round(F.median(F.abs("r")), 3).alias("noise"), F.count("r").alias("n"))


def q_trapezoid(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("run").orderBy("minutes", "scan")
    s = scan_readings(read(spark, d, "scans"), t.valid_points(_points(spark, d))).filter("inten > 0")
    s = s.withColumn("a", (F.col("minutes") - F.lag("minutes").over(w)) * (F.col("inten") + F.lag("inten").over(w)) / 2)
    return s.groupBy("run").agg(F.round(F.sum("a"), 3).alias("area"))


def q_running_median(spark: SparkSession, d: str) -> DataFrame:
    """Median of eleven scans around each; the frame is an array, as ordered aggregates take none."""
    w = Window.partitionBy("run").orderBy("scan").rowsBetween(-5, 5)
    x = _summary(spark, d).select("run", "scan", F.array_sort(F.collect_list("tic").over(w)).alias("x"))
    n = F.size("x")
    at = lambda k: F.element_at("x", k.cast("int"))
    return x.select("run", "scan", F.round((at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2, 3).alias("reference"))


def q_islands(spark: SparkSession, d: str) -> DataFrame:
    return t.scan_islands(t.valid_points(_points(spark, d)))


def q_local_dt(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("run").orderBy("scan")
    s = _times(spark, d).select("run", (F.col("minutes") - F.lag("minutes").over(w)).alias("dt"))
    return s.groupBy("run").agg(F.round(F.median("dt"), 9).alias("dt"))


def q_bin_scans(spark: SparkSession, d: str) -> DataFrame:
    return t.occupied_bins(_points(spark, d))


def _asof(spark: SparkSession, d: str, run: Column) -> DataFrame:
    m = read(spark, d, "ms2_map").select(run.alias("run"), (F.col("rt_s") / 60).alias("minutes"), "map_id", F.lit(None).cast("int").alias("scan"), F.lit(1).alias("side"))
    s = _times(spark, d).select("run", "minutes", F.lit(None).cast("bigint").alias("map_id"), "scan", F.lit(0).alias("side"))
    w = Window.partitionBy("run").orderBy("minutes", "side", "scan").rowsBetween(Window.unboundedPreceding, 0)
    u = m.unionByName(s).withColumn("ms1_scan", F.last("scan", ignorenulls=True).over(w))
    return u.filter("side = 1").select("map_id", "ms1_scan")


def q_asof_scan(spark: SparkSession, d: str) -> DataFrame:
    """The MS1 scan that precedes each MS2 spectrum of the run: an as-of join by union and last value. Runs as ``file`` is written."""
    return _asof(spark, d, F.col("file"))


def q_asof_scan_whole(spark: SparkSession, d: str) -> DataFrame:
    """q_asof_scan with every spelling of ``file`` as its run."""
    return _asof(spark, d, t.run_key(F.col("file")))


#: Half width of the isolation window in Da, which the tables don't state.
ISOLATION = 3.0


def _precursor(spark: SparkSession, d: str, run: Column) -> DataFrame:
    from lcspark.band import band_join

    at = _asof(spark, d, run).filter("ms1_scan is not null")
    m = read(spark, d, "ms2_map").select("map_id", run.alias("run"), "precursor_mz").join(at, "map_id").withColumnRenamed("ms1_scan", "scan").filter("precursor_mz > 0")
    hits = band_join(m, t.valid_points(_points(spark, d)), "precursor_mz", "mz", 0.0, ["run", "scan"], da=ISOLATION)
    best = hits.groupBy("map_id").agg(F.max(F.struct("inten", (-F.col("pos")).alias("p"), "mz")).alias("_b"), F.sum("inten").alias("all"))
    out = best.select("map_id", F.col("_b.mz").alias("mz"), F.col("_b.inten").alias("inten"), F.least(F.col("_b.inten") / F.col("all"), F.lit(1.0)).alias("purity"))
    return out.select("map_id", "mz", "inten", F.round("purity", 6).alias("purity"))


def q_precursor_ms1(spark: SparkSession, d: str) -> DataFrame:
    """The strongest centroid of the isolation window in the preceding MS1 scan, and its share of the window. Runs as ``file`` is written."""
    return _precursor(spark, d, F.col("file"))


def q_precursor_ms1_whole(spark: SparkSession, d: str) -> DataFrame:
    """q_precursor_ms1 with every spelling of ``file`` as its run."""
    return _precursor(spark, d, t.run_key(F.col("file")))


QUERIES = {k: f for k, f in globals().items() if k.startswith("q_")}

V = "with v as (select run, scan, pos, mz, cast(inten as double) as inten, split_part(run, '_', 1) as study from points where inten > 0 and isfinite(inten) and mz > 0 and isfinite(mz))"
TIMES = """, units as (select run, max(case when lower(trim(rt_unit)) in ('second', 'minute') then lower(trim(rt_unit)) end) as u, max(rt) filter (isfinite(rt)) as most from scans group by run),
tm as (select s.run, s.scan, case when coalesce(u.u = 'second', u.most > 200) then s.rt / 60 else s.rt end as minutes from
  (select * from scans where rt is not null and isfinite(rt) qualify row_number() over (partition by run, scan order by loaded_at desc nulls last, rt desc) = 1) s join units u on s.run = u.run)"""
SUMMARY = V + """, b as (select run, scan, count(*) as n_points, sum(inten) as tic, max(inten) as base_inten from v group by run, scan),
m as (select v.run, v.scan, min(v.mz) as base_mz from v join b on v.run = b.run and v.scan = b.scan and v.inten = b.base_inten group by v.run, v.scan),
s as (select a.run, a.scan, coalesce(b.n_points, 0) as n_points, coalesce(b.tic, 0.0::double) as tic, m.base_mz, coalesce(b.base_inten, 0.0::double) as base_inten
  from (select distinct run, scan from scans) a left join b on a.run = b.run and a.scan = b.scan left join m on a.run = m.run and a.scan = m.scan)"""
TARGETS = """, bn as (select run, study, cast(floor(ln(mz) / 2e-5::double) as bigint) as bin, count(distinct scan) as n from v group by 1, 2, 3), rs as (select run, count(distinct scan) as total from v group by run),
sp as (select split_part(run, '_', 1) as study, min(minutes) as a, max(minutes) as b from tm group by 1),
ft as (select group_id, study, mz, rt_min, rt_max from aligned_feature_table union all select o.group_id, o.study, o.mz, a + (b - a) / 4, b - (b - a) / 4 from (select distinct bn.study, bn.bin as group_id, exp((bn.bin + 0.5::double) * 2e-5::double) as mz from bn join rs on bn.run = rs.run where bn.n >= 0.3::double * rs.total) o join sp on o.study = sp.study)"""
EIC = V + TIMES + TARGETS + """, h as (select v.run, f.group_id, v.scan, v.mz, v.inten, v.pos from v join ft f on v.study = f.study and abs(v.mz - f.mz) <= f.mz * (10.0::double / 1e6)),
e as (select run, group_id, scan, mz, inten from h qualify row_number() over (partition by run, group_id, scan order by inten desc, pos) = 1)"""
ORACLES = {
    "q_scans": SUMMARY + " select run, scan, n_points, round(tic, 3) as tic, base_mz, base_inten from s",
    "q_scan_minutes": V + TIMES + " select run, scan, minutes from tm",
    "q_eic": EIC + ", n as (select run, count(distinct scan) as n_all from scans group by run) select e.run, e.group_id, count(*) as n_scans, n.n_all - count(*) as n_zero, max(e.inten) as height, round(sum(e.inten), 3) as total from e join n on e.run = n.run group by e.run, e.group_id, n.n_all",
    "q_eic_argmax": EIC + " select run, group_id, scan, mz, inten from e qualify row_number() over (partition by run, group_id order by inten desc, scan) = 1",
    "q_gapfill": EIC + """, x as (select e.run, e.group_id, e.inten, tm.minutes, tm.scan from e join tm on e.run = tm.run and e.scan = tm.scan join ft f on e.group_id = f.group_id and f.study = split_part(e.run, '_', 1) where tm.minutes between f.rt_min and f.rt_max),
y as (select run, group_id, inten, (minutes - lag(minutes) over w) * (inten + lag(inten) over w) / 2 as a from x window w as (partition by run, group_id order by minutes, scan))
select run, group_id, count(*) as n_scans, max(inten) as height, round(coalesce(sum(a), 0), 3) as area from y group by run, group_id""",
    "q_noise_cells": V + TIMES + """, x as (select v.run, cast(least(floor(16 * ln(v.mz / 50.0::double) / ln(1700.0::double / 50)), 15) as integer) as band, cast(floor(tm.minutes) as integer) as block, v.inten from v join tm on v.run = tm.run and v.scan = tm.scan where v.mz between 50 and 1700),
f as (select run, quantile_cont(inten, 0.01) as fl from x group by run), c as (select run, band, block, count(*) as n, median(inten) as m from x group by run, band, block)
select c.run, c.band, c.block, c.n, round(case when c.n >= 50 then c.m else f.fl end, 3) as noise from c join f on c.run = f.run""",
    "q_sideband": V + " select run, count(*) as n from v a where exists (select 1 from v b where a.run = b.run and a.scan = b.scan and b.inten >= 10 * a.inten and abs(b.mz - a.mz) <= a.mz * (1000.0::double / 1e6)) group by run",
    "q_neighbors": V + """, j as (select a.run, a.scan, a.pos, a.mz, b.mz as mb from v a join v b on a.run = b.run and b.scan = a.scan + 1 and abs(b.mz - a.mz) <= a.mz * (20.0::double / 1e6) qualify row_number() over (partition by a.run, a.scan, a.pos, a.mz order by b.inten desc, b.pos) = 1)
select run, count(*) as n_linked, round(avg(abs((mb / mz - 1) * 1e6)), 6) as mean_ppm from j group by run""",
    "q_smooth121": SUMMARY + " select run, scan, round((coalesce(lag(tic) over w, 0) + 2 * tic + coalesce(lead(tic) over w, 0)) / 4, 3) as smooth from s window w as (partition by run order by scan)",
    "q_savgol": SUMMARY + ", x as (select run, (tic - (-3 * lag(tic, 2) over w + 12 * lag(tic) over w + 17 * tic + 12 * lead(tic) over w - 3 * lead(tic, 2) over w) / 35) / sqrt(1 - 17.0::double / 35) as r from s window w as (partition by run order by scan)) select run, round(median(abs(r)), 3) as noise, count(r) as n from x group by run",
    "q_trapezoid": V + TIMES + ", x as (select tm.run, tm.scan, tm.minutes, sum(v.inten) as y from tm join v on tm.run = v.run and tm.scan = v.scan group by tm.run, tm.scan, tm.minutes), z as (select run, (minutes - lag(minutes) over w) * (y + lag(y) over w) / 2 as a from x window w as (partition by run order by minutes, scan)) select run, round(sum(a), 3) as area from z group by run",
    "q_running_median": SUMMARY + " select run, scan, round(median(tic) over (partition by run order by scan rows between 5 preceding and 5 following), 3) as reference from s",
    "q_islands": V + ", x as (select run, scan, scan - row_number() over (partition by run order by scan) as k from (select distinct run, scan from v)) select run, min(scan) as first_scan, max(scan) as last_scan, count(*) as n from x group by run, k",
    "q_local_dt": V + TIMES + ", x as (select run, minutes - lag(minutes) over (partition by run order by scan) as dt from tm) select run, round(median(dt), 9) as dt from x group by run",
    "q_bin_scans": V + " select run, cast(floor(ln(mz) / (10.0::double * 1e-6)) as bigint) as bin, count(distinct scan) as n_scans from v group by 1, 2 having count(distinct scan) >= 10",
    "q_asof_scan": V + TIMES + ", x as (select m.map_id, tm.scan from ms2_map m left join tm on m.file = tm.run and tm.minutes <= m.rt_s / 60 qualify row_number() over (partition by m.map_id order by tm.minutes desc nulls last, tm.scan desc) = 1) select map_id, scan as ms1_scan from x",
    "q_precursor_ms1": V + TIMES + """, x as (select m.map_id, m.file, m.precursor_mz, tm.scan from ms2_map m join tm on m.file = tm.run and tm.minutes <= m.rt_s / 60 where m.precursor_mz > 0 qualify row_number() over (partition by m.map_id order by tm.minutes desc, tm.scan desc) = 1)
select x.map_id, v.mz, v.inten, round(least(v.inten / sum(v.inten) over (partition by x.map_id), 1), 6) as purity from x join v on x.file = v.run and x.scan = v.scan and abs(v.mz - x.precursor_mz) <= 3.0::double qualify row_number() over (partition by x.map_id order by v.inten desc, v.pos) = 1""",
}
ORACLES |= {f"{k}_whole": t.by_run(ORACLES[k]) for k in ("q_asof_scan", "q_precursor_ms1")}
