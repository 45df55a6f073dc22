"""Queries on the shapes of ion traces and the gates of candidates, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lcspark.functions import gates
from lcspark.operators import shape as s
from lcspark.operators.regrid import scan_readings
from lcspark.plans.traces import TIMES, V
from lcspark.session import materialise
from lcspark.sources.tables import read

SD = 1.5
#: The m/z error model of the gates: floor, intensity term, factors of the quarter decades below a saturated top.
SIGMA = {"a": 1.0, "b": 200.0, "factors": (2.0, 1.5, 1.2), "top": 6.5}


def dense(spark: SparkSession, d: str) -> DataFrame:
    """The traces of the ions that a run shows nearly throughout, written once."""
    p = read(spark, d, "points")
    return materialise(s.dense_traces(p, scan_readings(read(spark, d, "scans")), s.steady_targets(p)))


def r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


def q_steady_targets(spark: SparkSession, d: str) -> DataFrame:
    return s.steady_targets(read(spark, d, "points")).select("study", "group_id", r("mz"))


def q_dense_traces(spark: SparkSession, d: str) -> DataFrame:
    """Traces with their zeros: scans in all, scans with signal, and the sum."""
    t = dense(spark, d)
    return t.groupBy("run", "group_id").agg(F.count("*").alias("n_scans"), F.count_if(F.col("inten") > 0).alias("n_signal"), F.round(F.sum("inten"), 2).alias("total"))


def q_gaussian(spark: SparkSession, d: str) -> DataFrame:
    return s.smoothed_traces(dense(spark, d), SD).select("run", "group_id", "scan", r("smooth", 3))


_KEY = ["run", "group_id", "block"]


def q_candidates(spark: SparkSession, d: str) -> DataFrame:
    c = s.candidates(dense(spark, d))
    return c.select(*_KEY, "height", "scan_apex", r("rt"), "scan_lo", "scan_hi", "n_scans", "n_gaps", r("area", 3), r("fwhm"), r("mz"), r("mz_sd_ppm", 4), "baseline", r("noise", 4), r("snr", 4), r("prominence_rel"), r("tv_ratio"), "n_valleys", "n_flat", r("gauss_r2", 4))


def q_sides(spark: SparkSession, d: str) -> DataFrame:
    t = dense(spark, d)
    return s.side_levels(t, s.candidates(t)).select(*_KEY, r("ridge_ratio"), r("background_ratio"), r("ripple_ratio", 4), r("far_level"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    t = dense(spark, d)
    c = materialise(s.candidates(t))
    c = c.join(s.side_levels(t, c), _KEY)
    usual = c.groupBy("run").agg(F.median("fwhm").alias("width"), F.max("scan_hi").alias("last_scan"))
    return c.join(usual, "run").withColumn("sigma", gates.sigma_ppm(F.col("height"), **SIGMA))


def q_gates(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate with the gates it fails, its flags and its score; rejects keep their reasons."""
    c = _judged(spark, d)
    why = gates.reasons(F.col("sigma"), gates.least_scans(F.col("width"), F.col("dt")))
    return c.select(*_KEY, r("sigma"), F.array_join(why, ";").alias("reasons"), gates.flags(F.col("width"), F.col("last_scan")).alias("flags"), F.round(gates.rule_score(F.col("sigma"), F.col("width")), 5).alias("score"))


def q_narrow(spark: SparkSession, d: str) -> DataFrame:
    """Limits of the width from the candidates that pass signal and prominence and elute nearest."""
    c = _judged(spark, d).withColumn("id", F.col("group_id") * 1_000_003 + F.col("block")).withColumn("passed", (F.col("snr") >= 3) & (F.col("prominence_rel") >= 0.2) & F.col("fwhm").isNotNull())
    n = gates.nearby_widths(c.select("run", "id", "rt", "fwhm", "passed"))
    return n.filter("narrow_median is not null").select("run", "id", r("narrow_median"), r("narrow_quantile"), (F.col("fwhm") < F.col("narrow_median")).cast("int").alias("narrow"))


def _shapes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = dense(spark, d)
    c = materialise(s.candidates(t))
    return materialise(s.prominences(materialise(s.smoothed_traces(t, SD)), c)), c


def q_prominences(spark: SparkSession, d: str) -> DataFrame:
    return _shapes(spark, d)[0].select(*_KEY, r("top", 3), "top_scan", "is_apex", r("prominence", 3), r("noise", 3))


def q_eic_check(spark: SparkSession, d: str) -> DataFrame:
    return s.eic_classes(*_shapes(spark, d))


def q_gap_confirm(spark: SparkSession, d: str) -> DataFrame:
    """Which stretches, taken as gaps to be filled, hold a peak by the usual height and noise of their ion in the study."""
    shapes, c = _shapes(spark, d)
    ref = shapes.join(c.select(*_KEY, "height"), _KEY).withColumn("study", F.split_part("run", F.lit("_"), F.lit(1))).groupBy("study", "group_id").agg(F.median("height").alias("height"), F.median("noise").alias("noise"))
    return s.confirmed(shapes, ref).select(*_KEY, r("top", 3), "confirmed")


def q_isotope_partner(spark: SparkSession, d: str) -> DataFrame:
    """Candidates whose apex scan holds a centroid one 13C step above, for charge 1 and 2, between a hundredth of the height and the height."""
    from lcspark.band import band_join
    from lcspark.constants import C13
    from lcspark.operators.traces import valid_points

    c = s.candidates(dense(spark, d)).select(*_KEY, F.col("scan_apex").alias("scan"), "height", F.explode(F.array(F.lit(1.0), F.lit(2.0))).alias("z"), "mz").withColumn("above", F.col("mz") + C13 / F.col("z"))
    p = valid_points(read(spark, d, "points")).select("run", "scan", F.col("mz").alias("mz_p"), F.col("inten").alias("inten_p"))
    ok = (F.col("inten_p") >= 0.01 * F.col("height")) & (F.col("inten_p") <= F.col("height"))
    return band_join(c, p, "above", "mz_p", 2000.0, ["run", "scan"], ok).groupBy(*_KEY, F.col("z").cast("int").alias("z")).agg(F.count("*").alias("n"), F.max("inten_p").alias("strongest"))


QUERIES = {k: f for k, f in globals().items() if k.startswith("q_")}

DENSE = V + TIMES + """, bn as (select run, study, cast(floor(ln(mz) / 2e-5::double) as bigint) as bin, count(distinct scan) as n from v group by 1, 2, 3), rs as (select run, count(distinct scan) as total from v group by run),
tg as (select distinct bn.study, bn.bin as group_id, exp((bn.bin + 0.5::double) * 2e-5::double) as mz from bn join rs on bn.run = rs.run where bn.n >= 0.3::double * rs.total),
h0 as (select v.run, tg.group_id, v.scan, v.mz, v.inten, v.pos from v join tg on v.study = tg.study and abs(v.mz - tg.mz) <= tg.mz * (10.0::double / 1e6)),
e as (select run, group_id, scan, mz, inten from h0 qualify row_number() over (partition by run, group_id, scan order by inten desc, pos) = 1),
dn as (select tm.run, i.group_id, tm.scan, tm.minutes, e.mz, coalesce(e.inten, 0.0::double) as inten, cast(floor(tm.scan / 32) as bigint) as block from tm join (select distinct run, group_id from e) i on tm.run = i.run left join e on e.run = tm.run and e.group_id = i.group_id and e.scan = tm.scan)"""
_W = s.gaussian_weights(SD)
_H = len(_W) // 2
SMOOTH = ", sm as (select *, " + f"{_W[_H]!r}::double * inten" + "".join(f" + {_W[_H - k]!r}::double * coalesce(lag(inten, {k}) over w, first_value(inten) over w2) + {_W[_H + k]!r}::double * coalesce(lead(inten, {k}) over w, last_value(inten) over w2)" for k in range(1, _H + 1)) + """ as smooth from dn
window w as (partition by run, group_id order by scan), w2 as (partition by run, group_id order by scan rows between unbounded preceding and unbounded following))"""
CAND = """, nz as (select run, group_id, greatest(coalesce(median(d), 0) / (0.6745::double * sqrt(2)), 1e-9::double) as noise from (select run, group_id, abs(inten - lag(inten) over (partition by run, group_id order by scan)) as d from dn where inten > 0) group by 1, 2),
pp as (select *, max(inten) over (partition by run, group_id, block) as height, minutes - lag(minutes) over w as dt, inten - lag(inten) over w as di, case when lag(inten) over w > 1.25::double * inten and lead(inten) over w > 1.25::double * inten then 1 else 0 end as valley,
  cast(scan - 32 * block as double) as x, ln(inten) as y from dn where inten > 0 window w as (partition by run, group_id, block order by scan)),
cg as (select run, group_id, block, max(height) as height, min(scan) filter (inten = height) as scan_apex, arg_min(minutes, scan) filter (inten = height) as rt, min(scan) as scan_lo, max(scan) as scan_hi, count(*) as n_scans,
  coalesce(sum(dt * (2 * inten - di) / 2), 0) as area, count(*) filter (inten >= 0.5 * height) as n_half, median(dt) as dt, sum(mz * inten) filter (inten >= 0.5 * height) / sum(inten) filter (inten >= 0.5 * height) as mz, coalesce(stddev_pop(mz), 0) as sd,
  least(arg_min(inten, scan), arg_max(inten, scan)) as baseline, coalesce(sum(abs(di)), 0) as tv, 2 * max(inten) - arg_min(inten, scan) - arg_max(inten, scan) as rise, sum(valley) as n_valleys, count(*) filter (inten >= 0.99::double * height) as n_flat,
  sum(x) as s1, sum(x ** 2) as s2, sum(x ** 3) as s3, sum(x ** 4) as s4, sum(y) as t0, sum(x * y) as t1, sum(x ** 2 * y) as t2, sum(y * y) as q from pp group by 1, 2, 3),
cp as (select *, s2 - s1 * s1 / n_scans as a, s3 - s1 * s2 / n_scans as b, s4 - s2 * s2 / n_scans as c, t1 - s1 * t0 / n_scans as u, t2 - s2 * t0 / n_scans as v0, q - t0 * t0 / n_scans as total from cg),
cd as (select cp.run, cp.group_id, cp.block, height, scan_apex, rt, scan_lo, scan_hi, n_scans, scan_hi - scan_lo + 1 - n_scans as n_gaps, area, n_half * dt as fwhm, dt, mz, sd / mz * 1e6 as mz_sd_ppm, baseline, noise, (height - baseline) / noise as snr, (height - baseline) / height as prominence_rel,
  coalesce(tv / nullif(rise, 0), 1) as tv_ratio, n_valleys, n_flat, case when n_scans >= 4 and a * c - b * b > 1e-9 and total > 1e-9 then least(greatest((c * u * u - 2 * b * u * v0 + a * v0 * v0) / (a * c - b * b) / total, 0), 1) else 0.5 end as gauss_r2
  from cp join nz on cp.run = nz.run and cp.group_id = nz.group_id)"""
SIDES = """, sl as (select c.run, c.group_id, c.block, side, case when side < 0 then scan_apex - 48 else scan_apex + 16 end as lo from cd c, unnest([-1, 1]) t(side)),
dd as (select run, group_id, scan, inten, inten - lag(inten) over (partition by run, group_id order by scan) as d from dn),
sa as (select sl.run, sl.group_id, sl.block, side, quantile_cont(inten, 0.9) as q90, quantile_cont(inten, 0.25) as q25, median(inten) as med, median(inten) filter (inten > 0) as mednz, median(abs(d)) as ripple from sl join dd on sl.run = dd.run and sl.group_id = dd.group_id and dd.scan between lo and lo + 32 group by 1, 2, 3, 4 having count(*) >= 3),
sb as (select run, group_id, block, min(q90) as q90, min(q25) as q25, min(mednz) as mednz from sa group by 1, 2, 3), sc as (select run, group_id, block, med, ripple from sa qualify row_number() over (partition by run, group_id, block order by med, side) = 1),
sd as (select cd.*, coalesce(q90, 0) / height as ridge_ratio, coalesce(q25, 0) / height as background_ratio, case when ripple > 0 then (height - med) / ripple end as ripple_ratio, coalesce(mednz, 0) / height as far_level
  from cd left join sb on cd.run = sb.run and cd.group_id = sb.group_id and cd.block = sb.block left join sc on cd.run = sc.run and cd.group_id = sc.group_id and cd.block = sc.block)"""
JUDGED = SIDES + """, us as (select run, median(fwhm) as width, max(scan_hi) as last_scan from sd group by run),
jd as (select sd.*, us.width, us.last_scan, sqrt(1 + 200.0::double * 200 / height) * coalesce(list_extract([2.0, 1.5, 1.2], cast(greatest(floor((6.5::double - log10(height)) * 4), 0) as integer) + 1)::double, 1) as sigma from sd join us on sd.run = us.run)"""
SHAPE = SMOOTH + CAND + """, se as (select *, coalesce(smooth >= lag(smooth) over w, true) as up, coalesce(smooth >= lead(smooth) over w, true) as down from sm window w as (partition by run, group_id order by scan)),
tp as (select c.run, c.group_id, c.block, c.scan_lo, c.scan_hi, s.smooth as top, s.scan as top_scan, cast(s.up and s.down as integer) as is_apex from cd c join se s on c.run = s.run and c.group_id = s.group_id and s.scan between c.scan_lo and c.scan_hi qualify row_number() over (partition by c.run, c.group_id, c.block order by s.smooth desc, s.scan) = 1),
nr as (select tp.*, s.scan, s.inten, s.smooth, max(case when s.smooth > top and s.scan < top_scan then s.scan end) over k as wl, min(case when s.smooth > top and s.scan > top_scan then s.scan end) over k as wr, case when s.scan not between scan_lo and scan_hi then s.inten - s.smooth end as rest
  from tp join se s on tp.run = s.run and tp.group_id = s.group_id and s.scan between top_scan - 64 and top_scan + 64 window k as (partition by tp.run, tp.group_id, tp.block)),
pg as (select run, group_id, block, min(smooth) filter (scan <= top_scan and (wl is null or scan > wl)) as ml, min(smooth) filter (scan >= top_scan and (wr is null or scan < wr)) as mr, median(rest) as mid, median(inten - smooth) as mid_all, count(rest) as n_rest from nr group by 1, 2, 3),
ng as (select nr.run, nr.group_id, nr.block, 1.4826::double * median(abs(case when n_rest >= 10 then rest - mid else inten - smooth - mid_all end)) as own from nr join pg on nr.run = pg.run and nr.group_id = pg.group_id and nr.block = pg.block group by 1, 2, 3),
sh as (select tp.run, tp.group_id, tp.block, tp.top, tp.top_scan, tp.is_apex, tp.top - greatest(ml, mr) as prominence, own as noise from tp join pg on tp.run = pg.run and tp.group_id = pg.group_id and tp.block = pg.block join ng on tp.run = ng.run and tp.group_id = ng.group_id and tp.block = ng.block)"""
_TERM = lambda x: f"least(greatest({x}, 0), 1)"
_SCORE = " * ".join(map(_TERM, ("(log2(greatest(snr, 1e-9::double)) - log2(3)) / (log2(50) - log2(3))", "gauss_r2", "1 - mz_sd_ppm / (3 * sigma + 1)", "prominence_rel", "n_scans * dt / width", "1 - far_level", "1 / greatest(tv_ratio, 1e-9::double)")))
ORACLES = {
    "q_steady_targets": DENSE + " select study, group_id, round(mz, 6) as mz from tg",
    "q_dense_traces": DENSE + " select run, group_id, count(*) as n_scans, count(*) filter (inten > 0) as n_signal, round(sum(inten), 2) as total from dn group by 1, 2",
    "q_gaussian": DENSE + SMOOTH + " select run, group_id, scan, round(smooth, 3) as smooth from sm",
    "q_candidates": DENSE + CAND + " select run, group_id, block, height, scan_apex, round(rt, 6) as rt, scan_lo, scan_hi, n_scans, n_gaps, round(area, 3) as area, round(fwhm, 6) as fwhm, round(mz, 6) as mz, round(mz_sd_ppm, 4) as mz_sd_ppm, baseline, round(noise, 4) as noise, round(snr, 4) as snr, round(prominence_rel, 6) as prominence_rel, round(tv_ratio, 6) as tv_ratio, n_valleys, n_flat, round(gauss_r2, 4) as gauss_r2 from cd",
    "q_sides": DENSE + CAND + SIDES + " select run, group_id, block, round(ridge_ratio, 6) as ridge_ratio, round(background_ratio, 6) as background_ratio, round(ripple_ratio, 4) as ripple_ratio, round(far_level, 6) as far_level from sd",
    "q_gates": DENSE + CAND + JUDGED + f""" select run, group_id, block, round(sigma, 6) as sigma, concat_ws(';', case when n_scans < least(greatest(round(0.5::double * width / dt), 3), 5) then 'scans' end, case when snr < 3 then 'snr' end, case when mz_sd_ppm > 3 * sigma + 1 then 'mz_sd' end, case when prominence_rel < 0.2::double then 'prominence' end,
  case when ridge_ratio > 0.5 then 'ridge' end, case when background_ratio > 1.0::double / 3 then 'background' end, case when ripple_ratio < 3 then 'ripple' end, case when far_level > 0.5 then 'far' end) as reasons,
  concat_ws(';', case when scan_lo <= 1 or scan_hi >= last_scan then 'edge' end, case when n_gaps > 0 then 'gap' end, case when fwhm > 5 * width then 'wide' end, case when ridge_ratio > 0.5 then 'ridge' end, case when n_flat >= 3 then 'flat_top' end, case when n_valleys >= 2 then 'lumpy' end) as flags, round(({_SCORE}) ** (1.0::double / 7), 5) as score from jd""",
    "q_narrow": DENSE + CAND + JUDGED + """, pa as (select run, group_id * 1000003 + block as id, rt, fwhm from jd where snr >= 3 and prominence_rel >= 0.2::double and fwhm is not null),
pk as (select *, row_number() over (partition by run order by rt, id) - 1 as k, count(*) over (partition by run) as n from pa), pw as (select *, least(greatest(k - least(100, n) // 2, 0), n - least(100, n)) as a, least(100, n) as size from pk where n >= 30),
nw as (select x.run, x.id, any_value(x.fwhm) as fwhm, 0.3::double * median(y.fwhm) as nm, quantile_cont(y.fwhm, 0.02) as nq from pw x join pk y on x.run = y.run and y.k between x.a and x.a + x.size - 1 group by 1, 2)
select run, id, round(nm, 6) as narrow_median, round(nq, 6) as narrow_quantile, cast(fwhm < nm as integer) as narrow from nw""",
    "q_prominences": DENSE + SHAPE + " select run, group_id, block, round(top, 3) as top, top_scan, is_apex, round(prominence, 3) as prominence, round(noise, 3) as noise from sh",
    "q_eic_check": DENSE + SHAPE + """, cl as (select sh.*, c.height, row_number() over (partition by sh.run, top_scan, round(ln(c.mz) / (10.0::double * 1e-6)) order by c.height desc, sh.group_id, sh.block) as k from sh join cd c on sh.run = c.run and sh.group_id = c.group_id and sh.block = c.block)
select run, group_id, block, case when is_apex = 0 then 'noapex' when k > 1 then 'dup' when prominence < 3 * noise then 'lowsnr' else 'ok' end as class from cl""",
    "q_gap_confirm": DENSE + SHAPE + """, sx as (select sh.*, c.height, split_part(sh.run, '_', 1) as study from sh join cd c on sh.run = c.run and sh.group_id = c.group_id and sh.block = c.block), rf as (select study, group_id, median(height) as height, median(noise) as noise from sx group by 1, 2)
select sx.run, sx.group_id, sx.block, round(top, 3) as top, cast(is_apex = 1 and top >= 0.05::double * rf.height and prominence >= 3 * greatest(sx.noise, rf.noise) as integer) as confirmed from sx join rf on sx.study = rf.study and sx.group_id = rf.group_id""",
    "q_isotope_partner": DENSE + CAND + """ select c.run, c.group_id, c.block, z, count(*) as n, max(v.inten) as strongest from cd c, unnest([1, 2]) t(z) join v on v.run = c.run and v.scan = c.scan_apex and abs(v.mz - (c.mz + 1.0033548378::double / z)) <= (c.mz + 1.0033548378::double / z) * (2000.0::double / 1e6) and v.inten between 0.01::double * c.height and c.height group by 1, 2, 3, 4""",
}
