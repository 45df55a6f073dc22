"""Queries on the alignment of runs, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lcspark.operators import align as a
from lcspark.operators.stats import weighted_quantile
from lcspark.operators.traces import RUN_SQL, run_key
from lcspark.plans.traces import SUMMARY, _summary
from lcspark.session import materialise
from lcspark.sources.tables import read

SEARCH, WINDOW = 30.0, 0.5


def r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


def _anchors(spark: SparkSession, d: str) -> DataFrame:
    """A run's features by its MS2 spectra: of each feature the spectrum of the strongest precursor."""
    ok = "group_id is not null and precursor_mz > 0 and not isnan(precursor_mz) and rt_s is not null and not isnan(rt_s) and precursor_intensity > 0 and not isnan(precursor_intensity)"
    m = read(spark, d, "ms2_map").filter(ok).withColumn("run", run_key(F.col("file")))
    best = m.groupBy("run", "group_id").agg(F.max(F.struct("precursor_intensity", (-F.col("map_id")).alias("k"), "study", "precursor_mz", "rt_s")).alias("b"))
    return best.select("run", F.col("b.study").alias("study"), F.col("group_id").alias("anchor"), F.col("b.precursor_mz").alias("mz"), (F.col("b.rt_s") / 60).alias("rt"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "aligned_feature_table").select("study", F.col("group_id").alias("target"), F.col("mz").alias("mz_t"), F.col("rt").alias("rt_t"))
    return materialise(a.anchor_pairs(_anchors(spark, d), t, SEARCH, WINDOW))


def q_anchor_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("run", "anchor", "target", r("d_rt"), r("d_ppm"))


def q_coarse_shift(spark: SparkSession, d: str) -> DataFrame:
    return a.coarse_shift(_pairs(spark, d)).select("run", r("delta"), "support", r("sigma"))


def q_mz_modes(spark: SparkSession, d: str) -> DataFrame:
    return a.mz_modes(_pairs(spark, d), SEARCH).select("run", "mode", r("offset"), "support", r("half"), r("background"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d)
    return materialise(a.labelled_pairs(p, a.mz_modes(p, SEARCH)))


def q_labelled_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).select("run", "anchor", r("rt"), r("d_ppm"), "mode")


def q_mz_curve(spark: SparkSession, d: str) -> DataFrame:
    """The drift of a run's m/z error: a running median over the labelled anchors."""
    return a.moved_medians(_labelled(spark, d), "run", ["rt", "anchor"], "d_ppm").filter("median is not null").select("run", "anchor", r("median"))


def q_mz_step(spark: SparkSession, d: str) -> DataFrame:
    """Where a run's labels switch with the fewest points on the wrong side, however pure its sides."""
    return a.label_steps(_labelled(spark, d), 1, 0.0).select("run", r("at"), r("before"), r("after"), "wrong")


def q_isotonic(spark: SparkSession, d: str) -> DataFrame:
    """Knots of each run's warp, made increasing by weighted regression."""
    m = read(spark, d, "ms2_map").filter("rt_s is not null and rt_aligned_s is not null and not isnan(rt_s) and not isnan(rt_aligned_s)").select(run_key(F.col("file")).alias("run"), "map_id", "rt_s", "rt_aligned_s")
    m = m.filter("run is not null").withColumn("knot", F.ntile(20).over(Window.partitionBy("run").orderBy("rt_s", "map_id")))
    k = m.groupBy("run", "knot").agg(F.median("rt_s").alias("native"), F.avg("rt_aligned_s").alias("corr"), F.count("*").alias("n"))
    return a.isotonic(k.withColumn("shift", F.col("corr") - F.col("native")), "run", "knot", "shift", "n").select("run", "knot", r("native"), r("shift"), "n", r("fit"))


def q_anchor_weights(spark: SparkSession, d: str) -> DataFrame:
    """Anchors that elute together count as one: clusters from their first anchor on, and the weights of their members."""
    return a.start_clusters(_anchors(spark, d), "run", "rt", "anchor", 0.02).select("run", "anchor", "cluster", r("weight"))


def q_no_harm(spark: SparkSession, d: str) -> DataFrame:
    """How much of each run's shift to keep in each minute: the weighted median of the shares of it that bring spectra to their feature's time, 0 to 1."""
    m = read(spark, d, "ms2_map").filter("rt_s is not null and not isnan(rt_s) and rt_aligned_s is not null and not isnan(rt_aligned_s)").withColumn("run", run_key(F.col("file"))).filter("run is not null")
    f = read(spark, d, "aligned_feature_table").filter("rt is not null").select("group_id", (F.col("rt") * 60).alias("t"))
    x = m.join(f, "group_id").select("run", F.floor(F.col("rt_s") / 60).alias("minute"), "map_id", (F.col("rt_aligned_s") - F.col("rt_s")).alias("shift"), (F.col("t") - F.col("rt_s")).alias("need")).filter("abs(shift) > 1e-6")
    x = x.withColumn("part", F.least(F.greatest(F.col("need") / F.col("shift"), F.lit(0.0)), F.lit(1.0))).withColumn("weight", F.abs("shift"))
    return weighted_quantile(x, ["run", "minute"], "part", "weight", "map_id").select("run", "minute", r("part"))


def q_rolling_reference(spark: SparkSession, d: str) -> DataFrame:
    s = _summary(spark, d).filter("tic > 0")
    return a.rolling_reference(s, "run", "scan", "tic").select("run", "centre", r("reference", 3), "n")


def q_two_factors(spark: SparkSession, d: str) -> DataFrame:
    """The ion current as a mix of precursor intensity and number of peaks, neither negative."""
    m = read(spark, d, "ms2_map").filter("tic > 0 and not isnan(tic) and precursor_intensity > 0 and not isnan(precursor_intensity) and n_peaks > 0")
    m = m.select("study", (F.col("tic") / 1e5).alias("y"), (F.col("precursor_intensity") / 1e5).alias("a"), (F.col("n_peaks") / 100.0).alias("b"))
    return a.two_factor_nnls(m, ["study"], "y", "a", "b").select("study", r("u"), r("v"), r("residual"))


QUERIES = {k: f for k, f in globals().items() if k.startswith("q_")}


def _mode_sql(name: str, source: str, value: str, width: float, smooth: int) -> str:
    w = f"{width!r}::double"
    return f"""{name}_n as (select run, cast(floor({value} / {w}) as bigint) as k, count(*) as n from {source} group by 1, 2), {name}_x as (select run, k + s as k, sum(n) as n from {name}_n, unnest(range(-{smooth}, {smooth + 1})) t(s) group by 1, 2),
{name} as (select run, (k + 0.5::double) * {w} as centre from {name}_x qualify row_number() over (partition by run order by n desc, k) = 1)"""


ANCHORS = f"""with recursive an as (select run, study, group_id as anchor, precursor_mz as mz, rt_s / 60 as rt from (select {RUN_SQL} as run, * from ms2_map where group_id is not null and precursor_mz > 0 and isfinite(precursor_mz) and isfinite(rt_s) and precursor_intensity > 0 and isfinite(precursor_intensity))
  qualify row_number() over (partition by run, group_id order by precursor_intensity desc, map_id) = 1)"""
PAIRS = ANCHORS + """, p as (select * from (select an.run, an.anchor, f.group_id as target, an.rt, f.rt - an.rt as d_rt, (an.mz - f.mz) / f.mz * 1e6 as d_ppm from an join aligned_feature_table f on an.study = f.study and abs(f.rt - an.rt) <= 0.5::double and abs(an.mz - f.mz) < 0.2) where abs(d_ppm) <= 30)"""
MODES = PAIRS + f""", {_mode_sql("c1", "p", "d_ppm", 0.5, 2)},
b1 as (select run, median(d_ppm) as c, least(greatest(3 * 1.4826::double * median(abs(d_ppm - md)), 1), 5) as half from (select p.run, d_ppm, median(d_ppm) over (partition by p.run) as md from p join c1 on p.run = c1.run where abs(d_ppm - centre) <= 3) group by run),
p2 as (select p.run, p.d_ppm from p join b1 on p.run = b1.run where abs(d_ppm - c) > 2 * half), {_mode_sql("c2", "p2", "d_ppm", 0.5, 2)},
b2 as (select run, median(d_ppm) as c, least(greatest(3 * 1.4826::double * median(abs(d_ppm - md)), 1), 5) as half from (select p2.run, d_ppm, median(d_ppm) over (partition by p2.run) as md from p2 join c2 on p2.run = c2.run where abs(d_ppm - centre) <= 3) group by run),
bm as (select *, 1 as mode from b1 union all select *, 2 from b2), mo as (select bm.run, mode, median(d_ppm) as "offset", count(*) as support, any_value(half) as half from bm join p on p.run = bm.run and abs(d_ppm - c) <= half group by 1, 2),
tot as (select run, count(*) as n from p group by run), ms as (select mo.*, (tot.n - f.support) * f.half / greatest(30 - f.half, 1e-9::double) as background from mo join tot on mo.run = tot.run join mo f on f.run = mo.run and f.mode = 1)"""
LABELLED = MODES + """, lb as (select p.run, p.anchor, p.rt, p.d_ppm, ms.mode from p join ms on p.run = ms.run and abs(p.d_ppm - ms."offset") - ms.half <= 0 qualify row_number() over (partition by p.run, p.anchor order by abs(p.d_ppm - ms."offset") - ms.half, p.target, ms.mode) = 1)"""
ORACLES = {
    "q_anchor_pairs": PAIRS + " select run, anchor, target, round(d_rt, 6) as d_rt, round(d_ppm, 6) as d_ppm from p",
    "q_coarse_shift": PAIRS + f""", {_mode_sql("c", "p", "d_rt", 0.02, 1)}, nr as (select p.run, median(d_rt) as delta, count(*) as support from p join c on p.run = c.run where abs(d_rt - centre) <= 1.5 * 0.02::double group by 1),
wd as (select run, count(*) as n, median(abs(d_rt - md)) as mad from (select p.run, d_rt, median(d_rt) over (partition by p.run) as md from p join nr on p.run = nr.run where abs(d_rt - delta) <= 3 * 0.02::double) group by run)
select nr.run, round(delta, 6) as delta, support, round(greatest(case when n > 2 then 1.4826::double * mad else 0.02::double end, 0.25 * 0.02::double), 6) as sigma from nr join wd on nr.run = wd.run""",
    "q_mz_modes": MODES + """ select run, mode, round("offset", 6) as "offset", support, round(half, 6) as half, round(background, 6) as background from ms""",
    "q_labelled_pairs": LABELLED + " select run, anchor, round(rt, 6) as rt, round(d_ppm, 6) as d_ppm, mode from lb",
    "q_mz_curve": LABELLED + """, k as (select *, row_number() over (partition by run order by rt, anchor) - 1 as k, count(*) over (partition by run) as n from lb), z as (select *, least(n, least(n, least(greatest(n // 4, 9), 51)) | 1) as size from k),
w as (select *, least(greatest(k - size // 2, 0), n - size) as a from z where n >= 10) select w.run, w.anchor, round(median(y.d_ppm), 6) as median from w join k y on y.run = w.run and y.k between w.a and w.a + w.size - 1 group by 1, 2""",
    "q_mz_step": LABELLED + """, k as (select *, row_number() over (partition by run order by rt, anchor) as k, count(*) over (partition by run) as n, sum(cast(mode = 1 as integer)) over (partition by run order by rt, anchor rows unbounded preceding) as ones, lead(rt) over (partition by run order by rt, anchor) as nxt, sum(cast(mode = 1 as integer)) over (partition by run) as al from lb),
c as (select run, o, k as cut, (rt + nxt) / 2 as "at", case when o = 1 then k - ones + al - ones else n - (k - ones + al - ones) end as wrong from k, unnest([1, 2]) t(o) where k < n), b as (select * from c qualify row_number() over (partition by run order by wrong, o, cut) = 1),
g as (select b.run, any_value("at") as "at", any_value(wrong) as wrong, any_value(n) as n, count(*) filter (k <= cut and mode = o) as l, count(*) filter (k > cut and mode <> o) as r, median(d_ppm) filter (k <= cut and mode = o) as before, median(d_ppm) filter (k > cut and mode <> o) as after from b join k on b.run = k.run group by b.run)
select run, round("at", 6) as "at", round(before, 6) as before, round(after, 6) as after, cast(wrong as bigint) as wrong from g where l >= 1 and r >= 1 and n >= 2""",
    "q_isotonic": f"""with m as (select {RUN_SQL} as run, map_id, rt_s, rt_aligned_s from ms2_map where isfinite(rt_s) and isfinite(rt_aligned_s) and file is not null), t as (select *, cast(ntile(20) over (partition by run order by rt_s, map_id) as integer) as knot from m),
k as (select run, knot, median(rt_s) as native, avg(rt_aligned_s) as corr, count(*) as n from t group by 1, 2), c as (select *, corr - native as shift from k),
s as (select x.run, x.knot as j, y.knot as e, sum(z.n * z.shift) / sum(z.n) as m from c x join c y on x.run = y.run and y.knot >= x.knot join c z on z.run = x.run and z.knot between x.knot and y.knot group by 1, 2, 3),
f as (select i.run, i.knot, s.j, min(s.m) as low from c i join s on s.run = i.run and s.j <= i.knot and s.e >= i.knot group by 1, 2, 3), g as (select run, knot, max(low) as fit from f group by 1, 2)
select c.run, c.knot, round(native, 6) as native, round(shift, 6) as shift, n, round(fit, 6) as fit from c join g on c.run = g.run and c.knot = g.knot""",
    "q_anchor_weights": ANCHORS + """, st as (select run, min(rt) as s from an group by run union all select run, nx from (select st.run, (select min(an.rt) from an where an.run = st.run and an.rt - st.s > 0.02::double) as nx from st) where nx is not null),
k as (select run, anchor, rt, row_number() over (partition by run order by rt, anchor) as k from an), c as (select k.run, k.anchor, k.k, max(st.s) as s from k join st on k.run = st.run and st.s <= k.rt group by 1, 2, 3)
select run, anchor, cast(min(k) over (partition by run, s) as integer) as cluster, round(1.0::double / count(*) over (partition by run, s), 6) as weight from c""",
    "q_no_harm": f"""with x as (select {RUN_SQL} as run, cast(floor(m.rt_s / 60) as bigint) as minute, m.map_id, m.rt_aligned_s - m.rt_s as s, f.rt * 60 - m.rt_s as n from ms2_map m join aligned_feature_table f on m.group_id = f.group_id where isfinite(m.rt_s) and isfinite(m.rt_aligned_s) and f.rt is not null and m.file is not null),
y as (select *, least(greatest(n / s, 0), 1) as part, abs(s) as w from x where abs(s) > 1e-6), z as (select run, minute, part, sum(w) over (partition by run, minute order by part, map_id) as c, sum(w) over (partition by run, minute) as t from y) select run, minute, round(min(part), 6) as part from z where c >= 0.5 * t group by 1, 2""",
    "q_rolling_reference": SUMMARY + """, c as (select run, scan, tic, unnest(range(greatest(cast(ceil((scan - 50) / 10.0::double) as bigint), 0), cast(floor((scan + 50) / 10.0::double) as bigint) + 1)) as c from s where tic > 0)
select run, c * 10 as centre, round(median(tic), 3) as reference, count(*) as n from c group by 1, 2 having count(*) >= 0.5 * 101""",
    "q_two_factors": """with m as (select study, tic / 1e5 as y, precursor_intensity / 1e5 as a, n_peaks / 100.0::double as b from ms2_map where tic > 0 and isfinite(tic) and precursor_intensity > 0 and isfinite(precursor_intensity) and n_peaks > 0),
s as (select study, sum(a * a) as aa, sum(a * b) as ab, sum(b * b) as bb, sum(a * y) as ay, sum(b * y) as byy, sum(y * y) as yy, count(*) as n from m group by study),
f as (select *, aa * bb - ab * ab as det, greatest(ay / aa, 0) as ua, greatest(byy / bb, 0) as vb from s), g as (select *, (ay * bb - byy * ab) / det as fu, (byy * aa - ay * ab) / det as fv, yy - 2 * ua * ay + ua * ua * aa <= yy - 2 * vb * byy + vb * vb * bb as oa from f),
h as (select *, case when fu >= 0 and fv >= 0 then fu when oa then ua else 0 end as u, case when fu >= 0 and fv >= 0 then fv when oa then 0 else vb end as v from g)
select study, round(u, 6) as u, round(v, 6) as v, round(sqrt(greatest((yy - 2 * u * ay - 2 * v * byy + u * u * aa + 2 * u * v * ab + v * v * bb) / n, 0)), 6) as residual from h""",
}
