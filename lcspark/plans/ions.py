"""Queries on links of centroids and on ions of one compound, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lcspark.operators import compounds as c
from lcspark.operators import ions as i
from lcspark.operators import links as k
from lcspark.operators.features import coeluting, feature_pairs
from lcspark.operators.traces import RUN_SQL, run_key
from lcspark.plans.features import COELUTE
from lcspark.plans.shape import DENSE, dense
from lcspark.plans.traces import V
from lcspark.session import materialise
from lcspark.sources.tables import read

#: Correlation from which two traces are of one compound.
CUT = 0.3


def r(x: str, n: int = 6):
    return F.round(x, n).alias(x)


def q_links(spark: SparkSession, d: str) -> DataFrame:
    return k.links(read(spark, d, "points")).select("run", "id", r("effective", 3), "link")


def _roots(spark: SparkSession, d: str) -> DataFrame:
    return k.roots(materialise(k.links(read(spark, d, "points"))))


def q_roots(spark: SparkSession, d: str) -> DataFrame:
    return _roots(spark, d)


def q_basins(spark: SparkSession, d: str) -> DataFrame:
    return k.basins(read(spark, d, "points"), _roots(spark, d)).select("run", "root", "scan_lo", "scan_hi", "n_scans", "n_points", "height", r("area", 2), r("mz"))


def _shapes(spark: SparkSession, d: str) -> DataFrame:
    return materialise(i.shape_correlations(i.trace_pairs(dense(spark, d))))


def q_shape_correlations(spark: SparkSession, d: str) -> DataFrame:
    return _shapes(spark, d).select("study", "a", "b", "n_runs", r("weighted"), r("median"), r("pooled"))


def _seen(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "filled_mask").filter("filled = 0 and group_id >= 1").select("group_id", "run").distinct()


def q_coelute_shared(spark: SparkSession, d: str) -> DataFrame:
    """Co-eluting pairs that some run detects both of."""
    return i.shared_runs(coeluting(read(spark, d, "aligned_feature_table"), 0.1), _seen(spark, d))


def q_height_correlations(spark: SparkSession, d: str) -> DataFrame:
    """Co-eluting pairs by the heights of their spectra over the runs of both."""
    m = read(spark, d, "ms2_map").filter("group_id is not null and precursor_intensity > 0 and not isnan(precursor_intensity)").select("group_id", run_key(F.col("file")).alias("run"), F.col("precursor_intensity").alias("height")).filter("run is not null")
    return i.height_correlations(coeluting(read(spark, d, "aligned_feature_table"), 0.5), m).select("a", "b", "n", r("r"), r("steady"))


def q_ion_compounds(spark: SparkSession, d: str) -> DataFrame:
    """The steady ions of a study in compounds: stars of correlated traces, made consistent, with the roles of their members."""
    t = dense(spark, d)
    edges = i.shape_correlations(i.trace_pairs(t)).filter(F.col("weighted").isNotNull()).select(F.concat_ws(":", "study", "a").alias("sa"), F.concat_ws(":", "study", "b").alias("sb"), "study", "a", "b", F.col("weighted").alias("r"))
    edges = materialise(edges.select(F.xxhash64("sa").alias("a"), F.xxhash64("sb").alias("b"), "r"))
    n = t.withColumn("study", F.split_part("run", F.lit("_"), F.lit(1))).groupBy("study", "group_id").agg(F.max("inten").alias("w"), F.avg("mz").alias("mz")).withColumn("id", F.xxhash64(F.concat_ws(":", "study", "group_id")))
    n = materialise(n)
    stars = c.star_clusters(n.select("id", F.col("w").alias("weight")), edges.filter(F.col("r") >= CUT).select("a", "b"))
    m = i.consistent_clusters(stars.join(n, "id").select("id", F.col("center").alias("cluster"), "w"), edges, CUT)
    x = c.roles(m.join(n, "id").select("id", F.col("cluster").alias("center"), "mz", F.col("w").alias("weight")))
    out = x.join(n.select("id", "study", "group_id"), "id").join(n.select(F.col("id").alias("center"), F.col("group_id").alias("center_id")), "center")
    return out.select("study", "group_id", "center_id", "role", F.round("neutral_mass", 5).alias("neutral_mass"))


def q_strongest_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Features of each study, the most detected first, none within a fifth of a percent in m/z and a minute of one kept before."""
    f = read(spark, d, "aligned_feature_table")
    near = feature_pairs(f, 2000.0, (F.col("a") < F.col("b")) & (F.abs(F.col("rt_a") - F.col("rt_b")) <= 1.0)).select("a", "b")
    kept = c.star_clusters(f.select(F.col("group_id").alias("id"), F.col("n_detected").alias("weight")), near).filter("id = center")
    return kept.select(F.col("id").alias("group_id"))


def q_satellites(spark: SparkSession, d: str) -> DataFrame:
    """Ions of a study whose traces hang together, as the sets that correlations of 0.3 or more connect."""
    e = _shapes(spark, d).filter("weighted >= 0.3").select(F.concat_ws(":", "study", "a").alias("a"), F.concat_ws(":", "study", "b").alias("b"))
    return c.components(e).select(F.col("id").alias("ion"), F.col("component").alias("first_ion"))


QUERIES = {x: f for x, f in globals().items() if x.startswith("q_")}

LINKS = V.replace("with v as", "with recursive v as") + """, p0 as (select run, scan, scan::bigint * 1000000 + pos as id, mz, inten from v),
p as (select *, case when abs(lag(mz) over w - mz) <= mz * (20.0::double / 1e6) then lag(id) over w end as lf, case when abs(lead(mz) over w - mz) <= mz * (20.0::double / 1e6) then lead(id) over w end as rg,
  inten + coalesce(case when abs(lag(mz) over w - mz) <= mz * (20.0::double / 1e6) then lag(inten) over w end, 0) + coalesce(case when abs(lead(mz) over w - mz) <= mz * (20.0::double / 1e6) then lead(inten) over w end, 0) as effective from p0 window w as (partition by run, scan order by mz, id)),
h as (select a.run, a.id, b.id as t, abs(b.scan - a.scan) as k, b.scan > a.scan as after, b.inten from p a, unnest([-3, -2, -1, 1, 2, 3]) x(d) join p b on b.run = a.run and b.scan = a.scan + d and abs(b.mz - a.mz) <= a.mz * (20.0::double / 1e6)),
s as (select run, id, t from h qualify row_number() over (partition by run, id, after order by k, inten desc, t) = 1), e as (select * from s union all select run, id, lf from p where lf is not null union all select run, id, rg from p where rg is not null),
b as (select e.run, e.id, e.t, p.effective as eff from e join p on p.run = e.run and p.id = e.t qualify row_number() over (partition by e.run, e.id order by p.effective desc, p.inten desc, e.t) = 1),
l as (select p.run, p.id, p.effective, case when b.eff > p.effective then b.t end as link from p left join b on p.run = b.run and p.id = b.id)"""
ROOTS = LINKS + """, wk as (select run, id, id as at from l union all select wk.run, wk.id, l.link from wk join l on l.run = wk.run and l.id = wk.at where l.link is not null), rt as (select wk.run, wk.id, wk.at as root from wk join l on l.run = wk.run and l.id = wk.at where l.link is null)"""
PEARSON = lambda n, x, y, xx, yy, xy: f"case when {n} >= 3 and {xx} - {x} * {x} / {n} > 0 and {yy} - {y} * {y} / {n} > 0 then ({xy} - {x} * {y} / {n}) / sqrt(({xx} - {x} * {x} / {n}) * ({yy} - {y} * {y} / {n})) end"
SHAPES = f""", j as (select a.run, a.group_id as a, b.group_id as b, a.inten as x, b.inten as y from dn a join dn b on a.run = b.run and a.scan = b.scan and a.group_id < b.group_id where a.inten > 0 or b.inten > 0),
g as (select run, split_part(run, '_', 1) as study, a, b, count(*) as n, sum(x) as sx, sum(y) as sy, sum(x * x) as xx, sum(y * y) as yy, sum(x * y) as xy, least(max(x), max(y)) as low from j group by 1, 2, 3, 4), h as (select *, {PEARSON("n", "sx", "sy", "xx", "yy", "xy")} as r from g),
sh as (select study, a, b, count(r) as n_runs, sum(case when r is not null then log10(greatest(low, 10)) * atanh(least(greatest(r, -0.999999::double), 0.999999::double)) end) / sum(case when r is not null then log10(greatest(low, 10)) end) as z, median(r) as median, sum(n) as n, sum(sx) as sx, sum(sy) as sy, sum(xx) as xx, sum(yy) as yy, sum(xy) as xy from h group by 1, 2, 3)"""
ORACLES = {
    "q_links": LINKS + " select run, id, round(effective, 3) as effective, link from l",
    "q_roots": ROOTS + " select * from rt",
    "q_basins": ROOTS + """ select rt.run, rt.root, min(p.scan) as scan_lo, max(p.scan) as scan_hi, count(distinct p.scan) as n_scans, count(*) as n_points, max(p.inten) as height, round(sum(p.inten), 2) as area, round(sum(p.mz * p.inten) / sum(p.inten), 6) as mz
  from rt join p on rt.run = p.run and rt.id = p.id group by 1, 2 having count(distinct p.scan) >= 4""",
    "q_shape_correlations": DENSE + SHAPES + f""" select study, a, b, n_runs, round((exp(2 * z) - 1) / (exp(2 * z) + 1), 6) as weighted, round(median, 6) as median, round({PEARSON("n", "sx", "sy", "xx", "yy", "xy")}, 6) as pooled from sh""",
    "q_satellites": (DENSE + SHAPES).replace("with v as", "with recursive v as") + """, ed as (select study || ':' || a as a, study || ':' || b as b from sh where (exp(2 * z) - 1) / (exp(2 * z) + 1) >= 0.3), eb as (select a, b from ed union select b, a from ed),
wl as (select a as id, a as seen from eb union select wl.id, eb.b from wl join eb on wl.seen = eb.a) select id as ion, min(seen) as first_ion from wl group by id""",
    "q_strongest_distinct": """with recursive f as (select group_id, study, mz, rt, n_detected from aligned_feature_table), ed as (select a.group_id as x, b.group_id as y from f a join f b on a.study = b.study and a.group_id <> b.group_id and abs(a.rt - b.rt) <= 1.0::double and abs(b.mz - a.mz) <= case when a.group_id < b.group_id then a.mz else b.mz end * (2000.0::double / 1e6)),
n as (select group_id as id, row_number() over (order by n_detected desc nulls last, group_id) as k from f), nb as (select n.k, coalesce(list(m.k) filter (m.k < n.k), []) as l from n left join ed on ed.x = n.id left join n m on m.id = ed.y group by n.k),
st as (select 0::bigint as k, []::bigint[] as c union all select nb.k, case when list_has_any(st.c, nb.l) then st.c else list_append(st.c, nb.k) end from st join nb on nb.k = st.k + 1)
select n.id as group_id from n join (select unnest(c) as k from (select c from st order by k desc limit 1)) x on n.k = x.k""",
    "q_coelute_shared": COELUTE.replace("<= 0.02::double", "<= 0.1::double") + ", s as (select distinct group_id, run from filled_mask where filled = 0 and group_id >= 1) select p.a, p.b, count(*) as n_shared from p join s x on p.a = x.group_id join s y on p.b = y.group_id and x.run = y.run group by 1, 2",
    "q_height_correlations": COELUTE.replace("<= 0.02::double", "<= 0.5::double") + f""", h as (select group_id, {RUN_SQL} as run, log10(max(precursor_intensity)) as h from ms2_map where group_id is not null and precursor_intensity > 0 and not isnan(precursor_intensity) and file is not null group by 1, 2),
j as (select p.a, p.b, x.h as x, y.h as y, y.h - x.h as q from p join h x on p.a = x.group_id join h y on p.b = y.group_id and x.run = y.run), m as (select *, median(q) over (partition by a, b) as m from j)
select a, b, count(*) as n, round(case when count(*) >= 6 then covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) end, 6) as r, round(case when count(*) >= 3 then avg(case when abs(q - m) <= 0.30103::double then 1.0::double else 0 end) end, 6) as steady from m group by 1, 2""",
}
