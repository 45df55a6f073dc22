"""Queries on gains, shifts and pieces of scans, merged groups and wide tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lcspark.operators import compounds, shape
from lcspark.operators import scans as s
from lcspark.operators.traces import RUN_SQL, run_key, valid_points
from lcspark.plans.graphs import KNOTS
from lcspark.plans.shape import CAND, DENSE, dense
from lcspark.sources.tables import read


def r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


def q_half_widths(spark: SparkSession, d: str) -> DataFrame:
    t = dense(spark, d)
    # what lies halfway between two digits is moved to one side
    return s.half_widths(t, shape.candidates(t)).select("run", "group_id", "block", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("left", "right")])


def q_scan_gains(spark: SparkSession, d: str) -> DataFrame:
    return s.scan_gains(dense(spark, d)).select("run", "scan", "n", r("gain"))


def q_scan_shifts(spark: SparkSession, d: str) -> DataFrame:
    return s.scan_shifts(dense(spark, d)).select("run", "scan", "n", r("a", 4), r("b", 3), r("chi2", 4), "jumped")


def q_corrected_mz(spark: SparkSession, d: str) -> DataFrame:
    """Centroids moved by the correction of jumped scans, by run: how many, and how far."""
    p = valid_points(read(spark, d, "points"))
    c = s.corrected_mz(p.withColumn("before", F.col("mz")), s.scan_shifts(dense(spark, d)))
    return c.groupBy("run").agg(F.count("*").alias("n"), F.sum("moved").alias("n_moved"), F.round(F.coalesce(F.avg(F.when(F.col("moved") == 1, F.abs(F.col("mz") / F.col("before") - 1) * 1e6)), F.lit(0.0)), 4).alias("mean_ppm"))


def q_saturation(spark: SparkSession, d: str) -> DataFrame:
    return s.saturation_factors(dense(spark, d)).select("run", "quarter", "n", r("factor"))


def q_peak_seeds(spark: SparkSession, d: str) -> DataFrame:
    return s.peak_seeds(dense(spark, d)).select("run", "group_id", "scan", r("height", 3), r("prominence", 3))


def q_cut_pieces(spark: SparkSession, d: str) -> DataFrame:
    return s.cut_pieces(read(spark, d, "points"), shape.candidates(dense(spark, d)))


def q_complementary(spark: SparkSession, d: str) -> DataFrame:
    """Groups of one ion that share no run, merged; by the runs of their spectra, and a tenth of a percent in m/z."""
    m = read(spark, d, "ms2_map").filter("group_id is not null").select("group_id", run_key(F.col("file")).alias("run")).filter("run is not null").distinct()
    return s.merge_complementary(read(spark, d, "aligned_feature_table"), m, 1000.0, 1.0)


def q_wide_cells(spark: SparkSession, d: str) -> DataFrame:
    """Filled cells of each row, wide: a column for each of the twelve runs of a study in order of name."""
    m = read(spark, d, "filled_mask")
    runs = m.select("run").distinct().withColumn("k", F.row_number().over(Window.partitionBy(F.split_part("run", F.lit("_"), F.lit(1))).orderBy("run")))
    t = m.join(runs, "run").groupBy("row_no").pivot("k", list(range(1, 13))).agg(F.max("filled").cast("int"))
    return t.select("row_no", *[F.col(str(k)).alias(f"r{k}") for k in range(1, 13)])


def q_warp_inverse(spark: SparkSession, d: str) -> DataFrame:
    """Native times of aligned ones: each run's warp read backwards."""
    a = read(spark, d, "ms2_map").select(run_key(F.col("file")).alias("file"), F.col("map_id").alias("id"), F.col("rt_s").alias("native"), F.col("rt_aligned_s").alias("corr"))
    k = compounds.warp_knots(a).select("file", "knot", F.col("rt_corr").alias("rt_native"), F.col("rt_native").alias("rt_corr"))
    return compounds.warp_apply(a.select("file", "id", F.col("corr").alias("native")).filter("native is not null and not isnan(native)"), k).select(F.col("id").alias("map_id"), F.round("corr", 6).alias("rt_native"))


def q_distinct_formulas(spark: SparkSession, d: str) -> DataFrame:
    """The formulas that the hits of a feature's best copies name, each once, in order."""
    h = read(spark, d, "identifications").filter("group_id is not null and formula is not null and score > 0.5 and not isnan(score)")
    return h.groupBy("group_id").agg(F.array_join(F.array_sort(F.collect_set("formula")), ";").alias("formulas"))


def q_presence_replicates(spark: SparkSession, d: str) -> DataFrame:
    """Features that all but one of the runs of a class detect, of classes of three runs or more."""
    m = read(spark, d, "filled_mask").filter("group_id >= 1").withColumn("class", F.concat_ws("_", F.split_part("run", F.lit("_"), F.lit(1)), F.split_part("run", F.lit("_"), F.lit(2))))
    n = m.groupBy("class").agg(F.countDistinct("run").alias("n_runs"))
    c = m.filter("filled = 0").groupBy("group_id", "class").agg(F.countDistinct("run").alias("n"))
    return c.join(n, "class").filter((F.col("n_runs") >= 3) & (F.col("n") >= F.greatest(F.lit(2), F.col("n_runs") - 1))).select("group_id", "class", "n", "n_runs")


QUERIES = {k: f for k, f in globals().items() if k.startswith("q_")}

_MD = ", mq as (select run, group_id, median(mz) as m from dn where inten > 0 group by 1, 2), dq as (select dn.run, dn.group_id, dn.scan, dn.inten, m, (mz / m - 1) * 1e6 as d from dn join mq on dn.run = mq.run and dn.group_id = mq.group_id where inten > 0)"
SHIFTS = DENSE + _MD + """, sq as (select run, group_id, greatest(1.4826::double * median(abs(d)), 0.1) as s from dq group by 1, 2), wq as (select dq.run, dq.scan, d, 1 / (s * s) as w, 1 / sqrt(m) as x from dq join sq on dq.run = sq.run and dq.group_id = sq.group_id),
gq as (select run, scan, count(*) as n, sum(w) as w, sum(w * x) as wx, sum(w * x * x) as wxx, sum(w * d) as wd, sum(w * x * d) as wxd from wq group by 1, 2 having count(*) >= 12), bq as (select *, coalesce((w * wxd - wx * wd) / nullif(w * wxx - wx * wx, 0), 0) as b from gq),
aq as (select *, (wd - b * wx) / w as a from bq), shq as (select run, scan, n, a, b, a * wd + b * wxd as chi2, cast(a * wd + b * wxd > 2 * ln(count(*) over (partition by run) / 0.01::double) as integer) as jumped from aq)"""
ORACLES = {
    "q_half_widths": DENSE + CAND + """, z as (select dn.*, c.scan_apex, c.height, lead(dn.minutes) over w as mn, lead(dn.inten) over w as i2, lag(dn.minutes) over w as mp, lag(dn.inten) over w as i0 from dn join cd c on dn.run = c.run and dn.group_id = c.group_id and dn.block = c.block window w as (partition by dn.run, dn.group_id, dn.block order by dn.scan)),
x as (select run, group_id, block, scan, scan_apex, minutes + (mn - minutes) * (height / 2 - inten) / nullif(i2 - inten, 0) as l, minutes + (mp - minutes) * (height / 2 - inten) / nullif(i0 - inten, 0) as r, inten < height / 2 as below from z)
select run, group_id, block, round(arg_max(l, scan) filter (below and scan < scan_apex) + 1e-9, 6) as left, round(arg_min(r, scan) filter (below and scan > scan_apex) + 1e-9, 6) as right from x group by 1, 2, 3""",
    "q_scan_gains": DENSE + """, y as (select run, group_id, scan, ln(inten) as y, median(ln(inten)) over (partition by run, group_id) as m from dn where inten > 0) select run, scan, count(*) as n, round(exp(median(y - m)), 6) as gain from y group by 1, 2 having count(*) >= 5""",
    "q_scan_shifts": SHIFTS + " select run, scan, n, round(a, 4) as a, round(b, 3) as b, round(chi2, 4) as chi2, jumped from shq",
    "q_corrected_mz": SHIFTS + """, rn as (select run from shq where jumped = 1 group by run having count(*) >= 3), jq as (select shq.* from shq join rn on shq.run = rn.run where jumped = 1), mv as (select v.run, v.mz, jq.a, case when jq.a is not null then v.mz / (1 + (jq.a + jq.b / sqrt(v.mz)) * 1e-6) else v.mz end as x from v left join jq on v.run = jq.run and v.scan = jq.scan)
select run, count(*) as n, cast(count(a) as bigint) as n_moved, round(coalesce(avg(case when a is not null then abs(x / mz - 1) * 1e6 end), 0), 4) as mean_ppm from mv group by run""",
    "q_saturation": DENSE + _MD + """, t as (select run, log10(max(inten)) as t from dn where inten > 0 group by run), q as (select dq.run, cast(floor((t - log10(inten)) * 4) as integer) as quarter, abs(d) as d from dq join t on dq.run = t.run), u as (select run, median(d) as u from q where quarter >= 4 group by run),
g as (select run, quarter, count(*) as n, median(d) as d from q where quarter < 4 group by 1, 2 having count(*) >= 10) select g.run, quarter, n, round(greatest(coalesce(d / nullif(u, 0), 1), 1), 6) as factor from g join u on g.run = u.run""",
    "q_peak_seeds": DENSE + """, m3 as (select run, group_id, scan, (coalesce(lag(inten) over w, 0) + inten + coalesce(lead(inten) over w, 0)) / 3 as s, sum(cast(inten > 0 as integer)) over (partition by run, group_id order by scan rows between 3 preceding and 3 following) as n from dn window w as (partition by run, group_id order by scan)),
tq as (select * from (select *, lag(s) over w as u, lead(s) over w as dd from m3 window w as (partition by run, group_id order by scan)) where s > coalesce(u, -1) and s >= coalesce(dd, -1) and n >= 4 and s > 0),
nr as (select t.run, t.group_id, t.scan as pk, t.s as top, x.scan, x.s, max(case when x.s > t.s and x.scan < t.scan then x.scan end) over k as wl, min(case when x.s > t.s and x.scan > t.scan then x.scan end) over k as wr from tq t join m3 x on t.run = x.run and t.group_id = x.group_id and x.scan between t.scan - 16 and t.scan + 16 window k as (partition by t.run, t.group_id, t.scan)),
pr as (select run, group_id, pk, any_value(top) as top, any_value(top) - greatest(min(s) filter (scan <= pk and (wl is null or scan > wl)), min(s) filter (scan >= pk and (wr is null or scan < wr))) as p from nr group by 1, 2, 3)
select run, group_id, pk as scan, round(top, 3) as height, round(p, 3) as prominence from pr where p >= 0.3::double * top""",
    "q_cut_pieces": DENSE + CAND + """, ce as (select *, case when scan_apex = scan_lo then scan_lo - 1 when scan_apex = scan_hi then scan_hi + 1 end as s from cd)
select ce.run, ce.group_id, ce.block, max(v.inten) as beyond from ce join v on v.run = ce.run and v.scan = ce.s and abs(v.mz - ce.mz) <= ce.mz * (30.0::double / 1e6) group by ce.run, ce.group_id, ce.block, ce.height having max(v.inten) > ce.height""",
    "q_wide_cells": "with k as (select run, row_number() over (partition by split_part(run, '_', 1) order by run) as k from (select distinct run from filled_mask)) select row_no, " + ", ".join(f"cast(max(filled) filter (k.k = {n}) as integer) as r{n}" for n in range(1, 13)) + " from filled_mask m join k on m.run = k.run group by row_no",
    "q_warp_inverse": KNOTS.replace("ms2_map", f"(select * replace ({RUN_SQL} as file) from ms2_map)") + f""", x as (select file, knot, c as n, n as c from k), s as (select file, n, c, lead(n) over w as n2, lead(c) over w as c2, first_value(n) over w as n0, first_value(c) over w as c0 from x window w as (partition by file order by n)),
f as (select file, any_value(n0) as n0, any_value(c0) as c0 from s group by file), m as (select map_id, {RUN_SQL} as file, rt_aligned_s as t from ms2_map where rt_aligned_s is not null and not isnan(rt_aligned_s))
select m.map_id, round(case when s.n2 is not null then s.c + (m.t - s.n) * (s.c2 - s.c) / (s.n2 - s.n) when s.n is not null then m.t + s.c - s.n when f.n0 is not null then m.t + f.c0 - f.n0 else m.t end, 6) as rt_native from m asof left join s on m.file = s.file and m.t >= s.n left join f on m.file = f.file""",
    "q_distinct_formulas": "select group_id, string_agg(formula, ';' order by formula) as formulas from (select distinct group_id, formula from identifications where group_id is not null and formula is not null and score > 0.5 and not isnan(score)) group by group_id",
    "q_presence_replicates": """with m as (select *, split_part(run, '_', 1) || '_' || split_part(run, '_', 2) as class from filled_mask where group_id >= 1), n as (select class, count(distinct run) as n_runs from m group by 1), c as (select group_id, class, count(distinct run) as n from m where filled = 0 group by 1, 2)
select c.group_id, c.class, c.n, n.n_runs from c join n on c.class = n.class where n.n_runs >= 3 and c.n >= greatest(2, n.n_runs - 1)""",
}
