"""Queries that score results against known peaks, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lcspark.operators import truth as t
from lcspark.operators.features import isomer_candidates
from lcspark.operators.traces import RUN_SQL, run_key, valid_points
from lcspark.sources.tables import read

#: Differences that name an ion of a compound.
DELTAS = {"M+1": ("isotope", 1.0033548378), "M+2": ("isotope", 2.0067096756), "Na": ("adduct", 21.981944), "K": ("adduct", 37.955882), "NH4": ("adduct", 17.026549), "-H2O": ("fragment", -18.010565), "-NH3": ("fragment", -17.026549)}
#: m/z tolerance in Da of that naming: the tables' compounds are not built to a formula.
WIDE = 2.0


def r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


def _truth(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "aligned_feature_table").filter("mz is not null and rt is not null").select("study", F.col("group_id").alias("id"), F.col("mz").alias("mz_t"), F.col("rt").alias("rt_t"))


def _found(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "ms2_map").filter("precursor_mz > 0 and not isnan(precursor_mz) and rt_s is not null and not isnan(rt_s)")
    return m.select("study", F.col("map_id").alias("found_id"), F.col("precursor_mz").alias("mz"), (F.col("rt_s") / 60).alias("rt"))


def q_recall_grid(spark: SparkSession, d: str) -> DataFrame:
    """Features of each study that a spectrum stands for, on the grid of tolerances."""
    return t.recall_grid(_truth(spark, d), _found(spark, d), ["study"]).select("study", "ppm", "window", "n_truth", "n_hit", r("recall"))


def q_decoy_grid(spark: SparkSession, d: str) -> DataFrame:
    """The same for features moved by 0.05 Da, which should find nothing."""
    return t.recall_grid(t.decoys(_truth(spark, d)), _found(spark, d), ["study"]).select("study", "ppm", "window", "n_truth", "n_hit", r("recall"))


def q_nearest_truth(spark: SparkSession, d: str) -> DataFrame:
    return t.nearest_truth(_found(spark, d), _truth(spark, d), ["study"]).select("found_id", "id", r("d_rt"))


def q_labelled_partners(spark: SparkSession, d: str) -> DataFrame:
    """Features of a study whole 13C steps apart within 20 ppm and a quarter of a minute."""
    f = _truth(spark, d)
    side = lambda x: f.select("study", F.col("id").alias(x), F.col("mz_t").alias(f"mz_{x}"), F.col("rt_t").alias(f"rt_{x}"))
    return t.labelled_partners(side("a"), side("b"), ["study"], 20.0, 0.25)


def _heights(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "ms2_map").filter("group_id is not null and precursor_intensity > 0 and not isnan(precursor_intensity)")
    return m.select("group_id", "study", run_key(F.col("file")).alias("run"), F.col("precursor_intensity").alias("height")).filter("run is not null")


def q_vial_medians(spark: SparkSession, d: str) -> DataFrame:
    """Median height of each feature in each class of runs of its study, runs without it counting 0."""
    h = _heights(spark, d).withColumn("vial", F.concat_ws("_", F.split_part("run", F.lit("_"), F.lit(1)), F.split_part("run", F.lit("_"), F.lit(2))))
    return t.vial_medians(h, h.select("run", "vial").distinct(), "group_id", "run", "vial", "height").select("group_id", "vial", "n_runs", r("height", 3))


def q_level_slopes(spark: SparkSession, d: str) -> DataFrame:
    """Log-log slope of a feature's height on its number of peaks, over three levels or more."""
    m = read(spark, d, "ms2_map").filter("group_id is not null and not isnan(precursor_intensity)").select("group_id", F.col("n_peaks").cast("double").alias("level"), F.col("precursor_intensity").alias("height"))
    return t.level_slopes(m, "group_id", "level", "height").select("group_id", "n_levels", r("slope"), r("r2"))


def q_count_classes(spark: SparkSession, d: str) -> DataFrame:
    """How the number of detected cells of each feature agrees with its count, by study."""
    cells = read(spark, d, "filled_mask").filter("filled = 0 and group_id >= 1").groupBy("group_id").agg(F.count("*").alias("n"))
    f = read(spark, d, "aligned_feature_table").select("study", "group_id", "n_detected").join(cells, "group_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return f.groupBy("study").agg(F.count("*").alias("n_groups"), *t.count_classes(f, F.col("n_detected"), F.col("n")))


def q_peak_groups(spark: SparkSession, d: str) -> DataFrame:
    """Chains of a compound's features in time, ranked by their summed detections."""
    f = read(spark, d, "aligned_feature_table").filter("compound_id is not null and rt is not null").select("compound_id", F.col("group_id").alias("id"), "rt", F.coalesce("n_detected", F.lit(0)).alias("height"))
    return t.peak_groups(f, "compound_id", 0.5).select("compound_id", F.col("id").alias("group_id"), F.col("chain").cast("int").alias("chain"), "place")


def q_ion_names(spark: SparkSession, d: str) -> DataFrame:
    f = read(spark, d, "aligned_feature_table").filter("compound_id is not null and mz is not null").select("compound_id", F.col("group_id").alias("id"), "mz", F.coalesce("n_detected", F.lit(0)).alias("height"))
    return t.annotated(f, "compound_id", DELTAS, wide=WIDE).select(F.col("id").alias("group_id"), F.col("base").alias("base_id"), "name", "kind")


def q_both_apexes(spark: SparkSession, d: str) -> DataFrame:
    """Whether both members of each pair of isomers have a spectrum of their own."""
    p = isomer_candidates(read(spark, d, "aligned_feature_table")).select("study", F.concat_ws("-", "a", "b").alias("pair"), F.col("mz_a").alias("mz_t"), F.col("rt_a").alias("rt_1"), F.col("rt_b").alias("rt_2"))
    return t.both_apexes(p, _found(spark, d), ["study"])


def q_run_summary(spark: SparkSession, d: str) -> DataFrame:
    """What the tables hold of each run: scans, centroids, spectra, features, filled cells; the runs' own table order joined from all of them."""
    s = read(spark, d, "scans").groupBy("run").agg(F.countDistinct("scan").alias("n_scans"), F.max("rt").alias("last_rt"))
    p = valid_points(read(spark, d, "points")).groupBy("run").agg(F.count("*").alias("n_points"), F.max("inten").alias("strongest"))
    m = read(spark, d, "ms2_map").withColumn("run", run_key(F.col("file"))).filter("run is not null").groupBy("run").agg(F.count("*").alias("n_spectra"), F.countDistinct("group_id").alias("n_groups"), F.count_if(F.col("group_id").isNull()).alias("n_unassigned"))
    c = read(spark, d, "filled_mask").groupBy("run").agg(F.sum("filled").alias("n_filled"), F.count("*").alias("n_cells"))
    return t.run_summary({"s": s, "p": p, "m": m, "c": c})


def q_ratio_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Spread of each study's height ratios between two spectra of one feature in neighbouring runs, about their median, in log10."""
    h = _heights(spark, d).groupBy("study", "group_id", "run").agg(F.max("height").alias("h"))
    a, b = h.select("study", "group_id", F.col("run").alias("run_a"), F.log10("h").alias("x")), h.select("study", "group_id", F.col("run").alias("run_b"), F.log10("h").alias("y"))
    j = a.join(b, ["study", "group_id"]).filter("run_a < run_b").withColumn("q", F.col("y") - F.col("x"))
    m = j.groupBy("study", "run_a", "run_b").agg(F.median("q").alias("m"))
    return j.join(m, ["study", "run_a", "run_b"]).groupBy("study", "run_a", "run_b").agg(F.count("*").alias("n"), F.round(F.first("m"), 6).alias("ratio"), F.round(F.avg((F.abs(F.col("q") - F.col("m")) <= 0.30103).cast("double")), 6).alias("within_two"))


def q_f1(spark: SparkSession, d: str) -> DataFrame:
    """Recall, precision and F1 of calling a hit right by its score, at several cuts."""
    h = read(spark, d, "identifications").filter("score is not null and not isnan(score)").select((F.abs("ppm_error") <= 10).alias("t"), "score", F.explode(F.array(*[F.lit(x / 10) for x in range(1, 10)])).alias("cut"))
    ok = F.coalesce(F.col("t"), F.lit(False))
    g = h.groupBy("cut").agg(F.count_if(ok & (F.col("score") >= F.col("cut"))).alias("tp"), F.count_if(ok & (F.col("score") < F.col("cut"))).alias("fn"), F.count_if(~ok & (F.col("score") >= F.col("cut"))).alias("fp"))
    return g.select("cut", "tp", "fn", "fp", F.round(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6).alias("f1"))


QUERIES = {k: f for k, f in globals().items() if k.startswith("q_")}

TRUTH = "with tr as (select study, group_id as id, mz as mz_t, rt as rt_t from aligned_feature_table where mz is not null and rt is not null), fd as (select study, map_id as found_id, precursor_mz as mz, rt_s / 60 as rt from ms2_map where precursor_mz > 0 and isfinite(precursor_mz) and isfinite(rt_s))"
_GRID = """, gr as (select p as ppm, w as "window" from unnest([5.0::double, 10, 20]) t(p), unnest([0.05::double, 0.1, 0.2]) u(w)), n as (select study, count(*) as n_truth from {s} group by study),
j as (select {s}.study, {s}.id, mz_t, abs(mz - mz_t) / mz_t * 1e6 as o, abs(rt - rt_t) as l from {s} join fd on {s}.study = fd.study and abs(mz - mz_t) <= mz_t * 20.1::double / 1e6 and abs(rt - rt_t) <= 0.2::double),
h as (select study, ppm, "window", count(distinct (id, mz_t)) as n_hit from j join gr on o <= ppm and l <= "window" group by 1, 2, 3)
select n.study, gr.ppm, gr."window", n_truth, cast(coalesce(n_hit, 0) as bigint) as n_hit, round(coalesce(n_hit, 0) / n_truth, 6) as recall from n cross join gr left join h on h.study = n.study and h.ppm = gr.ppm and h."window" = gr."window" """
HEIGHTS = f"with h as (select group_id, study, {RUN_SQL} as run, precursor_intensity as height from ms2_map where group_id is not null and precursor_intensity > 0 and isfinite(precursor_intensity) and file is not null)"
_NAMES = ", ".join(f"('{n}', '{k}', {v!r}::double)" for n, (k, v) in DELTAS.items())
ORACLES = {
    "q_recall_grid": TRUTH + _GRID.format(s="tr"),
    "q_decoy_grid": TRUTH + ", dc as (select study, id, mz_t + s as mz_t, rt_t from tr, unnest([-0.05::double, 0.05]) x(s))" + _GRID.format(s="dc"),
    "q_nearest_truth": TRUTH + " select found_id, id, round(rt_t - rt, 6) as d_rt from fd join tr on fd.study = tr.study and abs(mz_t - mz) <= mz * (10.0::double / 1e6) and abs(rt - rt_t) <= 0.5::double qualify row_number() over (partition by found_id order by abs(rt_t - rt), id) = 1",
    "q_labelled_partners": TRUTH + """, l as (select study, id as a, mz_t, rt_t, unnest(range(1, least(cast(floor(mz_t / 12) as bigint), 60) + 1)) as n from tr where mz_t >= 12), x as (select *, mz_t + n * 1.0033548378::double as above from l)
select x.a, tr.id as b, cast(x.n as integer) as n_carbons from x join tr on x.study = tr.study and abs(tr.mz_t - above) <= above * (20.0::double / 1e6) and abs(x.rt_t - tr.rt_t) <= 0.25 qualify row_number() over (partition by x.a, tr.id order by abs(tr.mz_t - above), n) = 1""",
    "q_vial_medians": HEIGHTS + """, v as (select *, split_part(run, '_', 1) || '_' || split_part(run, '_', 2) as vial from h), d as (select distinct run, vial from v), g as (select distinct group_id, vial from v), m as (select group_id, run, max(height) as height from v group by 1, 2)
select g.group_id, g.vial, count(*) as n_runs, round(median(coalesce(m.height, 0)), 3) as height from g join d on g.vial = d.vial left join m on m.group_id = g.group_id and m.run = d.run group by 1, 2""",
    "q_level_slopes": """with m as (select group_id, log10(n_peaks) as x, log10(precursor_intensity) as y from ms2_map where group_id is not null and n_peaks > 0 and precursor_intensity > 0 and not isnan(precursor_intensity))
select group_id, count(distinct x) as n_levels, round(regr_slope(y, x), 6) as slope, round(regr_r2(y, x), 6) as r2 from m group by group_id having count(distinct x) >= 3""",
    "q_count_classes": """with c as (select group_id, count(*) as n from filled_mask where filled = 0 and group_id >= 1 group by group_id), f as (select study, n_detected as t, coalesce(c.n, 0) as n from aligned_feature_table a left join c on a.group_id = c.group_id)
select study, count(*) as n_groups, count(*) filter (n = t) as correct, count(*) filter (n = 0 and t > 0) as missed, count(*) filter (n < t and n > 0) as merged, count(*) filter (n > t) as extra from f group by study""",
    "q_peak_groups": """with f as (select compound_id, group_id, rt, coalesce(n_detected, 0) as h from aligned_feature_table where compound_id is not null and rt is not null), n as (select *, case when rt - lag(rt) over w <= 0.5 then 0 else 1 end as new from f window w as (partition by compound_id order by rt, group_id)),
c as (select *, cast(sum(new) over (partition by compound_id order by rt, group_id) as integer) as chain from n), p as (select compound_id, chain, cast(row_number() over (partition by compound_id order by sum(h) desc, chain) as integer) as place from c group by 1, 2)
select c.compound_id, c.group_id, c.chain, p.place from c join p on c.compound_id = p.compound_id and c.chain = p.chain""",
    "q_ion_names": f"""with f as (select compound_id, group_id, mz, coalesce(n_detected, 0) as h from aligned_feature_table where compound_id is not null and mz is not null), b as (select compound_id, group_id as base, mz as mb from f qualify row_number() over (partition by compound_id order by h desc, group_id) = 1),
k as (select * from (values {_NAMES}) t(name, kind, v)), d as (select f.group_id, b.base, f.mz, f.mz - b.mb as d from f join b on f.compound_id = b.compound_id),
n as (select d.group_id, k.name, k.kind from d join k on abs(d.d - k.v) <= greatest(d.mz * (10.0::double / 1e6), {WIDE!r}::double) qualify row_number() over (partition by d.group_id order by abs(d.d - k.v), k.name) = 1)
select d.group_id, d.base as base_id, case when d.group_id <> d.base then n.name end as name, case when d.group_id = d.base then 'base' when n.kind is not null then n.kind when d.d < 0 then 'fragment' else 'other' end as kind from d left join n on d.group_id = n.group_id""",
    "q_both_apexes": TRUTH + """, p as (select a.study, a.group_id || '-' || b.group_id as pair, a.mz as mz_t, a.rt as r1, b.rt as r2 from aligned_feature_table a join aligned_feature_table b on a.study = b.study and a.group_id < b.group_id and abs(b.mz - a.mz) <= a.mz * (10.0::double / 1e6) and abs(a.rt - b.rt) > 0 and abs(a.rt - b.rt) <= (a.rt_max - a.rt_min) / 2 + (b.rt_max - b.rt_min) / 2),
j as (select p.pair, abs(rt - r1) < abs(rt - r2) as f from p join fd on p.study = fd.study and abs(mz_t - mz) <= mz * (10.0::double / 1e6) and least(abs(rt - r1), abs(rt - r2)) < abs(r2 - r1) / 2)
select p.pair, coalesce(max(cast(f as integer)), 0) as first, coalesce(max(cast(not f as integer)), 0) as second from p left join j on p.pair = j.pair group by p.pair""",
    "q_run_summary": f"""with s as (select run, count(distinct scan) as n_scans, max(rt) as last_rt from scans group by run), p as (select run, count(*) as n_points, max(cast(inten as double)) as strongest from points where inten > 0 and isfinite(inten) and mz > 0 and isfinite(mz) group by run),
m as (select {RUN_SQL} as run, count(*) as n_spectra, count(distinct group_id) as n_groups, count(*) filter (group_id is null) as n_unassigned from ms2_map where file is not null group by 1), c as (select run, cast(sum(filled) as bigint) as n_filled, count(*) as n_cells from filled_mask group by run),
a as (select run from s union select run from p union select run from m union select run from c) select a.run, n_scans, last_rt, n_points, strongest, n_spectra, n_groups, n_unassigned, n_filled, n_cells from a left join s on a.run = s.run left join p on a.run = p.run left join m on a.run = m.run left join c on a.run = c.run""",
    "q_ratio_accuracy": HEIGHTS + """, g as (select study, group_id, run, log10(max(height)) as h from h group by 1, 2, 3), j as (select a.study, a.run as run_a, b.run as run_b, b.h - a.h as q from g a join g b on a.study = b.study and a.group_id = b.group_id and a.run < b.run), m as (select *, median(q) over (partition by study, run_a, run_b) as m from j)
select study, run_a, run_b, count(*) as n, round(any_value(m), 6) as ratio, round(avg(case when abs(q - m) <= 0.30103::double then 1.0::double else 0 end), 6) as within_two from m group by 1, 2, 3""",
    "q_f1": """with h as (select coalesce(abs(ppm_error) <= 10, false) as t, score, k / 10.0::double as cut from identifications, unnest(range(1, 10)) x(k) where score is not null and not isnan(score)), g as (select cut, count(*) filter (t and score >= cut) as tp, count(*) filter (t and score < cut) as fn, count(*) filter (not t and score >= cut) as fp from h group by cut)
select *, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) as f1 from g""",
}
