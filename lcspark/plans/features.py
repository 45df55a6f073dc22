"""Queries on features, their members and their presence over runs, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lcspark.operators import features as f
from lcspark.operators import stats
from lcspark.operators.impute import fill_block_groups
from lcspark.operators.traces import by_run, run_key
from lcspark.session import materialise, small
from lcspark.sources.tables import read


def _features(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "aligned_feature_table")


def _ms2(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "ms2_map")


def r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


def q_consensus(spark: SparkSession, d: str) -> DataFrame:
    m = _ms2(spark, d).select("group_id", F.col("precursor_mz").alias("mz"), F.col("rt_s").alias("rt"), F.col("precursor_intensity").alias("height"), F.col("map_id").alias("id"))
    return f.consensus(m).select("group_id", "n_detected", "mz", r("rt"), r("mz_ppm_spread"), r("rt_sd"))


def q_mad(spark: SparkSession, d: str) -> DataFrame:
    return stats.mad(_ms2(spark, d).filter("group_id is not null"), ["group_id"], "rt_s").select("group_id", r("median"), r("mad"))


def q_loo_median(spark: SparkSession, d: str) -> DataFrame:
    return stats.loo_median(_ms2(spark, d).filter("group_id is not null and rt_s is not null").select("map_id", "group_id", "rt_s"), ["group_id"], "rt_s", "map_id").select("map_id", r("loo"))


def q_mode(spark: SparkSession, d: str) -> DataFrame:
    return stats.mode(_features(spark, d).filter("compound_id is not null"), ["compound_id"], "charge")


def q_presence(spark: SparkSession, d: str) -> DataFrame:
    """Presence over the runs without the blanks."""
    return f.presence(read(spark, d, "filled_mask"), F.col("run").contains("_blk_"))


def q_filled_runs(spark: SparkSession, d: str) -> DataFrame:
    """The gap-filled files of each row as text."""
    m = read(spark, d, "filled_mask").filter("filled = 1")
    return m.groupBy("row_no").agg(F.array_join(F.array_sort(F.collect_set("run")), ";").alias("gap_filled_files"))


def q_pivot_class(spark: SparkSession, d: str) -> DataFrame:
    """Filled cells of each row by class of run, wide."""
    m = read(spark, d, "filled_mask").withColumn("class", F.split_part("run", F.lit("_"), F.lit(2)))
    return m.groupBy("row_no").pivot("class", ["smp", "qc", "blk", "std"]).agg(F.sum("filled")).select("row_no", "smp", "qc", "blk", "std")


def q_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark, d).rollup("study", "charge").agg(F.count("*").alias("n"), F.round(F.avg("n_detected"), 6).alias("mean_detected"))


def q_cube(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark, d).cube("iso_offset", "charge").agg(F.count("*").alias("n"), F.countDistinct("compound_id").alias("n_compounds"))


def q_isolated(spark: SparkSession, d: str) -> DataFrame:
    return f.isolated(_features(spark, d)).select("group_id")


def q_mutual_unique(spark: SparkSession, d: str) -> DataFrame:
    """Features of neighbouring studies that are each other's only match within 500 ppm and a minute: studies of other calibrations."""
    t = _features(spark, d).withColumn("n", F.substring("study", 3, 9).cast("int"))
    a = t.select(F.col("group_id").alias("a"), F.col("n").alias("key"), F.col("mz").alias("mz_a"), F.col("rt").alias("rt_a"))
    b = t.select(F.col("group_id").alias("b"), (F.col("n") - 1).alias("key"), F.col("mz").alias("mz_b"), F.col("rt").alias("rt_b"))
    return f.mutual_matches(a, b, 500.0, 1.0).select("a", "b", r("drt"))


def q_isotopes(spark: SparkSession, d: str) -> DataFrame:
    """Parents one to three isotope steps below, by nominal mass and half a minute."""
    return f.possible_isotopes(_features(spark, d), 1000.0, 0.5)


def q_isomers(spark: SparkSession, d: str) -> DataFrame:
    return f.isomer_candidates(_features(spark, d)).select("study", "a", "b", F.round(F.abs(F.col("rt_a") - F.col("rt_b")) * 60, 6).alias("gap_s"))


def q_codetect(spark: SparkSession, d: str) -> DataFrame:
    """Runs in which both features of an isomer pair were detected, not filled."""
    seen = read(spark, d, "filled_mask").filter("filled = 0 and group_id >= 1").select("group_id", "run").distinct()
    p = f.isomer_candidates(_features(spark, d)).select("a", "b")
    both = p.join(seen.select(F.col("group_id").alias("a"), "run"), "a").join(seen.select(F.col("group_id").alias("b"), "run"), ["b", "run"])
    return p.join(both.groupBy("a", "b").agg(F.count("*").alias("n")), ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n_codetected"))


def seen(spark: SparkSession, d: str) -> DataFrame:
    """``(group_id, run, rt)``: the cells detected, not filled, blocks' missing groups filled; ``rt`` is the aligned minute of the run's MS2 spectrum of
    the feature with the most intense precursor, the only time that the tables give for a feature in a run; null without one."""
    cells = fill_block_groups(read(spark, d, "filled_mask")).filter("filled = 0 and group_id >= 1").select("group_id", "run").distinct()
    m = _ms2(spark, d).filter("group_id is not null and rt_aligned_s is not null and not isnan(rt_aligned_s) and precursor_intensity > 0 and not isnan(precursor_intensity)")
    top = F.max(F.struct("precursor_intensity", (-F.col("map_id")).alias("k"), (F.col("rt_aligned_s") / 60).alias("rt")))
    m = m.withColumn("run", run_key(F.col("file"))).groupBy("group_id", "run").agg(top.alias("_b")).select("group_id", "run", F.col("_b.rt").alias("rt"))
    return materialise(cells.join(m, ["group_id", "run"], "left"))


def q_codetect_whole(spark: SparkSession, d: str) -> DataFrame:
    """Isomer pairs proven by shared runs, order and gap."""
    p = f.proven_pairs(_features(spark, d), seen(spark, d))
    return p.select("a", "b", "n_codetected", "n_timed", r("share"), F.round(F.col("gap") * 60, 6).alias("gap_s"))


def q_coelute(spark: SparkSession, d: str) -> DataFrame:
    """How many co-eluting partners each feature has."""
    p = f.coeluting(_features(spark, d))
    return p.select(F.explode(F.array("a", "b")).alias("group_id")).groupBy("group_id").agg(F.count("*").alias("n"))


def q_relations(spark: SparkSession, d: str) -> DataFrame:
    """Known differences, by nominal mass, of features that elute within a tenth of a minute."""
    return f.mass_relations(f.coeluting(_features(spark, d), 0.1), 1000.0)


def q_strata(spark: SparkSession, d: str) -> DataFrame:
    """Anchors: the twenty best detected features in each of twenty time bins of a study."""
    t = _features(spark, d).select("study", "group_id", "rt", "n_detected", "mz").filter("rt is not null")
    ends = t.groupBy("study").agg(F.min("rt").alias("_lo"), F.max("rt").alias("_hi"))
    t = t.join(small(ends), "study").withColumn("bin", F.least(F.floor(20 * F.coalesce(F.try_divide(F.col("rt") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))), F.lit(19)).cast("int"))
    w = Window.partitionBy("study", "bin").orderBy(F.col("n_detected").desc(), "group_id")
    return t.withColumn("k", F.row_number().over(w)).filter("k <= 20").select("study", "bin", "k", "group_id")


def q_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark, d).groupBy("study", "n_detected").agg(F.count("*").alias("n"))


def q_feature_filter(spark: SparkSession, d: str) -> DataFrame:
    """The feature list under a conjunction of its filters, sorted by m/z."""
    t = _features(spark, d).filter("mz between 200 and 900 and rt between 2 and 12 and iso_offset = 0 and possible_halogen in ('yes', 'maybe')")
    return t.select("group_id", "mz", "rt", "possible_halogen").orderBy(F.col("mz").asc_nulls_last(), "group_id")


def q_mass_error(spark: SparkSession, d: str) -> DataFrame:
    """Spread of the precursor's m/z error by half decade of intensity, the input of the error model sd² = a² + b² / I."""
    m = _ms2(spark, d).filter("precursor_intensity > 0 and precursor_mz > 0").join(_features(spark, d).select("group_id", "mz"), "group_id")
    m = m.select(((F.col("precursor_mz") / F.col("mz") - 1) * 1e6).alias("ppm"), F.floor(2 * F.log10("precursor_intensity")).cast("int").alias("bin"), F.col("precursor_intensity").alias("i"))
    g = m.filter("abs(ppm) < 50").groupBy("bin").agg(F.count("*").alias("n"), F.round(F.stddev_samp("ppm"), 6).alias("sd_ppm"), F.round(F.median("ppm"), 6).alias("median_ppm"))
    return g.filter("n >= 20")


def q_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Median m/z error in ten bins of equal count per study."""
    m = _ms2(spark, d).filter("precursor_mz > 0").join(_features(spark, d).select("group_id", "mz"), "group_id")
    m = m.select("study", "map_id", "precursor_mz", ((F.col("precursor_mz") / F.col("mz") - 1) * 1e6).alias("ppm")).filter("abs(ppm) < 50")
    m = m.withColumn("bin", F.ntile(10).over(Window.partitionBy("study").orderBy("precursor_mz", "map_id")))
    return m.groupBy("study", "bin").agg(F.count("*").alias("n"), F.round(F.median("ppm"), 6).alias("ppm"))


def q_slopes(spark: SparkSession, d: str) -> DataFrame:
    """Log-log slope and R² of the ion current on the precursor's intensity."""
    m = _ms2(spark, d).filter("tic > 0 and precursor_intensity > 0 and not isnan(tic) and not isnan(precursor_intensity)").select("study", F.log10("tic").alias("y"), F.log10("precursor_intensity").alias("x"))
    return m.groupBy("study").agg(F.count("*").alias("n"), F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.regr_r2("y", "x"), 6).alias("r2"))


def _spearman(spark: SparkSession, d: str, run: Column) -> DataFrame:
    m = _ms2(spark, d).filter("precursor_intensity is not null and not isnan(precursor_intensity)")
    return stats.spearman(m.select("study", run.alias("file"), "n_peaks", "precursor_intensity"), ["study", "file"], "n_peaks", "precursor_intensity").select("study", "file", r("rho"), "n")


def q_spearman(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation in each file as it is written."""
    return _spearman(spark, d, F.col("file"))


def q_spearman_whole(spark: SparkSession, d: str) -> DataFrame:
    """q_spearman with every spelling of ``file`` as its run."""
    return _spearman(spark, d, run_key(F.col("file")))


def q_union_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs by the tables they occur in: unions, intersections and differences of the run lists."""
    s, p, m = (read(spark, d, t).select(F.col(c).alias("run")) for t, c in (("scans", "run"), ("points", "run"), ("filled_mask", "run")))
    label = lambda x, name: x.select("run", F.lit(name).alias("part"))
    return label(s.union(m).distinct(), "any").union(label(s.intersect(m), "both")).union(label(p.distinct().join(m.distinct(), "run", "left_anti"), "not_aligned"))


def q_group_members(spark: SparkSession, d: str) -> DataFrame:
    """Cross-run groups of all MS2 precursors as features; a respelled ``file`` is no other run."""
    m = _ms2(spark, d).filter("precursor_mz > 0 and rt_s is not null").select("study", F.col("map_id").alias("member_id"), run_key(F.col("file")).alias("run"), F.col("precursor_mz").alias("mz"), (F.col("rt_s") / 60).alias("rt"), F.lit(0.1).alias("width"), F.coalesce("precursor_intensity", F.lit(0.0)).alias("height"))
    return f.group_members(m.filter("not isnan(mz) and not isnan(height)"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}

PAIRS = "with p as (select a.study, a.group_id as a, b.group_id as b, abs(a.rt - b.rt) as gap from aligned_feature_table a join aligned_feature_table b on a.study = b.study and a.group_id < b.group_id and abs(b.mz - a.mz) <= a.mz * (10.0::double / 1e6) and abs(a.rt - b.rt) > 0 and abs(a.rt - b.rt) <= (a.rt_max - a.rt_min) / 2 + (b.rt_max - b.rt_min) / 2)"
COELUTE = """with p as (select a.study, a.group_id as a, b.group_id as b, a.mz as mz_a, b.mz as mz_b from aligned_feature_table a join aligned_feature_table b on a.study = b.study and a.group_id < b.group_id and abs(a.rt - b.rt) <= 0.02::double
  and least(a.rt_max, b.rt_max) - greatest(a.rt_min, b.rt_min) >= 0.5 * least(a.rt_max - a.rt_min, b.rt_max - b.rt_min) where a.rt_min is not null and a.rt_max is not null and b.rt_min is not null and b.rt_max is not null)"""
PPM = "with m as (select m.study, m.map_id, m.precursor_mz, m.precursor_intensity as i, (m.precursor_mz / f.mz - 1) * 1e6 as ppm from ms2_map m join aligned_feature_table f on m.group_id = f.group_id where m.precursor_mz > 0)"
ORACLES = {
    "q_consensus": """with m as (select group_id, precursor_mz as mz, rt_s as rt, precursor_intensity as h, map_id from ms2_map where group_id is not null and precursor_mz is not null and rt_s is not null and precursor_intensity > 0 and isfinite(precursor_intensity)),
w as (select *, sum(h) over (partition by group_id order by mz, map_id) as c, sum(h) over (partition by group_id) as t from m), k as (select group_id, min(mz) as mz from w where c >= 0.5 * t group by group_id)
select m.group_id, count(*) as n_detected, k.mz, round(median(m.rt), 6) as rt, round((max(m.mz) - min(m.mz)) / k.mz * 1e6, 6) as mz_ppm_spread, round(stddev_pop(m.rt), 6) as rt_sd from m join k on m.group_id = k.group_id group by m.group_id, k.mz""",
    "q_mad": "with m as (select group_id, rt_s, median(rt_s) over (partition by group_id) as md from ms2_map where group_id is not null) select group_id, round(max(md), 6) as median, round(median(abs(rt_s - md)), 6) as mad from m group by group_id",
    "q_loo_median": "with m as (select map_id, group_id, rt_s from ms2_map where group_id is not null and rt_s is not null) select a.map_id, round(median(b.rt_s), 6) as loo from m a left join m b on a.group_id = b.group_id and a.map_id <> b.map_id group by a.map_id",
    "q_mode": "select compound_id, charge, count(*) as n from aligned_feature_table where compound_id is not null and charge is not null group by 1, 2 qualify row_number() over (partition by compound_id order by count(*) desc, charge) = 1",
    "q_presence": "with c as (select row_no, count(*) as n_runs, count(*) filter (filled = 1) as n_filled from filled_mask where not contains(run, '_blk_') group by row_no) select *, cast(n_runs - n_filled >= least(3, n_runs) as integer) as kept from c",
    "q_filled_runs": "select row_no, string_agg(run, ';' order by run) as gap_filled_files from (select distinct row_no, run from filled_mask where filled = 1) group by row_no",
    "q_pivot_class": "select row_no, " + ", ".join(f"cast(sum(filled) filter (split_part(run, '_', 2) = '{c}') as bigint) as {c}" for c in ("smp", "qc", "blk", "std")) + " from filled_mask group by row_no",
    "q_rollup": "select study, charge, count(*) as n, round(avg(n_detected), 6) as mean_detected from aligned_feature_table group by rollup (study, charge)",
    "q_cube": "select iso_offset, charge, count(*) as n, count(distinct compound_id) as n_compounds from aligned_feature_table group by cube (iso_offset, charge)",
    "q_isolated": "select group_id from aligned_feature_table a where not exists (select 1 from aligned_feature_table b where a.study = b.study and a.group_id <> b.group_id and abs(b.mz - a.mz) <= a.mz * (10.0::double / 1e6) and abs(b.rt - a.rt) <= 0.5::double)",
    "q_mutual_unique": """with t as (select group_id, cast(substr(study, 3) as integer) as n, mz, rt from aligned_feature_table), p as (select x.group_id as a, y.group_id as b, y.rt - x.rt as drt, count(*) over (partition by x.group_id) as na, count(*) over (partition by y.group_id) as nb
from t x join t y on y.n = x.n + 1 and abs(y.mz - x.mz) <= x.mz * (500.0::double / 1e6) and abs(y.rt - x.rt) <= 1.0::double) select a, b, round(drt, 6) as drt from p where na = 1 and nb = 1""",
    "q_isotopes": """with c as (select study, group_id, rt, n_detected, k, mz - k * 1.0033548378::double / charge as below from aligned_feature_table, unnest([1, 2, 3]) t(k) where charge > 0)
select c.group_id, p.group_id as parent_id, c.k from c join aligned_feature_table p on c.study = p.study and abs(p.mz - c.below) <= c.below * (1000.0::double / 1e6) and p.n_detected > c.n_detected and abs(p.rt - c.rt) <= 0.5::double
qualify row_number() over (partition by c.group_id order by p.n_detected desc, c.k, p.group_id) = 1""",
    "q_isomers": PAIRS + " select study, a, b, round(gap * 60, 6) as gap_s from p",
    "q_codetect": PAIRS + ", s as (select distinct group_id, run from filled_mask where filled = 0 and group_id >= 1) select p.a, p.b, count(y.run) as n_codetected from p left join s x on p.a = x.group_id left join s y on p.b = y.group_id and x.run = y.run group by p.a, p.b",
    "q_coelute": COELUTE + " select group_id, count(*) as n from (select a as group_id from p union all select b from p) group by group_id",
    "q_relations": COELUTE.replace("<= 0.02::double", "<= 0.1::double") + ", k as (select * from (values " + ", ".join(f"('{n}', {v!r}::double)" for n, v in f.RELATIONS.items()) + ") t(relation, delta)) select p.a, p.b, k.relation from p join k on abs(abs(p.mz_a - p.mz_b) - k.delta) <= greatest(p.mz_a, p.mz_b) * (1000.0::double / 1e6) qualify row_number() over (partition by p.a, p.b order by abs(abs(p.mz_a - p.mz_b) - k.delta), k.relation) = 1",
    "q_strata": """with e as (select study, group_id, n_detected, rt, min(rt) over (partition by study) as lo, max(rt) over (partition by study) as hi from aligned_feature_table where rt is not null),
b as (select study, group_id, n_detected, cast(least(floor(20 * coalesce((rt - lo) / nullif(hi - lo, 0), 0)), 19) as integer) as bin from e)
select study, bin, cast(row_number() over (partition by study, bin order by n_detected desc nulls last, group_id) as integer) as k, group_id from b qualify row_number() over (partition by study, bin order by n_detected desc nulls last, group_id) <= 20""",
    "q_histogram": "select study, n_detected, count(*) as n from aligned_feature_table group by 1, 2",
    "q_feature_filter": "select group_id, mz, rt, possible_halogen from aligned_feature_table where mz between 200 and 900 and rt between 2 and 12 and iso_offset = 0 and possible_halogen in ('yes', 'maybe')",
    "q_mass_error": PPM + " select cast(floor(2 * log10(i)) as integer) as bin, count(*) as n, round(stddev_samp(ppm), 6) as sd_ppm, round(median(ppm), 6) as median_ppm from m where i > 0 and abs(ppm) < 50 group by 1 having count(*) >= 20",
    "q_calibration": PPM + ", b as (select study, ppm, cast(ntile(10) over (partition by study order by precursor_mz, map_id) as integer) as bin from m where abs(ppm) < 50) select study, bin, count(*) as n, round(median(ppm), 6) as ppm from b group by 1, 2",
    "q_slopes": "select study, count(*) as n, round(regr_slope(log10(tic), log10(precursor_intensity)), 6) as slope, round(regr_r2(log10(tic), log10(precursor_intensity)), 6) as r2 from ms2_map where tic > 0 and isfinite(tic) and precursor_intensity > 0 and isfinite(precursor_intensity) group by study",
    "q_spearman": """with m as (select study, file, n_peaks, precursor_intensity from ms2_map where precursor_intensity is not null and isfinite(precursor_intensity) and n_peaks is not null),
k as (select study, file, rank() over (partition by study, file order by n_peaks) + (count(*) over (partition by study, file, n_peaks) - 1) / 2.0 as x, rank() over (partition by study, file order by precursor_intensity) + (count(*) over (partition by study, file, precursor_intensity) - 1) / 2.0 as y from m)
select study, file, round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 6) as rho, count(*) as n from k group by 1, 2""",
    "q_union_runs": """select run, 'any' as part from (select run from scans union select run from filled_mask) union all select run, 'both' from (select run from scans intersect select run from filled_mask) union all select run, 'not_aligned' from (select run from points except select run from filled_mask)""",
}
ORACLES["q_spearman_whole"] = by_run(ORACLES["q_spearman"])
