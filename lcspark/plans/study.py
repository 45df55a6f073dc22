"""Queries of a study's estimates, windows, searches and annotations, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lcspark.constants import ADDUCT_PIECES
from lcspark.functions import chem
from lcspark.operators import align, shape
from lcspark.operators import study as s
from lcspark.operators.compounds import territories
from lcspark.operators.features import coeluting, isolated, isomer_candidates, possible_isotopes
from lcspark.operators.regrid import scan_readings
from lcspark.operators.traces import RUN_SQL, ranked_value, run_key, study_of, valid_points
from lcspark.plans.features import COELUTE, PAIRS
from lcspark.plans.shape import CAND, DENSE, dense
from lcspark.plans.spectra import _CAP, _COMBOS, DEFAULT, FORMULAS, q_default_hits
from lcspark.session import once
from lcspark.sources.tables import read


def r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


def q_mz_scatter(spark: SparkSession, d: str) -> DataFrame:
    return s.mz_scatter(dense(spark, d)).select("run", "bin", "n", r("mean_inverse", 9), r("sd"))


def q_parameters(spark: SparkSession, d: str) -> DataFrame:
    """The parameters that each run starts from."""
    t = dense(spark, d)
    fit = s.sigma_fit(s.mz_scatter(t))
    c = shape.candidates(t)
    base = c.groupBy("run").agg(F.median("dt").alias("dt"), F.median("fwhm").alias("fwhm")).join(fit, "run")
    floor = ranked_value(valid_points(read(spark, d, "points")), ["run"], "inten", 0.01).withColumnRenamed("inten", "floor")
    p = s.run_parameters(base.join(floor, "run"))
    return p.select("run", r("dt"), r("floor", 3), r("fwhm"), r("a", 5), r("b", 4), r("fwhm_scans", 5), r("tol_max", 4), "reach", "min_scans", "n_smooth")


def q_noise_law(spark: SparkSession, d: str) -> DataFrame:
    """Scan-to-scan variance of a run's traces by tenth of a decade, as a counting term and a proportional one, neither negative."""
    w = Window.partitionBy("run", "group_id").orderBy("scan")
    t = dense(spark, d).filter("inten > 0").select("run", F.col("inten").alias("i"), ((F.col("inten") - F.lag("inten").over(w)) / F.sqrt(F.lit(2.0))).alias("e")).filter("e is not null")
    b = t.groupBy("run", F.floor(10 * F.log10("i")).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("i").alias("m"), F.avg(F.col("e") * F.col("e")).alias("v")).filter("n >= 30")
    # weighted by one over the variance's own, which is about its square
    b = b.select("run", F.lit(1.0).alias("y"), (F.col("m") / F.col("v")).alias("a"), (F.col("m") * F.col("m") / F.col("v")).alias("b"))
    return align.two_factor_nnls(b, ["run"], "y", "a", "b").select("run", r("u", 4), r("v", 8), r("residual"))


def q_window_level(spark: SparkSession, d: str) -> DataFrame:
    """The nearest-rank upper quartile of each stretch of a trace."""
    t = dense(spark, d).withColumn("block", F.floor(F.col("scan") / shape.BLOCK))
    return t.groupBy("run", "group_id", "block").agg(F.array_sort(F.collect_list("inten")).alias("v")).select("run", "group_id", "block", s.nearest_rank(F.col("v"), 0.75).alias("level"))


def q_eic_windows(spark: SparkSession, d: str) -> DataFrame:
    t = dense(spark, d)
    g = t.groupBy("run", "group_id").agg(F.min("mz").alias("mz_min"), F.max("mz").alias("mz_max")).withColumn("target", F.exp((F.col("group_id") + 0.5) * shape.BIN))
    return s.eic_windows(g).select("run", "group_id", r("below", 2), r("above", 2))


def q_grid_eic(spark: SparkSession, d: str) -> DataFrame:
    return s.grid_traces(dense(spark, d)).select("run", "group_id", "cell", r("inten", 3))


def q_scans_in_window(spark: SparkSession, d: str) -> DataFrame:
    """Scans of each run inside every feature's window."""
    t = scan_readings(read(spark, d, "scans")).withColumn("study", study_of(F.col("run"))).select("run", "study", "minutes", F.floor("minutes").alias("_m"))
    f = read(spark, d, "aligned_feature_table").filter("rt_min is not null and rt_max is not null").select(F.col("study").alias("_s"), "group_id", "rt_min", "rt_max", F.explode(F.sequence(F.floor("rt_min"), F.floor("rt_max"))).alias("_k"))
    j = t.join(f, (F.col("study") == F.col("_s")) & (F.col("_m") == F.col("_k")) & F.col("minutes").between(F.col("rt_min"), F.col("rt_max")))
    return j.groupBy("run", "group_id").agg(F.count("*").alias("n"))


def q_clipped_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Errors of the hits' masses in 61 bins of -10..10 ppm."""
    h = read(spark, d, "identifications").filter("not isnan(ppm_error)")
    return s.clipped_histogram(h, ["spectrum"], F.col("ppm_error"), 10.0)


SEARCHES = (("", {"mz": (200.0, 900.0), "charge": (1, 1)}), ("#12", {}), ("387.77", {"rt": (0.0, 20.0)}))


def q_search(spark: SparkSession, d: str) -> DataFrame:
    """Feature lists of a range, a number and an m/z."""
    f = read(spark, d, "aligned_feature_table")
    return reduce(DataFrame.unionByName, [s.search(f, t, 50.0, **k).select(F.lit(t).alias("search"), "group_id") for t, k in SEARCHES])


def q_wide_view(spark: SparkSession, d: str) -> DataFrame:
    t = dense(spark, d)
    return s.wide_view(read(spark, d, "points"), t, shape.candidates(t), 2000.0).select("run", "group_id", "block", r("foreign"))


def q_electronic(spark: SparkSession, d: str) -> DataFrame:
    """Peaks of each record that look like electronic noise."""
    p = read(spark, d, "library").select("library_index", F.transform(F.filter("peaks", lambda x: x["inten"].isNotNull()), lambda x: x["inten"].cast("double")).alias("i"))
    m = once(p, m=s.electronic_mask(F.col("i"), 3, 0.05))
    return m.select("library_index", F.size("i").alias("n_peaks"), F.size(F.filter("m", lambda x: x)).alias("n_noise"))


def q_loss_rules(spark: SparkSession, d: str) -> DataFrame:
    """The rules of losses and ions on every formula."""
    x, n = chem.with_counts(read(spark, d, "library"), "formula")
    x = once(x, m=chem.mass_of(n))
    return x.select("library_index", chem.loss_ok(n, F.col("m")).cast("int").alias("loss"), chem.ion_ok(n, F.col("m")).cast("int").alias("ion"))


#: Adducts that a record's precursor is tried with where its own name does not fit, and the agreement asked for, in Da.
GUESSES, AGREE = ("[M+H]+", "[M+Na]+", "[M+NH4]+", "[M+K]+", "[M-H]-", "[M+Cl]-", "[M+HCOO]-"), 0.02


def q_ion_formula(spark: SparkSession, d: str) -> DataFrame:
    """The adduct in force of each record with a formula and a precursor: its own if it agrees with the m/z, else the guess nearest to it that does, else none."""
    x, n = chem.with_counts(read(spark, d, "library").filter("precursor_mz is not null"), "formula")
    x = once(x, m=chem.mass_of(n))
    off = lambda a: F.abs(chem.ion_mz(F.col("m"), a) - F.col("precursor_mz"))
    own = F.when(off(F.col("precursor_type")) <= AGREE, F.col("precursor_type"))
    guess = F.array_min(F.filter(F.array(*[F.struct(off(F.lit(g)).alias("o"), F.lit(g).alias("g")) for g in GUESSES]), lambda t: t["o"] < AGREE))["g"]
    return x.select("library_index", F.coalesce(own, guess).alias("adduct"), F.when(own.isNotNull(), "named").when(guess.isNotNull(), "guessed").otherwise("none").alias("source"))


def q_denoise_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why a record is passed whole by the denoising rule, or that it is not: the first that applies."""
    x = read(spark, d, "library").select("library_index", "formula", "precursor_type", "peaks")
    delta, _, z = chem.adduct_parts(F.col("precursor_type"))
    x = once(x, delta=delta, z=z, ok=F.coalesce(chem.is_formula(F.col("formula")), F.lit(False)))
    why = F.when(F.col("peaks").isNull() | (F.size("peaks") == 0), "no_peaks").when(~F.col("ok"), "no_formula").when(F.col("delta").isNull(), "no_adduct").when(F.abs("z") != 1, "charge").otherwise("applied")
    return x.select("library_index", why.alias("reason"))


def q_spectra_summary(spark: SparkSession, d: str) -> DataFrame:
    """What is mapped to each feature: spectra, runs, the strongest precursor, how many count for its consensus."""
    m = read(spark, d, "ms2_map").filter("group_id is not null").withColumn("run", run_key(F.col("file")))
    best = F.max_by("map_id", F.struct(F.coalesce(F.when(~F.isnan("tic"), F.col("tic")), F.lit(-1.0)), (-F.col("map_id")).alias("k")))
    g = m.groupBy("group_id").agg(F.count("*").alias("n_spectra"), F.countDistinct("run").alias("n_runs"), best.alias("best"), F.count_if(F.col("in_consensus") == 1).alias("n_in_consensus"))
    return read(spark, d, "aligned_feature_table").select("group_id").join(g, "group_id", "left").select("group_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_spectra", "n_runs", "n_in_consensus")], "best")


def q_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Anchors in tiers: features seen in most runs and alone at their m/z, then seen in most, then the rest; twenty of each of twenty stretches of time."""
    f = read(spark, d, "aligned_feature_table").filter("rt is not null and mz is not null").select("study", "group_id", "mz", "rt", "n_detected")
    alone = isolated(f).select("group_id", F.lit(1).alias("alone"))
    most = F.col("n_detected") >= 6
    t = f.join(alone, "group_id", "left").withColumn("tier", F.when(most & F.col("alone").isNotNull(), 1).when(most, 2).otherwise(3)).withColumn("bin", F.least(F.floor("rt"), F.lit(19)).cast("int"))
    w = Window.partitionBy("study", "bin").orderBy("tier", F.col("n_detected").desc_nulls_last(), "group_id")
    return t.withColumn("k", F.row_number().over(w)).filter("k <= 20").select("study", "bin", "tier", "k", "group_id")


def q_clipped_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of isomers cut at their territories."""
    f = read(spark, d, "aligned_feature_table")
    t = territories(isomer_candidates(f).select("a", "b"), f.select(F.col("group_id").alias("id"), "rt"))
    j = t.join(f.select(F.col("group_id").alias("id"), "rt_min", "rt_max"), "id")
    return j.select(F.col("id").alias("group_id"), F.round(F.greatest("rt_min", F.coalesce("lo", "rt_min")), 6).alias("rt_min"), F.round(F.least("rt_max", F.coalesce("hi", "rt_max")), 6).alias("rt_max"))


def q_calibration_whole(spark: SparkSession, d: str) -> DataFrame:
    """The m/z error of each run's precursors against their features, and the tolerance that is left."""
    m = read(spark, d, "ms2_map").filter("precursor_mz > 0 and not isnan(precursor_mz)").withColumn("run", run_key(F.col("file"))).filter("run is not null").join(read(spark, d, "aligned_feature_table").select("group_id", "mz"), "group_id")
    m = m.select("run", F.col("map_id").alias("id"), F.col("precursor_mz").alias("mz"), ((F.col("precursor_mz") - F.col("mz")) / F.col("mz") * 1e6).alias("d_ppm"))
    return s.calibration(m, "run", per_bin=20).select("run", "bin", r("knot_mz"), r("knot_ppm"), r("tolerance"), "n")


def q_annotation_edits(spark: SparkSession, d: str) -> DataFrame:
    """What is in force where halogen verdicts are taken as a user's words, isotopes as cleared ones."""
    f = read(spark, d, "aligned_feature_table")
    said = f.filter("possible_halogen = 'yes'").select("group_id", F.coalesce("halogen_pattern", F.lit("halogen")).alias("annotation"), F.lit(1).alias("at"))
    cleared = f.filter("iso_offset > 0").select("group_id", F.lit(None).cast("string").alias("annotation"), F.lit(2).alias("at"))
    return s.annotations(f, said.unionByName(cleared), q_default_hits(spark, d).select("group_id", "name", "score"))


def q_smiles(spark: SparkSession, d: str) -> DataFrame:
    return s.smiles_formulas(read(spark, d, "library").filter("smiles is not null"), "library_index")


def q_missing_cells(spark: SparkSession, d: str) -> DataFrame:
    """Runs of its study in which a feature was not detected: the cells that gap filling works on."""
    cells = read(spark, d, "filled_mask").filter("group_id >= 1")
    f = read(spark, d, "aligned_feature_table").select("group_id", "study")
    runs = read(spark, d, "filled_mask").select("run").distinct().withColumn("study", F.split_part("run", F.lit("_"), F.lit(1)))
    return f.join(runs, "study").select("group_id", "run").join(cells.filter("filled = 0").select("group_id", "run").distinct(), ["group_id", "run"], "left_anti")


def q_shared_strongest(spark: SparkSession, d: str) -> DataFrame:
    h = read(spark, d, "ms2_map").filter("group_id is not null and precursor_intensity > 0 and not isnan(precursor_intensity)").select("group_id", run_key(F.col("file")).alias("run"), F.col("precursor_intensity").alias("height")).filter("run is not null")
    return s.strongest_shared(coeluting(read(spark, d, "aligned_feature_table"), 0.5), h, 3).select("a", "b", "run", "low", "k")


def q_eic_budget(spark: SparkSession, d: str) -> DataFrame:
    """The features whose chromatograms fit a budget of 4,800 values: the most detected first, 48 values in each run of the study."""
    f = read(spark, d, "aligned_feature_table")
    runs = read(spark, d, "filled_mask").select("run").distinct().groupBy(F.split_part("run", F.lit("_"), F.lit(1)).alias("study")).agg(F.count("*").alias("n"))
    k = F.row_number().over(Window.partitionBy("study").orderBy(F.col("n_detected").desc_nulls_last(), "group_id"))
    return f.join(runs, "study").withColumn("k", k).filter(F.col("k") <= F.floor(F.lit(4800) / (F.col("n") * 48))).select("study", "group_id", "k")


def q_iso_parent(spark: SparkSession, d: str) -> DataFrame:
    """Of each compound's possible isotopes the compound that most of their parents belong to."""
    f = read(spark, d, "aligned_feature_table")
    p = possible_isotopes(f, 1000.0, 0.5).join(f.select("group_id", F.col("compound_id").alias("child")), "group_id").join(f.select(F.col("group_id").alias("parent_id"), F.col("compound_id").alias("parent")), "parent_id")
    n = p.filter("child is not null and parent is not null and child != parent").groupBy("child", "parent").agg(F.count("*").alias("n"))
    best = n.groupBy("child").agg(F.max(F.struct("n", (-F.col("parent")).alias("k"))).alias("b"))
    return best.select(F.col("child").alias("compound_id"), (-F.col("b.k")).alias("parent_id"), F.col("b.n").alias("n"))


QUERIES = {k: f for k, f in globals().items() if k.startswith("q_") and k != "q_default_hits"}

SCATTER = """, mm as (select run, group_id, median(mz) as m from dn where inten > 0 group by 1, 2), sx as (select dn.run, cast(floor(2 * log10(inten)) as integer) as bin, (mz / m - 1) * 1e6 as d, 1 / inten as v from dn join mm on dn.run = mm.run and dn.group_id = mm.group_id where inten > 0),
sb as (select run, bin, count(*) as n, avg(v) as mean_inverse, stddev_samp(d) as sd from sx group by 1, 2 having count(*) >= 20)"""
_HMAX = "2 * (C_ + O_ + S_) + 3 * (N_ + P_) + F_ + Cl_ + Br_ + I_ + Na_ + K_ + 4 * Si_"
_ATOMS = ("I", "Br", "K", "Cl", "S", "P", "Si", "Na", "F", "O", "N", "C")
_HEAVY = " + ".join(f"{e}_" for e in _ATOMS)
_KINDS = " + ".join(f"cast({e}_ > 0 as integer)" for e in _ATOMS)
_SMALL = lambda x: f"({_HEAVY}) between 1 and 6 and ({_KINDS}) <= 2 and H_ <= {_HMAX} + {x}"
_RATIOS = " and ".join(f"{e}_ <= {k} * C_" for e, k in chem.PER_CARBON.items()) + " and case " + " ".join(f"when mass < {edge} then {_CAP(row)}" for edge, row in chem.CAPS.items() if edge != float("inf")) + f" else {_CAP(chem.CAPS[float('inf')])} end"
_GUESS = ", ".join(f"('{g}')" for g in GUESSES)
_ADDUCTS = ", ".join(f"('{a}', {n}, {m!r}::double, {z})" for a, n, m, z in [(a, *x) for a, x in {
    "[M+H]+": (1, chem.piece_mass("H"), 1), "[M+Na]+": (1, chem.piece_mass("Na"), 1), "[M+NH4]+": (1, chem.piece_mass("NH4"), 1), "[M+K]+": (1, chem.piece_mass("K"), 1), "[M-H]-": (1, -chem.piece_mass("H"), -1), "[M+Cl]-": (1, chem.piece_mass("Cl"), -1),
    "[M+HCOO]-": (1, chem.piece_mass("CHO2"), -1), "[M+2H]2+": (1, 2 * chem.piece_mass("H"), 2), "[2M+H]+": (2, chem.piece_mass("H"), 1), "[M+H-H2O]+": (1, chem.piece_mass("H") - chem.piece_mass("H2O"), 1), "[M-H2O+H]+": (1, chem.piece_mass("H") - chem.piece_mass("H2O"), 1),
}.items()])
HEIGHTS = f"h as (select group_id, {RUN_SQL} as run, max(precursor_intensity) as h from ms2_map where group_id is not null and precursor_intensity > 0 and not isnan(precursor_intensity) and file is not null group by 1, 2)"
ISOTOPES = """with c as (select study, group_id, rt, n_detected, k, mz - k * 1.0033548378::double / charge as below from aligned_feature_table, unnest([1, 2, 3]) t(k) where charge > 0),
iso as (select c.group_id, p.group_id as parent_id from c join aligned_feature_table p on c.study = p.study and abs(p.mz - c.below) <= c.below * (1000.0::double / 1e6) and p.n_detected > c.n_detected and abs(p.rt - c.rt) <= 0.5::double qualify row_number() over (partition by c.group_id order by p.n_detected desc, c.k, p.group_id) = 1)"""
CHAINS = PAIRS.replace("with p as", "with recursive p as") + ", e as (select a, b from p union select b, a from p), walk as (select a as id, a as seen from e union select w.id, e.b from walk w join e on w.seen = e.a), comp as (select id, min(seen) as component from walk group by id)"
ORACLES = {
    "q_mz_scatter": DENSE + SCATTER + " select run, bin, n, round(mean_inverse, 9) as mean_inverse, round(sd, 6) as sd from sb",
    "q_parameters": DENSE + CAND + SCATTER + """, ft as (select run, sqrt(greatest(regr_intercept(sd * sd, mean_inverse), 0)) as a, sqrt(greatest(regr_slope(sd * sd, mean_inverse), 0)) as b from sb group by run), bs as (select run, median(dt) as dt, median(fwhm) as fwhm from cd group by run), fl as (select run, quantile_cont(inten, 0.01) as floor from v group by run),
z as (select bs.run, dt, floor, fwhm, a, b, fwhm / dt as fs from bs join ft on bs.run = ft.run join fl on bs.run = fl.run)
select run, round(dt, 6) as dt, round(floor, 3) as floor, round(fwhm, 6) as fwhm, round(a, 5) as a, round(b, 4) as b, round(fs, 5) as fwhm_scans, round(least(greatest(4 * sqrt(a * a + b * b / floor), 5), 30), 4) as tol_max, cast(least(greatest(round(0.5::double * fs), 1), 3) as integer) as reach,
  cast(least(greatest(round(0.5::double * fs), 3), 5) as integer) as min_scans, cast(least(greatest(round(2 * (fs / 2.3548::double) ** 2 / 16), 1), 50) as integer) as n_smooth from z""",
    "q_noise_law": DENSE + """, ee as (select run, inten as i, (inten - lag(inten) over (partition by run, group_id order by scan)) / sqrt(2) as e from dn where inten > 0), b as (select run, cast(floor(10 * log10(i)) as integer) as bin, avg(i) as m, avg(e * e) as v from ee where e is not null group by 1, 2 having count(*) >= 30),
q as (select run, 1.0::double as y, m / v as a, m * m / v as b from b), s as (select run, sum(a * a) as aa, sum(a * b) as ab, sum(b * b) as bb, sum(a * y) as ay, sum(b * y) as byy, sum(y * y) as yy, count(*) as n from q group by run),
f as (select *, aa * bb - ab * ab as det, greatest(ay / aa, 0) as ua, greatest(byy / bb, 0) as vb from s), g as (select *, coalesce(case when det <> 0 then (ay * bb - byy * ab) / det end >= 0 and case when det <> 0 then (byy * aa - ay * ab) / det end >= 0 and det > 1e-12 * aa * bb, false) as ok, yy - 2 * ua * ay + ua * ua * aa <= yy - 2 * vb * byy + vb * vb * bb as oa from f),
h as (select *, case when ok then (ay * bb - byy * ab) / det when oa then ua else 0 end as u, case when ok then (byy * aa - ay * ab) / det when oa then 0 else vb end as v from g)
select run, round(u, 4) as u, round(v, 8) as v, round(sqrt(greatest((yy - 2 * u * ay - 2 * v * byy + u * u * aa + 2 * u * v * ab + v * v * bb) / n, 0)), 6) as residual from h""",
    "q_window_level": DENSE + " select run, group_id, block, list_sort(list(inten))[cast(floor(0.75 * (count(*) - 1) + 0.5) as bigint) + 1] as level from dn group by 1, 2, 3",
    "q_eic_windows": DENSE + """, sp as (select run, group_id, min(mz) as lo, max(mz) as hi, exp((group_id + 0.5::double) * 2e-5::double) as t from dn group by 1, 2), w as (select *, case when lo > 0 and hi >= lo then ceil((t - lo + 1e-5) / t * 1e6 / 0.01::double - 1e-9) * 0.01::double end as a, case when lo > 0 and hi >= lo then ceil((hi - t + 1e-5) / t * 1e6 / 0.01::double - 1e-9) * 0.01::double end as b from sp),
m as (select *, median(a) over (partition by group_id) as ma, median(b) over (partition by group_id) as mb from w) select run, group_id, round(greatest(5, coalesce(a, ma, 5)), 2) as below, round(greatest(5, coalesce(b, mb, 5)), 2) as above from m""",
    "q_grid_eic": DENSE + """, en as (select run, min(minutes) as a, max(minutes) as z from dn group by run), g as (select dn.run, group_id, cast(least(floor(48 * coalesce((minutes - a) / nullif(z - a, 0), 0)), 47) as integer) as cell, max(inten) as inten from dn join en on dn.run = en.run group by 1, 2, 3),
n as (select *, lead(cell) over w as c, lead(inten) over w as x from g window w as (partition by run, group_id order by cell)), k as (select *, unnest(range(cell + 1, c)) as kk from n where c - cell > 1 and inten > 0 and x > 0)
select run, group_id, cell, round(inten, 3) as inten from g union all select run, group_id, cast(kk as integer), round(inten + (x - inten) * (kk - cell) / (c - cell), 3) from k""",
    "q_scans_in_window": DENSE + " select tm.run, f.group_id, count(*) as n from tm join aligned_feature_table f on f.study = split_part(tm.run, '_', 1) and tm.minutes between f.rt_min and f.rt_max group by 1, 2",
    "q_clipped_histogram": "select spectrum, cast(least(floor((least(greatest(ppm_error, -10), 10) + 10) / (20.0::double / 61)), 60) as integer) as bin, count(*) as n from identifications where ppm_error is not null and not isnan(ppm_error) group by 1, 2",
    "q_search": "select '' as search, group_id from aligned_feature_table where mz between 200 and 900 and charge between 1 and 1 union all select '#12', group_id from aligned_feature_table where group_id = 12 union all select '387.77', group_id from aligned_feature_table where rt between 0 and 20 and abs(mz - 387.77::double) <= 387.77::double * 50 / 1e6",
    "q_wide_view": DENSE + CAND + """, o as (select c.run, c.group_id, c.block, dn.scan, dn.mz, dn.inten from cd c join dn on c.run = dn.run and c.group_id = dn.group_id and dn.scan between c.scan_lo and c.scan_hi where dn.inten > 0), n as (select run, group_id, block, count(distinct scan) as n from o group by 1, 2, 3),
f as (select o.run, o.group_id, o.block, count(distinct o.scan) as f from o join v on v.run = o.run and v.scan = o.scan and abs(v.mz - o.mz) <= o.mz * (2000.0::double / 1e6) and abs(v.mz - o.mz) > o.mz * 10 / 1e6 and v.inten >= 0.2::double * o.inten group by 1, 2, 3)
select n.run, n.group_id, n.block, round(coalesce(f, 0) / n, 6) as foreign from n left join f on n.run = f.run and n.group_id = f.group_id and n.block = f.block""",
    "q_electronic": """with recursive p as (select library_index, x.inten::double as i from (select library_index, unnest(peaks) as x from library) where x.inten is not null), st as (select library_index, min(i) as s from p group by 1 union all select library_index, nx from (select st.library_index, (select min(p.i) from p where p.library_index = st.library_index and p.i > st.s * (1 + 0.05::double)) as nx from st) where nx is not null),
g as (select p.library_index, p.i, max(st.s) as s from p join st on p.library_index = st.library_index and st.s <= p.i group by 1, 2), c as (select g.library_index, g.s, sum(m.k) as n from g join (select library_index, i, count(*) as k from p group by 1, 2) m on g.library_index = m.library_index and g.i = m.i group by 1, 2),
z as (select library_index, sum(n) as n from c where n >= 3 group by 1) select l.library_index, cast(len(list_filter(l.peaks, lambda x: x.inten is not null)) as integer) as n_peaks, cast(coalesce(z.n, 0) as integer) as n_noise from library l left join z on l.library_index = z.library_index where l.peaks is not null""",
    "q_loss_rules": FORMULAS + f""" select library_index, cast(case when C_ > 0 then H_ <= {_HMAX} + 2 and ({_RATIOS}) when ({_HEAVY}) = 0 then H_ between 1 and 4 else {_SMALL(0)} end as integer) as loss, cast(case when C_ > 0 then H_ <= {_HMAX} + 2 and ({_RATIOS}) and ({_COMBOS}) else {_SMALL(1)} end as integer) as ion from w""",
    "q_ion_formula": FORMULAS + f""", ad as (select * from (values {_ADDUCTS}) t(adduct, n, delta, z)), o as (select w.library_index, w.precursor_type, ad.adduct, abs((ad.n * mass + ad.delta - ad.z * 0.00054857990946::double) / abs(ad.z) - w.precursor_mz) as off from w, ad where w.precursor_mz is not null),
nm as (select library_index, adduct from o where adduct = precursor_type and off <= 0.02::double), gs as (select library_index, adduct from o where adduct in (select g from (values {_GUESS}) t(g)) and off < 0.02::double qualify row_number() over (partition by library_index order by off, adduct) = 1)
select w.library_index, coalesce(nm.adduct, gs.adduct) as adduct, case when nm.adduct is not null then 'named' when gs.adduct is not null then 'guessed' else 'none' end as source from w left join nm on w.library_index = nm.library_index left join gs on w.library_index = gs.library_index where w.precursor_mz is not null""",
    "q_denoise_reasons": """with ad as (select distinct precursor_type as t from library where regexp_full_match(replace(precursor_type, ' ', ''), '\\[[0-9]*M([+-][A-Za-z0-9]+)*\\][0-9]*[+-]')), term as (select t, unnest(regexp_extract_all(regexp_extract(replace(t, ' ', ''), 'M(.*)\\]', 1), '[+-][0-9]*[A-Za-z][A-Za-z0-9]*')) as x from ad),
pc as (select p from (values """ + ", ".join(f"('{p}')" for p in ADDUCT_PIECES) + """) v(p)), bad as (select distinct t from term where not exists (select 1 from pc where p = regexp_extract(x, '^[+-][0-9]*(.*)$', 1))),
k as (select t, coalesce(try_cast(nullif(regexp_extract(replace(t, ' ', ''), '\\]([0-9]*)', 1), '') as integer), 1) as z from ad where t not in (select t from bad))
select l.library_index, case when l.peaks is null or len(l.peaks) = 0 then 'no_peaks' when not coalesce(regexp_full_match(l.formula, '((Br|Cl|Si|Na|I|K|S|P|F|O|N|C|H)[0-9]*)+'), false) then 'no_formula' when k.t is null then 'no_adduct' when k.z <> 1 then 'charge' else 'applied' end as reason from library l left join k on l.precursor_type = k.t""",
    "q_spectra_summary": f"""with m as (select group_id, {RUN_SQL} as run, map_id, case when not isnan(tic) then tic end as tic, in_consensus from ms2_map where group_id is not null), b as (select group_id, map_id as best from m qualify row_number() over (partition by group_id order by coalesce(tic, -1) desc, map_id) = 1),
g as (select group_id, count(*) as n_spectra, count(distinct run) as n_runs, count(*) filter (in_consensus = 1) as n_in_consensus from m group by 1)
select f.group_id, coalesce(n_spectra, 0) as n_spectra, coalesce(n_runs, 0) as n_runs, coalesce(n_in_consensus, 0) as n_in_consensus, b.best from aligned_feature_table f left join g on f.group_id = g.group_id left join b on f.group_id = b.group_id""",
    "q_anchors": """with f as (select a.study, a.group_id, a.rt, a.n_detected, not exists (select 1 from aligned_feature_table b where a.study = b.study and a.group_id <> b.group_id and abs(b.mz - a.mz) <= a.mz * (10.0::double / 1e6) and abs(b.rt - a.rt) <= 0.5::double) as alone from aligned_feature_table a where rt is not null and mz is not null),
t as (select study, group_id, n_detected, case when n_detected >= 6 and alone then 1 when n_detected >= 6 then 2 else 3 end as tier, cast(least(floor(rt), 19) as integer) as bin from f)
select study, bin, tier, cast(row_number() over (partition by study, bin order by tier, n_detected desc nulls last, group_id) as integer) as k, group_id from t qualify row_number() over (partition by study, bin order by tier, n_detected desc nulls last, group_id) <= 20""",
    "q_clipped_windows": CHAINS + """, t as (select id, (lag(rt) over w + rt) / 2 as lo, (lead(rt) over w + rt) / 2 as hi from comp join aligned_feature_table f on comp.id = f.group_id window w as (partition by component order by rt, id))
select t.id as group_id, round(greatest(f.rt_min, coalesce(lo, f.rt_min)), 6) as rt_min, round(least(f.rt_max, coalesce(hi, f.rt_max)), 6) as rt_max from t join aligned_feature_table f on t.id = f.group_id""",
    "q_calibration_whole": f"""with m as (select {RUN_SQL} as run, m.map_id as id, m.precursor_mz as mz, (m.precursor_mz - f.mz) / f.mz * 1e6 as d from ms2_map m join aligned_feature_table f on m.group_id = f.group_id where m.precursor_mz > 0 and not isnan(m.precursor_mz) and m.file is not null),
k as (select *, count(*) over (partition by run) as n, row_number() over (partition by run order by mz, id) - 1 as k from m), b as (select *, least(greatest(n // 20, 1), 10) as bins from k where n >= 30), z as (select *, n // bins as size, n % bins as extra from b),
y as (select *, cast(case when k < extra * (size + 1) then k // (size + 1) else extra + (k - extra * (size + 1)) // size end as integer) as bin from z), q as (select run, bin, median(mz) as knot_mz, median(d) as knot_ppm from y group by 1, 2), rr as (select y.run, y.n, d - knot_ppm as r from y join q on y.run = q.run and y.bin = q.bin),
t as (select run, any_value(n) as n, 3 * 1.4826::double * median(abs(r - c)) as s from (select *, median(r) over (partition by run) as c from rr) group by run)
select q.run, q.bin, round(knot_mz, 6) as knot_mz, round(knot_ppm, 6) as knot_ppm, round(least(50, greatest(5, s)), 6) as tolerance, n from q join t on q.run = t.run""",
    "q_annotation_edits": DEFAULT + """, u as (select group_id, case when coalesce(iso_offset, 0) > 0 then null when possible_halogen = 'yes' then coalesce(halogen_pattern, 'halogen') end as a from aligned_feature_table)
select u.group_id, coalesce(u.a, b.name, '') as annotation, case when u.a is not null then 'user' when b.name is not null then 'library' else 'none' end as source, case when u.a is null then b.score end as score from u left join (select * from b where score >= 0.7) b on u.group_id = b.group_id""",
    "q_smiles": """with t as (select library_index, smiles, len(regexp_extract_all(smiles, '[Cc](?!l)|C')) as x from library where smiles is not null), n as (select library_index, len(regexp_extract_all(smiles, '[Cc]')) as c, len(regexp_extract_all(smiles, 'c')) as ar, len(regexp_extract_all(smiles, 'N')) as n, len(regexp_extract_all(smiles, 'O')) as o, len(regexp_extract_all(smiles, 'S')) as s, len(regexp_extract_all(smiles, '=')) as db, len(regexp_extract_all(smiles, '[0-9]')) // 2 as rings from t),
h as (select *, 4 * c - ar + 3 * n + 2 * o + 2 * s - 2 * (c + n + o + s - 1 + rings + db) as h from n) select library_index, case when c > 1 then 'C' || c when c = 1 then 'C' else '' end || case when h > 1 then 'H' || h when h = 1 then 'H' else '' end || case when n > 1 then 'N' || n when n = 1 then 'N' else '' end || case when o > 1 then 'O' || o when o = 1 then 'O' else '' end || case when s > 1 then 'S' || s when s = 1 then 'S' else '' end as formula from h""",
    "q_missing_cells": """with r as (select distinct run, split_part(run, '_', 1) as study from filled_mask) select f.group_id, r.run from aligned_feature_table f join r on f.study = r.study where not exists (select 1 from filled_mask m where m.group_id = f.group_id and m.run = r.run and m.filled = 0 and m.group_id >= 1)""",
    "q_shared_strongest": COELUTE.replace("<= 0.02::double", "<= 0.5::double") + f", {HEIGHTS} select p.a, p.b, x.run, least(x.h, y.h) as low, cast(row_number() over (partition by p.a, p.b order by least(x.h, y.h) desc, x.run) as integer) as k from p join h x on p.a = x.group_id join h y on p.b = y.group_id and x.run = y.run qualify row_number() over (partition by p.a, p.b order by least(x.h, y.h) desc, x.run) <= 3",
    "q_eic_budget": """with r as (select split_part(run, '_', 1) as study, count(distinct run) as n from filled_mask group by 1), k as (select f.study, f.group_id, n, cast(row_number() over (partition by f.study order by n_detected desc nulls last, group_id) as integer) as k from aligned_feature_table f join r on f.study = r.study) select study, group_id, k from k where k <= floor(4800.0::double / (n * 48))""",
    "q_iso_parent": ISOTOPES + """, n as (select a.compound_id as child, b.compound_id as parent, count(*) as n from iso join aligned_feature_table a on iso.group_id = a.group_id join aligned_feature_table b on iso.parent_id = b.group_id where a.compound_id <> b.compound_id group by 1, 2)
select child as compound_id, parent as parent_id, n from n qualify row_number() over (partition by child order by n desc, parent) = 1""",
}
