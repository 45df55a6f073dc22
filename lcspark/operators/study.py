"""What a study's viewer and bookkeeping ask for: windows, grids, levels, searches, annotations; and the estimates a run starts from."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lcspark.band import band_join
from lcspark.functions.smiles import element_counts, hill_text
from lcspark.operators.traces import valid_points

#: How far an edge of a span is moved out, in Da, and the grid it is then moved to, in ppm.
EDGE_DA, EDGE_STEP = 1e-5, 0.01


def mz_scatter(dense: DataFrame, least: int = 20) -> DataFrame:
    """``(run, bin, n, mean_inverse, sd)``: scatter of a run's traces about their median m/z, by half decade of intensity, bins of ``least`` or more."""
    p = dense.filter("inten > 0")
    m = p.groupBy("run", "group_id").agg(F.median("mz").alias("_m"))
    d = p.join(m, ["run", "group_id"]).select("run", F.floor(2 * F.log10("inten")).cast("int").alias("bin"), ((F.col("mz") / F.col("_m") - 1) * 1e6).alias("d"), (1 / F.col("inten")).alias("v"))
    return d.groupBy("run", "bin").agg(F.count("*").alias("n"), F.avg("v").alias("mean_inverse"), F.stddev_samp("d").alias("sd")).filter(F.col("n") >= least)


def sigma_fit(scatter: DataFrame) -> DataFrame:
    """``(run, a, b)`` of sd² = a² + b² / I by least squares over the bins; a part that would be negative is 0."""
    g = scatter.groupBy("run").agg(F.regr_slope(F.col("sd") * F.col("sd"), F.col("mean_inverse")).alias("s"), F.regr_intercept(F.col("sd") * F.col("sd"), F.col("mean_inverse")).alias("i"))
    return g.select("run", F.sqrt(F.greatest("i", F.lit(0.0))).alias("a"), F.sqrt(F.greatest("s", F.lit(0.0))).alias("b"))


def run_parameters(base: DataFrame) -> DataFrame:
    """``base(run, dt, floor, fwhm, a, b)`` with what follows: width in scans, largest m/z tolerance, scans looked across, least scans, smoothing passes."""
    c = F.col
    clip = lambda x, lo, hi: F.least(F.greatest(x, F.lit(lo)), F.lit(hi))
    d = base.withColumn("fwhm_scans", c("fwhm") / c("dt")).withColumn("tol_max", clip(4 * F.sqrt(c("a") * c("a") + c("b") * c("b") / c("floor")), 5.0, 30.0))
    d = d.withColumn("reach", clip(F.round(0.5 * c("fwhm_scans")), 1, 3).cast("int")).withColumn("min_scans", clip(F.round(0.5 * c("fwhm_scans")), 3, 5).cast("int"))
    return d.withColumn("n_smooth", clip(F.round(2 * F.pow(c("fwhm_scans") / 2.3548, 2) / 16), 1, 50).cast("int"))


def nearest_rank(values: Column, q: float) -> Column:
    """The ``int(q (n - 1) + 0.5)``-th of a sorted array: a quantile that is always one of the values."""
    return F.element_at(values, (F.floor(q * (F.size(values) - 1) + 0.5) + 1).cast("int"))


def eic_windows(spans: DataFrame, ppm: float = 5.0) -> DataFrame:
    """``spans(run, group_id, target, mz_min, mz_max)`` with ``below`` and ``above``: the ppm over which a run's chromatogram is drawn: the union of ``ppm`` and the
    span of the centroids, moved out to the grid; without a span the group's median over the runs that have one."""
    out = lambda x: F.ceil((x + EDGE_DA) / F.col("target") * 1e6 / EDGE_STEP - 1e-9) * EDGE_STEP
    has = (F.col("mz_min") > 0) & (F.col("mz_max") >= F.col("mz_min"))
    d = spans.withColumn("_lo", F.when(has, out(F.col("target") - F.col("mz_min")))).withColumn("_hi", F.when(has, out(F.col("mz_max") - F.col("target"))))
    m = d.groupBy("group_id").agg(F.median("_lo").alias("_ml"), F.median("_hi").alias("_mh"))
    least = lambda own, usual: F.greatest(F.lit(float(ppm)), F.coalesce(own, usual, F.lit(float(ppm))))
    return d.join(m, "group_id").withColumn("below", least(F.col("_lo"), F.col("_ml"))).withColumn("above", least(F.col("_hi"), F.col("_mh"))).drop("_lo", "_hi", "_ml", "_mh")


def grid_traces(dense: DataFrame, points: int = 48) -> DataFrame:
    """``(run, group_id, cell, inten)``: traces pooled to the largest value of each of ``points`` equal stretches of time; an empty stretch between two with signal is
    interpolated, so that a grid finer than the scans shows no holes."""
    ends = dense.groupBy("run").agg(F.min("minutes").alias("_a"), F.max("minutes").alias("_z"))
    d = dense.join(ends, "run").withColumn("cell", F.least(F.floor(points * F.coalesce(F.try_divide(F.col("minutes") - F.col("_a"), F.col("_z") - F.col("_a")), F.lit(0.0))), F.lit(points - 1)).cast("int"))
    p = d.groupBy("run", "group_id", "cell").agg(F.max("inten").alias("inten"))
    w = Window.partitionBy("run", "group_id").orderBy("cell")
    p = p.withColumn("_c", F.lead("cell").over(w)).withColumn("_v", F.lead("inten").over(w))
    gaps = p.filter((F.col("_c") - F.col("cell") > 1) & (F.col("inten") > 0) & (F.col("_v") > 0)).withColumn("k", F.explode(F.sequence(F.col("cell") + 1, F.col("_c") - 1)))
    between = F.col("inten") + (F.col("_v") - F.col("inten")) * (F.col("k") - F.col("cell")) / (F.col("_c") - F.col("cell"))
    return p.select("run", "group_id", "cell", "inten").unionByName(gaps.select("run", "group_id", F.col("k").alias("cell"), between.alias("inten")))


def clipped_histogram(df: DataFrame, key: list[str], value: Column, limit: float, bins: int = 61) -> DataFrame:
    """``(*key, bin, n)``: counts in ``bins`` equal bins of -limit..limit; values beyond go to the last ones."""
    x = F.least(F.greatest(value, F.lit(-limit)), F.lit(limit))
    b = F.least(F.floor((x + limit) / (2 * limit / bins)), F.lit(bins - 1)).cast("int")
    return df.filter(value.isNotNull()).groupBy(*key, b.alias("bin")).agg(F.count("*").alias("n"))


def search(features: DataFrame, text: str = "", ppm: float = 10.0, **ranges: tuple[float, float]) -> DataFrame:
    """Features under a conjunction: ``text`` is ``#id``, an m/z (within ``ppm``) or empty; ``ranges``: column to (low, high)."""
    d = features
    if text.startswith("#"):
        return d.filter(F.col("group_id") == int(text[1:]))
    for name, (lo, hi) in ranges.items():
        d = d.filter(F.col(name).between(lo, hi))
    if text:
        mz = float(text)
        return d.filter(F.abs(F.col("mz") - mz) <= mz * ppm / 1e6).orderBy(F.abs(F.col("mz") - mz), "group_id")
    return d.orderBy(F.col("mz").asc_nulls_last(), "group_id")


def wide_view(points: DataFrame, traces: DataFrame, cands: DataFrame, wide: float = 100.0, narrow: float = 10.0) -> DataFrame:
    """``(run, group_id, block, foreign)``: the share of a candidate's own scans that hold, beside it within ``wide`` ppm but not within ``narrow``, a centroid of at
    least a fifth of its intensity: another ion lives there."""
    own = traces.filter("inten > 0").join(cands.select("run", "group_id", "block", "scan_lo", "scan_hi").withColumnRenamed("block", "_b"), ["run", "group_id"])
    own = own.filter(F.col("scan").between(F.col("scan_lo"), F.col("scan_hi"))).select("run", "group_id", F.col("_b").alias("block"), "scan", F.col("mz").alias("mz_o"), F.col("inten").alias("inten_o"))
    p = valid_points(points).select("run", "scan", "mz", "inten")
    beside = band_join(own.select("run", "group_id", "block", "scan", "mz_o", "inten_o"), p, "mz_o", "mz", wide, ["run", "scan"], (F.abs(F.col("mz") - F.col("mz_o")) > F.col("mz_o") * narrow / 1e6) & (F.col("inten") >= 0.2 * F.col("inten_o")))
    n = own.groupBy("run", "group_id", "block").agg(F.countDistinct("scan").alias("n"))
    f = beside.groupBy("run", "group_id", "block").agg(F.countDistinct("scan").alias("f"))
    return n.join(f, ["run", "group_id", "block"], "left").select("run", "group_id", "block", (F.coalesce("f", F.lit(0)) / F.col("n")).alias("foreign"))


def electronic_mask(values: Column, least: int = 4, rel: float = 0.001) -> Column:
    """For the intensities of an array, whether each is one of ``least`` or more that agree with the smallest of their group to ``rel``: a new group starts at the first
    value beyond it. A fold over the sorted array."""
    s = F.array_sort(values)
    zero = F.array().cast("array<struct<lo:double,hi:double,n:int>>")
    tail = lambda a: F.try_element_at(a, F.lit(-1))

    def step(acc: Column, x: Column) -> Column:
        grows = (F.size(acc) > 0) & (x <= tail(acc)["lo"] * (1 + rel))
        grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(tail(acc)["lo"].alias("lo"), x.alias("hi"), (tail(acc)["n"] + 1).alias("n"))))
        return F.when(grows, grown).otherwise(F.concat(acc, F.array(F.struct(x.alias("lo"), x.alias("hi"), F.lit(1).alias("n")))))

    groups = F.filter(F.aggregate(s, zero, step), lambda g: g["n"] >= least)
    return F.transform(values, lambda x: F.exists(groups, lambda g: (x >= g["lo"]) & (x <= g["hi"])))


def strongest_shared(pairs: DataFrame, heights: DataFrame, most: int) -> DataFrame:
    """``(a, b, run, low, k)``: of the runs that show both ions of a pair the ``most`` whose weaker one is highest. ``heights(group_id, run, height)``."""
    h = heights.groupBy("group_id", "run").agg(F.max("height").alias("h"))
    j = pairs.select("a", "b").join(h.select(F.col("group_id").alias("a"), "run", F.col("h").alias("x")), "a").join(h.select(F.col("group_id").alias("b"), "run", F.col("h").alias("y")), ["b", "run"])
    j = j.select("a", "b", "run", F.least("x", "y").alias("low"))
    return j.withColumn("k", F.row_number().over(Window.partitionBy("a", "b").orderBy(F.col("low").desc(), "run"))).filter(F.col("k") <= most)


def calibration(spectra: DataFrame, key: str, ppm: float = 5.0, search_ppm: float = 50.0, per_bin: int = 100, most: int = 10, least: int = 30) -> DataFrame:
    """``(key, bin, knot_mz, knot_ppm, tolerance, n)`` of ``spectra(key, id, mz, d_ppm)``: the m/z error as medians of bins of equal count, at least ``per_bin`` each and at
    most ``most``; and three robust sd of what the bins' medians leave, ``ppm`` to ``search_ppm``. Keys of fewer than ``least`` spectra have no curve."""
    d = spectra.filter(F.col("mz").isNotNull() & F.col("d_ppm").isNotNull())
    w = Window.partitionBy(key).orderBy("mz", "id")
    d = d.withColumn("n", F.count("*").over(Window.partitionBy(key))).withColumn("_k", F.row_number().over(w) - 1).filter(F.col("n") >= least)
    bins = F.least(F.greatest(F.floor(F.col("n") / per_bin), F.lit(1)), F.lit(most))
    # the first bins hold one more where the count does not divide
    size, extra = F.floor(F.col("n") / bins), F.col("n") % bins
    d = d.withColumn("bin", F.when(F.col("_k") < extra * (size + 1), F.floor(F.col("_k") / (size + 1))).otherwise(extra + F.floor((F.col("_k") - extra * (size + 1)) / size)).cast("int"))
    m = d.groupBy(key, "bin").agg(F.median("mz").alias("knot_mz"), F.median("d_ppm").alias("knot_ppm"))
    r = d.join(m, [key, "bin"]).withColumn("r", F.col("d_ppm") - F.col("knot_ppm"))
    c = r.groupBy(key).agg(F.median("r").alias("_c"))
    s = r.join(c, key).groupBy(key).agg((3 * 1.4826 * F.median(F.abs(F.col("r") - F.col("_c")))).alias("_s"), F.first("n").alias("n"))
    return m.join(s, key).select(key, "bin", "knot_mz", "knot_ppm", F.least(F.lit(search_ppm), F.greatest(F.lit(ppm), F.col("_s"))).alias("tolerance"), "n")


def annotations(features: DataFrame, user: DataFrame, library: DataFrame, least: float = 0.7) -> DataFrame:
    """``(group_id, annotation, source, score)``: what is in force for each feature: the user's word, also an emptied one, before the library's best hit of ``least`` or more, else
    none. ``user(group_id, annotation, at)``: edits, of which the last one counts, a null clearing the one before; ``library(group_id, name, score)``: a row a feature."""
    last = user.groupBy("group_id").agg(F.max_by("annotation", "at").alias("_u")).filter("_u is not null")
    d = features.select("group_id").join(last, "group_id", "left").join(library.filter(F.col("score") >= least).select("group_id", "name", "score"), "group_id", "left")
    source = F.when(F.col("_u").isNotNull(), "user").when(F.col("name").isNotNull(), "library").otherwise("none")
    return d.select("group_id", F.coalesce("_u", "name", F.lit("")).alias("annotation"), source.alias("source"), F.when(source == "library", F.col("score")).alias("score"))


def retired(edits: DataFrame, old: DataFrame, new: DataFrame, ppm: float = 10.0, window: float = 0.1) -> DataFrame:
    """Edits carried to a new grouping: ``(group_id, annotation, at, retired)``. An edit goes to the nearest new feature of its old one's study within the tolerances; without one it
    keeps its old number and is marked retired. ``old`` and ``new``: ``(group_id, study, mz, rt)``."""
    a = old.select("group_id", "study", "mz", "rt")
    b = new.select(F.col("group_id").alias("to"), "study", F.col("mz").alias("mz_n"), F.col("rt").alias("rt_n"))
    m = band_join(a, b, "mz", "mz_n", ppm, ["study"], F.abs(F.col("rt_n") - F.col("rt")) <= window).groupBy("group_id").agg(F.min(F.struct(F.abs(F.col("rt_n") - F.col("rt")).alias("o"), "to")).alias("m"))
    d = edits.join(m, "group_id", "left")
    return d.select(F.coalesce("m.to", "group_id").alias("group_id"), "annotation", "at", F.col("m").isNull().cast("int").alias("retired"))


def smiles_formulas(df: DataFrame, key: str, smiles: str = "smiles") -> DataFrame:
    """``(key, formula)``: Hill formulas of SMILES texts; null for a text that is none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = [element_counts(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([hill_text(x) if x else None for x in c], pa.string())], names=[key, "formula"])

    return df.select(F.col(key).cast("bigint").alias(key), smiles).mapInArrow(work, f"{key} bigint, formula string")
