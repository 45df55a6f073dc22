"""Shapes of ion traces: dense traces, smoothing, candidates with their descriptors, side levels, prominence and confirmation.

A trace is the highest centroid per scan near a target, 0 where a scan has none. Its windows order one ion of one run, whose rows the run's scans
bound; stretches of ``BLOCK`` scans are the candidates, so that descriptors are plain aggregates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lcspark.operators.traces import chromatogram, study_of, valid_points

BLOCK, HALF = 32, 0.5
#: Width of a target's bin in log m/z, and the share of a run's scans that an ion must be seen in.
BIN, LEAST_SHARE = 2e-5, 0.3


def steady_targets(points: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """``(study, group_id, mz)``: the m/z bins that some run of a study holds in ``least`` of its scans; ``group_id`` is the bin."""
    p = valid_points(points).select("run", "scan", F.floor(F.log("mz") / BIN).alias("bin"))
    total = p.groupBy("run").agg(F.countDistinct("scan").alias("total"))
    b = p.groupBy("run", "bin").agg(F.countDistinct("scan").alias("n")).join(total, "run").filter(F.col("n") >= least * F.col("total"))
    return b.select(study_of(F.col("run")).alias("study"), F.col("bin").alias("group_id")).distinct().withColumn("mz", F.exp((F.col("group_id") + 0.5) * BIN))


def dense_traces(points: DataFrame, times: DataFrame, targets: DataFrame, ppm: float = 10.0) -> DataFrame:
    """``(run, group_id, scan, minutes, mz, inten)``: every timed scan of a run for each target that the run shows at all."""
    e = chromatogram(points, targets, ppm)
    ions = e.select("run", "group_id").distinct()
    grid = times.select("run", "scan", "minutes").join(ions, "run")
    return grid.join(e, ["run", "group_id", "scan"], "left").select("run", "group_id", "scan", "minutes", "mz", F.coalesce("inten", F.lit(0.0)).alias("inten"))


def gaussian_weights(sd: float) -> list[float]:
    """A normalised kernel of 4 sd to both sides."""
    half = max(1, math.ceil(4 * sd))
    w = [math.exp(-0.5 * (k / sd) ** 2) for k in range(-half, half + 1)]
    return [x / sum(w) for x in w]


def gaussian_smooth(value: str, window, sd: float) -> Column:
    """Gaussian smoothing along ``window``, edge values repeated."""
    w = gaussian_weights(sd)
    half = len(w) // 2
    all_ = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(value).over(all_), F.last(value).over(all_)
    out = w[half] * F.col(value)
    for k in range(1, half + 1):
        out = out + w[half - k] * F.coalesce(F.lag(value, k).over(window), first) + w[half + k] * F.coalesce(F.lead(value, k).over(window), last)
    return out


def smoothed_traces(dense: DataFrame, sd: float = 1.5) -> DataFrame:
    """``dense`` with ``smooth``."""
    w = Window.partitionBy("run", "group_id").orderBy("scan")
    return dense.withColumn("smooth", gaussian_smooth("inten", w, sd))


def trace_noise(dense: DataFrame) -> DataFrame:
    """``(run, group_id, noise)``: a trace's scatter from scan to scan, of the median step between its present scans."""
    w = Window.partitionBy("run", "group_id").orderBy("scan")
    d = dense.filter("inten > 0").withColumn("_d", F.abs(F.col("inten") - F.lag("inten").over(w)))
    return d.groupBy("run", "group_id").agg(F.greatest(F.coalesce(F.median("_d"), F.lit(0.0)) / (0.6745 * math.sqrt(2)), F.lit(1e-9)).alias("noise"))


def candidates(dense: DataFrame) -> DataFrame:
    """Descriptors of each stretch of ``BLOCK`` scans of a trace: extent, apex, bounds, area over the present scans, width at half height, m/z and its
    scatter, baseline, signal to noise, total variation, valleys and the fit of a parabola to the log intensities."""
    d = dense.withColumn("block", F.floor(F.col("scan") / BLOCK))
    key = ["run", "group_id", "block"]
    w = Window.partitionBy(*key).orderBy("scan")
    all_ = Window.partitionBy(*key)
    p = d.filter("inten > 0").withColumn("height", F.max("inten").over(all_))
    p = p.withColumn("_dt", F.col("minutes") - F.lag("minutes").over(w)).withColumn("_di", F.col("inten") - F.lag("inten").over(w))
    p = p.withColumn("_valley", ((F.lag("inten").over(w) > 1.25 * F.col("inten")) & (F.lead("inten").over(w) > 1.25 * F.col("inten"))).cast("int"))
    first = lambda c: F.min(F.struct("scan", F.col(c).alias("v")))["v"]
    last = lambda c: F.max(F.struct("scan", F.col(c).alias("v")))["v"]
    half = F.col("inten") >= HALF * F.col("height")
    g = p.groupBy(*key).agg(
        F.max("inten").alias("height"), F.max(F.struct("inten", (-F.col("scan")).alias("s"), "minutes")).alias("_a"), F.min("scan").alias("scan_lo"), F.max("scan").alias("scan_hi"), F.count("*").alias("n_scans"),
        F.coalesce(F.sum(F.col("_dt") * (F.col("inten") + F.col("inten") - F.col("_di")) / 2), F.lit(0.0)).alias("area"), F.count_if(half).alias("n_half"), F.median("_dt").alias("dt"),
        (F.sum(F.when(half, F.col("mz") * F.col("inten"))) / F.sum(F.when(half, F.col("inten")))).alias("mz"), F.coalesce(F.stddev_pop("mz"), F.lit(0.0)).alias("_sd"),
        F.least(first("inten"), last("inten")).alias("baseline"), F.coalesce(F.sum(F.abs("_di")), F.lit(0.0)).alias("_tv"), (2 * F.max("inten") - first("inten") - last("inten")).alias("_rise"),
        F.coalesce(F.sum("_valley"), F.lit(0)).alias("n_valleys"), F.count_if(F.col("inten") >= 0.99 * F.col("height")).alias("n_flat"),
    )
    r = parabola_r2(p.withColumn("x", (F.col("scan") - F.col("block") * BLOCK).cast("double")).withColumn("y", F.log("inten")), key, "x", "y")
    c = g.join(r, key).join(trace_noise(dense), ["run", "group_id"])
    return c.select(
        *key, "height", (-F.col("_a.s")).alias("scan_apex"), F.col("_a.minutes").alias("rt"), "scan_lo", "scan_hi", "n_scans", (F.col("scan_hi") - F.col("scan_lo") + 1 - F.col("n_scans")).alias("n_gaps"), "area", (F.col("n_half") * F.col("dt")).alias("fwhm"), "dt",
        "mz", (F.col("_sd") / F.col("mz") * 1e6).alias("mz_sd_ppm"), "baseline", "noise", ((F.col("height") - F.col("baseline")) / F.col("noise")).alias("snr"), ((F.col("height") - F.col("baseline")) / F.col("height")).alias("prominence_rel"),
        F.coalesce(F.try_divide("_tv", "_rise"), F.lit(1.0)).alias("tv_ratio"), "n_valleys", "n_flat", "gauss_r2",
    )


def parabola_r2(df: DataFrame, key: list[str], x: str, y: str) -> DataFrame:
    """``(*key, gauss_r2)``: the share of the variance of ``y`` that a parabola in ``x`` explains, from sums alone; 0.5 for fewer than four rows or
    where the fit is singular or flat, never below 0."""
    p = lambda n, c=None: F.sum(F.pow(F.col(x), n) * (F.col(c) if c else F.lit(1.0)))
    g = df.groupBy(*key).agg(F.count("*").alias("n"), *[p(k).alias(f"s{k}") for k in range(1, 5)], *[p(k, y).alias(f"t{k}") for k in range(3)], F.sum(F.col(y) * F.col(y)).alias("q"))
    n, s1, s2, s3, s4, t0, t1, t2 = (F.col(c) for c in ("n", "s1", "s2", "s3", "s4", "t0", "t1", "t2"))
    # centred sums of the two regressors x and x²
    a, b, c = s2 - s1 * s1 / n, s3 - s1 * s2 / n, s4 - s2 * s2 / n
    u, v, total = t1 - s1 * t0 / n, t2 - s2 * t0 / n, F.col("q") - t0 * t0 / n
    det = a * c - b * b
    explained = (c * u * u - 2 * b * u * v + a * v * v) / det
    return g.select(*key, F.when((n >= 4) & (det > 1e-9) & (total > 1e-9), F.least(F.greatest(explained / total, F.lit(0.0)), F.lit(1.0))).otherwise(0.5).alias("gauss_r2"))


def side_levels(dense: DataFrame, cands: DataFrame, near: int = 16, far: int = 48) -> DataFrame:
    """``(run, group_id, block, ridge_ratio, background_ratio, ripple_ratio, far_level)``: the ion's own level ``near`` to ``far`` scans beside each
    apex, on the cleaner of the sides that hold three scans at least, as shares of the height; the ripple counts how often the rise above the level
    exceeds the side's scatter from scan to scan (null where that is 0)."""
    c = cands.select("run", "group_id", "block", "scan_apex", "height")
    c = c.withColumn("side", F.explode(F.array(F.lit(-1), F.lit(1))))
    lo = F.when(F.col("side") < 0, F.col("scan_apex") - far).otherwise(F.col("scan_apex") + near)
    c = c.withColumn("_lo", lo).withColumn("_hi", lo + (far - near)).withColumn("_b", F.explode(F.sequence(F.floor(lo / BLOCK), F.floor((lo + (far - near)) / BLOCK))))
    w = Window.partitionBy("run", "group_id").orderBy("scan")
    t = dense.select(F.col("run").alias("_r"), F.col("group_id").alias("_g"), "scan", "inten", (F.col("inten") - F.lag("inten").over(w)).alias("_d"), F.floor(F.col("scan") / BLOCK).alias("_k"))
    j = c.join(t, (F.col("run") == F.col("_r")) & (F.col("group_id") == F.col("_g")) & (F.col("_b") == F.col("_k")) & F.col("scan").between(F.col("_lo"), F.col("_hi")))
    s = j.groupBy("run", "group_id", "block", "side").agg(F.count("*").alias("n"), F.percentile("inten", 0.9).alias("q90"), F.percentile("inten", 0.25).alias("q25"), F.median("inten").alias("med"), F.median(F.when(F.col("inten") > 0, F.col("inten"))).alias("mednz"), F.median(F.abs("_d")).alias("ripple"))
    s = s.filter("n >= 3")
    g = s.groupBy("run", "group_id", "block").agg(F.min("q90").alias("q90"), F.min("q25").alias("q25"), F.min(F.struct("med", "side", "ripple")).alias("m"), F.min("mednz").alias("mednz"))
    out = cands.select("run", "group_id", "block", "height").join(g, ["run", "group_id", "block"], "left")
    share = lambda x: F.coalesce(F.col(x), F.lit(0.0)) / F.col("height")
    ripple = F.when(F.col("m.ripple") > 0, (F.col("height") - F.col("m.med")) / F.col("m.ripple"))
    return out.select("run", "group_id", "block", share("q90").alias("ridge_ratio"), share("q25").alias("background_ratio"), ripple.alias("ripple_ratio"), share("mednz").alias("far_level"))


def prominences(smooth: DataFrame, windows: DataFrame, reach: int = 64) -> DataFrame:
    """``(run, group_id, block, top, top_scan, is_apex, prominence, noise)`` of each of ``windows(run, group_id, block, scan_lo, scan_hi)``: the highest
    smoothed value inside, whether it is a local maximum, how far it stands above the higher of the two lowest points reached, on either side within
    ``reach`` scans, before anything higher; and 1.4826 times the median absolute deviation of the residuals outside the window."""
    key = ["run", "group_id", "block"]
    w = Window.partitionBy("run", "group_id").orderBy("scan")
    d = smooth.withColumn("_up", F.coalesce(F.col("smooth") >= F.lag("smooth").over(w), F.lit(True))).withColumn("_down", F.coalesce(F.col("smooth") >= F.lead("smooth").over(w), F.lit(True)))
    d = d.select(F.col("run").alias("_r"), F.col("group_id").alias("_g"), "scan", "inten", "smooth", "_up", "_down", F.floor(F.col("scan") / BLOCK).alias("_k"))
    at = (F.col("run") == F.col("_r")) & (F.col("group_id") == F.col("_g")) & (F.col("_b") == F.col("_k"))
    blocks = lambda lo, hi: F.explode(F.sequence(F.floor(lo / BLOCK), F.floor(hi / BLOCK)))
    q = windows.select(*key, "scan_lo", "scan_hi").withColumn("_b", blocks(F.col("scan_lo"), F.col("scan_hi")))
    top = q.join(d, at & F.col("scan").between(F.col("scan_lo"), F.col("scan_hi"))).groupBy(*key).agg(F.max(F.struct("smooth", (-F.col("scan")).alias("s"), "_up", "_down")).alias("m"), F.first("scan_lo").alias("scan_lo"), F.first("scan_hi").alias("scan_hi"))
    top = top.select(*key, "scan_lo", "scan_hi", F.col("m.smooth").alias("top"), (-F.col("m.s")).alias("top_scan"), (F.col("m._up") & F.col("m._down")).cast("int").alias("is_apex"))
    q = top.withColumn("_b", blocks(F.col("top_scan") - reach, F.col("top_scan") + reach))
    near = q.join(d, at & F.col("scan").between(F.col("top_scan") - reach, F.col("top_scan") + reach))
    wall = near.groupBy(*key).agg(F.max(F.when((F.col("smooth") > F.col("top")) & (F.col("scan") < F.col("top_scan")), F.col("scan"))).alias("wall_l"), F.min(F.when((F.col("smooth") > F.col("top")) & (F.col("scan") > F.col("top_scan")), F.col("scan"))).alias("wall_r"))
    near = near.join(wall, key)
    left = (F.col("scan") <= F.col("top_scan")) & (F.col("wall_l").isNull() | (F.col("scan") > F.col("wall_l")))
    right = (F.col("scan") >= F.col("top_scan")) & (F.col("wall_r").isNull() | (F.col("scan") < F.col("wall_r")))
    rest = F.when(~F.col("scan").between(F.col("scan_lo"), F.col("scan_hi")), F.col("inten") - F.col("smooth"))
    g = near.groupBy(*key).agg(F.min(F.when(left, F.col("smooth"))).alias("ml"), F.min(F.when(right, F.col("smooth"))).alias("mr"), F.median(rest).alias("mid"), F.median(F.col("inten") - F.col("smooth")).alias("mid_all"), F.count(rest).alias("n_rest"))
    near = near.join(g, key)
    mid = F.when(F.col("n_rest") >= 10, F.col("mid")).otherwise(F.col("mid_all"))
    use = F.when(F.col("n_rest") >= 10, rest).otherwise(F.col("inten") - F.col("smooth"))
    noise = near.groupBy(*key).agg((1.4826 * F.median(F.abs(use - mid))).alias("noise"))
    return top.join(g, key).join(noise, key).select(*key, "top", "top_scan", "is_apex", (F.col("top") - F.greatest("ml", "mr")).alias("prominence"), "noise")


def confirmed(shapes: DataFrame, reference: DataFrame, k: float = 3.0, least_top: float = 0.05) -> DataFrame:
    """``(run, group_id, block, top, confirmed)``: a filled window holds a peak of its own: a local maximum of at least ``least_top`` of the group's
    usual height that stands ``k`` times the noise out. ``reference(group_id, study, height, noise)``: the group's usual height and noise elsewhere."""
    d = shapes.withColumn("study", study_of(F.col("run"))).join(reference, ["study", "group_id"]).select("run", "group_id", "block", "top", "is_apex", "prominence", shapes["noise"].alias("own"), F.col("height"), reference["noise"].alias("ref"))
    ok = (F.col("is_apex") == 1) & (F.col("top") >= least_top * F.col("height")) & (F.col("prominence") >= k * F.greatest("own", "ref"))
    return d.select("run", "group_id", "block", "top", ok.cast("int").alias("confirmed"))


def eic_classes(shapes: DataFrame, cands: DataFrame, ppm: float = 10.0, k: float = 3.0) -> DataFrame:
    """``(run, group_id, block, class)``: a candidate's chromatogram is ``ok``, ``lowsnr`` (its prominence drowns in the noise), ``dup`` (a taller
    candidate of one m/z has the same maximum) or ``noapex`` (a slice of a slope); the later name wins."""
    c = cands.select("run", "group_id", "block", "mz", "height").join(shapes, ["run", "group_id", "block"])
    one = Window.partitionBy("run", "top_scan", F.round(F.log("mz") / (ppm * 1e-6))).orderBy(F.col("height").desc(), "group_id", "block")
    dup = F.row_number().over(one) > 1
    cls = F.when(F.col("is_apex") == 0, "noapex").when(dup, "dup").when(F.col("prominence") < k * F.col("noise"), "lowsnr").otherwise("ok")
    return c.select("run", "group_id", "block", cls.alias("class"))
