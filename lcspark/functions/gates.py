"""Gates, flags and the score of candidate features, as expressions on their descriptors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Limits of the gates, in the order in which a rejected candidate is given its reason.
LEAST_SNR, LEAST_PROMINENCE, RIDGE_MOST, BACKGROUND_MOST, FAR_MOST, LEAST_RIPPLE = 3.0, 0.2, 0.5, 1 / 3, 0.5, 3.0
#: Width rule: share of the median width of so many neighbours in time, needed number of them; and the quantile rule.
NARROW_SHARE, NARROW_NEAR, NARROW_LEAST, NARROW_QUANTILE = 0.3, 100, 30, 0.02


def sigma_ppm(inten: Column, a: float, b: float, factors: tuple[float, ...] = (), top: float = 7.0) -> Column:
    """Scatter of m/z at an intensity, sqrt(a² + b² / I), times the saturation factor of its quarter decade below ``top`` (1 past the list's end, the
    first one above)."""
    base = F.sqrt(a * a + b * b / inten)
    if not factors:
        return base
    k = F.greatest(F.floor((top - F.log10(inten)) * 4), F.lit(0)).cast("int")
    return base * F.coalesce(F.try_element_at(F.array(*[F.lit(float(f)) for f in factors]), k + 1), F.lit(1.0))


def least_scans(width: Column, dt: Column) -> Column:
    """Scans a peak must have: half its run's usual width counted in its own scan interval, 3 to 5."""
    return F.least(F.greatest(F.round(0.5 * width / dt), F.lit(3)), F.lit(5)).cast("int")


def nearby_widths(df: DataFrame, near: int = NARROW_NEAR, share: float = NARROW_SHARE, quantile: float = NARROW_QUANTILE, least: int = NARROW_LEAST) -> DataFrame:
    """``df(run, id, rt, fwhm, passed)`` with ``narrow_median`` and ``narrow_quantile``: the width limits from the ``near`` passing candidates of the run that
    elute nearest by rank, the window moved inward at the ends; null in a run of fewer than ``least`` of them.

    Ranks are cut into chunks of ``near``: a limit needs its own chunk and its neighbours, so that windows stay short.
    """
    p = df.filter("passed").select("run", "rt", "id", "fwhm").withColumn("_k", F.row_number().over(Window.partitionBy("run").orderBy("rt", "id")) - 1).withColumn("_n", F.count("*").over(Window.partitionBy("run")))
    size = F.least(F.lit(near), F.col("_n"))
    start = F.least(F.greatest(F.col("_k") - F.floor(size / 2), F.lit(0)), F.col("_n") - size)
    at = p.filter(F.col("_n") >= least).withColumn("_a", start).withColumn("_z", start + size - 1).select("run", "id", "_a", "_z")
    at = at.withColumn("_c", F.explode(F.sequence(F.floor(F.col("_a") / near), F.floor(F.col("_z") / near))))
    v = p.select("run", F.col("_k").alias("_j"), F.floor(F.col("_k") / near).alias("_c"), F.col("fwhm").alias("_w"))
    g = at.join(v, ["run", "_c"]).filter(F.col("_j").between(F.col("_a"), F.col("_z"))).groupBy("run", "id").agg((share * F.median("_w")).alias("narrow_median"), F.percentile("_w", quantile).alias("narrow_quantile"))
    return df.join(g, ["run", "id"], "left")


def reasons(sigma: Column, min_scans: Column) -> Column:
    """Names of the gates that a candidate fails, in their order; empty for one that passes all."""
    c = F.col
    fails = [
        ("scans", c("n_scans") < min_scans), ("snr", c("snr") < LEAST_SNR), ("mz_sd", c("mz_sd_ppm") > 3 * sigma + 1), ("prominence", c("prominence_rel") < LEAST_PROMINENCE), ("ridge", c("ridge_ratio") > RIDGE_MOST),
        ("background", c("background_ratio") > BACKGROUND_MOST), ("ripple", F.coalesce(c("ripple_ratio") < LEAST_RIPPLE, F.lit(False))), ("far", c("far_level") > FAR_MOST),
    ]
    return F.array_compact(F.array(*[F.when(x, n) for n, x in fails]))


def flags(width: Column, last_scan: Column) -> Column:
    """What is odd about a candidate, joined in a fixed order."""
    c = F.col
    odd = [("edge", (c("scan_lo") <= 1) | (c("scan_hi") >= last_scan)), ("gap", c("n_gaps") > 0), ("wide", c("fwhm") > 5 * width), ("ridge", c("ridge_ratio") > RIDGE_MOST), ("flat_top", c("n_flat") >= 3), ("lumpy", c("n_valleys") >= 2)]
    return F.array_join(F.array_compact(F.array(*[F.when(x, n) for n, x in odd])), ";")


def rule_score(sigma: Column, width: Column, support: Column | None = None) -> Column:
    """Geometric mean of seven terms of 0 to 1: signal, shape, m/z scatter, prominence, scans, localisation, one rise and fall; 0.15 more with an
    isotope's support."""
    c = F.col
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    terms = [
        (F.log2(F.greatest(c("snr"), F.lit(1e-9))) - F.log2(F.lit(3.0))) / (F.log2(F.lit(50.0)) - F.log2(F.lit(3.0))), c("gauss_r2"), 1 - c("mz_sd_ppm") / (3 * sigma + 1), c("prominence_rel"), c("n_scans") * c("dt") / width,
        1 - c("far_level"), 1 / F.greatest(c("tv_ratio"), F.lit(1e-9)),
    ]
    product = F.lit(1.0)
    for t in terms:
        product = product * clip(t)
    score = F.pow(product, 1 / len(terms))
    return score if support is None else F.when(support, F.least(F.lit(1.0), score + 0.15)).otherwise(score)
