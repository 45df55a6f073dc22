"""Coarse and fine alignment of runs to a study's features: modes of differences, steps, running medians, monotone warps, weights of clusters.

Everything is an aggregate or a join on (run, bin) or (run, rank chunk); no run is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lcspark.band import band_join
from lcspark.session import materialise


def anchor_pairs(anchors: DataFrame, targets: DataFrame, ppm: float = 30.0, window: float = 0.5) -> DataFrame:
    """``(run, anchor, target, rt, d_rt, d_ppm)``: all pairs of a run's ``anchors(run, study, anchor, mz, rt)`` and the study's ``targets(study, target,
    mz_t, rt_t)`` within ``ppm`` and ``window`` minutes."""
    d = band_join(anchors, targets, "mz", "mz_t", 1.01 * ppm, ["study"], F.abs(F.col("rt_t") - F.col("rt")) <= window)
    d = d.withColumn("d_ppm", (F.col("mz") - F.col("mz_t")) / F.col("mz_t") * 1e6).filter(F.abs("d_ppm") <= ppm)
    return d.select("run", "anchor", "target", "rt", (F.col("rt_t") - F.col("rt")).alias("d_rt"), "d_ppm")


def histogram_mode(df: DataFrame, key: list[str], value: str, width: float, smooth: int) -> DataFrame:
    """``(*key, centre)``: the centre of the fullest bin of ``value`` after each bin was summed with ``smooth`` bins to both sides, the lowest on ties.
    A filled bin gives its count to its neighbours, so that empty bins between two full ones are seen."""
    n = df.groupBy(*key, F.floor(F.col(value) / width).alias("_k")).agg(F.count("*").alias("_n"))
    n = n.withColumn("_k", F.explode(F.sequence(F.col("_k") - smooth, F.col("_k") + smooth))).groupBy(*key, "_k").agg(F.sum("_n").alias("_n"))
    best = n.groupBy(*key).agg(F.max(F.struct("_n", (-F.col("_k")).alias("k"))).alias("_b"))
    return best.select(*key, ((-F.col("_b.k") + 0.5) * width).alias("centre"))


def _scatter(df: DataFrame, key: list[str], value: str, centre: str) -> DataFrame:
    """``(*key, n, mad)`` of ``value`` about its own median."""
    m = df.groupBy(*key).agg(F.median(value).alias("_m"), F.count("*").alias("n"))
    return df.join(m, key).groupBy(*key).agg(F.first("n").alias("n"), F.median(F.abs(F.col(value) - F.col("_m"))).alias("mad"))


def coarse_shift(pairs: DataFrame, width: float = 0.02) -> DataFrame:
    """``(run, delta, support, sigma)``: the mode of the time differences of a run's pairs, refined to the median of those within one and a half bins;
    the scatter of those within three bins, a quarter of a bin at least."""
    c = histogram_mode(pairs, ["run"], "d_rt", width, 1)
    d = pairs.join(c, "run")
    near = d.filter(F.abs(F.col("d_rt") - F.col("centre")) <= 1.5 * width).groupBy("run").agg(F.median("d_rt").alias("delta"), F.count("*").alias("support"))
    wide = _scatter(pairs.join(near, "run").filter(F.abs(F.col("d_rt") - F.col("delta")) <= 3 * width), ["run"], "d_rt", "delta")
    sigma = F.greatest(F.when(F.col("n") > 2, 1.4826 * F.col("mad")).otherwise(width), F.lit(0.25 * width))
    return near.join(wide, "run").select("run", "delta", "support", sigma.alias("sigma"))


def mz_modes(pairs: DataFrame, search: float = 30.0, width: float = 0.5) -> DataFrame:
    """``(run, mode, offset, support, half, background)``: up to two modes of the m/z differences of a run's pairs, the second among those beyond twice
    the first one's half-width (three robust sd, 1 to 5 ppm); ``background``: pairs that an even spread would put into the first mode."""
    out = []
    rest = pairs.select("run", "d_ppm")
    total = pairs.groupBy("run").agg(F.count("*").alias("_all"))
    for mode in (1, 2):
        c = histogram_mode(rest, ["run"], "d_ppm", width, 2)
        near = rest.join(c, "run").filter(F.abs(F.col("d_ppm") - F.col("centre")) <= 3.0)
        s = _scatter(near.drop("centre"), ["run"], "d_ppm", "centre").join(near.groupBy("run").agg(F.median("d_ppm").alias("c")), "run")
        m = s.select("run", "c", F.least(F.greatest(3 * 1.4826 * F.col("mad"), F.lit(1.0)), F.lit(5.0)).alias("half"))
        m = materialise(m)
        inside = pairs.join(m, "run").filter(F.abs(F.col("d_ppm") - F.col("c")) <= F.col("half")).groupBy("run").agg(F.median("d_ppm").alias("offset"), F.count("*").alias("support"))
        out.append(m.join(inside, "run").select("run", F.lit(mode).alias("mode"), "offset", "support", "half"))
        rest = rest.join(m, "run").filter(F.abs(F.col("d_ppm") - F.col("c")) > 2 * F.col("half")).select("run", "d_ppm")
    first = out[0].join(total, "run").select("run", ((F.col("_all") - F.col("support")) * F.col("half") / F.greatest(search - F.col("half"), F.lit(1e-9))).alias("background"))
    return out[0].unionByName(out[1]).join(first, "run")


def labelled_pairs(pairs: DataFrame, modes: DataFrame) -> DataFrame:
    """``(run, anchor, rt, d_ppm, mode)``: of each anchor's pairs the one deepest inside a mode of its run, by its distance to the mode's edge."""
    m = modes.select("run", "mode", "offset", "half")
    d = pairs.join(m, "run").withColumn("_in", F.abs(F.col("d_ppm") - F.col("offset")) - F.col("half")).filter("_in <= 0")
    best = d.groupBy("run", "anchor").agg(F.min(F.struct("_in", "target", "mode", "rt", "d_ppm")).alias("b"))
    return best.select("run", "anchor", "b.rt", "b.d_ppm", "b.mode")


def moved_medians(df: DataFrame, key: str, order: list[str], value: str, share: int = 4, least: int = 9, most: int = 51, few: int = 10) -> DataFrame:
    """``df`` with ``median``: the median of ``value`` in a window of ranks about each row: a quarter of its group's rows, ``least`` to ``most`` and odd, moved
    inward at the ends rather than cut. Groups of fewer than ``few`` rows have none.

    Rows are ranked per group and cut into chunks of ``most`` ranks; a window meets its own chunk and the next ones only.
    """
    d = df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    size = F.least(F.col("_n"), F.least(F.greatest(F.floor(F.col("_n") / share), F.lit(least)), F.lit(most)))
    size = F.least(F.col("_n"), size.bitwiseOR(F.lit(1)))
    d = d.withColumn("_size", size).withColumn("_a", F.least(F.greatest(F.col("_k") - F.floor(F.col("_size") / 2), F.lit(0)), F.col("_n") - F.col("_size"))).withColumn("_z", F.col("_a") + F.col("_size") - 1)
    d = materialise(d)
    at = d.filter(F.col("_n") >= few).select(key, "_k", "_a", "_z").withColumn("_c", F.explode(F.sequence(F.floor(F.col("_a") / most), F.floor(F.col("_z") / most))))
    v = d.select(key, F.col("_k").alias("_j"), F.floor(F.col("_k") / most).alias("_c"), F.col(value).alias("_v"))
    g = at.join(v, [key, "_c"]).filter(F.col("_j").between(F.col("_a"), F.col("_z"))).groupBy(key, "_k").agg(F.median("_v").alias("median"))
    return d.join(g, [key, "_k"], "left").drop("_k", "_n", "_size", "_a", "_z")


def label_steps(labelled: DataFrame, least: int = 5, pure: float = 0.8) -> DataFrame:
    """``(run, at, before, after, wrong)``: a calibration jump as one step: where the two modes' labels, ordered by time, switch with the fewest points on
    the wrong side, in either order; each side's median of its own label. Runs whose labels interleave, or with a side of fewer than ``least`` points
    of its label, have no step."""
    w = Window.partitionBy("run").orderBy("rt", "anchor")
    d = labelled.filter("mode in (1, 2)").withColumn("_k", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy("run")))
    d = d.withColumn("_ones", F.sum((F.col("mode") == 1).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_next", F.lead("rt").over(w)).withColumn("_all", F.sum((F.col("mode") == 1).cast("int")).over(Window.partitionBy("run")))
    d = materialise(d)
    # order 1: the first mode stands before the cut
    wrong1 = F.col("_k") - F.col("_ones") + F.col("_all") - F.col("_ones")
    cuts = d.filter("_k < _n").withColumn("o", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("wrong", F.when(F.col("o") == 1, wrong1).otherwise(F.col("_n") - wrong1))
    best = cuts.groupBy("run").agg(F.min(F.struct("wrong", "o", "_k", ((F.col("rt") + F.col("_next")) / 2).alias("at"))).alias("b")).select("run", "b.*").withColumnRenamed("_k", "cut")
    j = d.join(best, "run")
    left = (F.col("_k") <= F.col("cut")) & (F.col("mode") == F.col("o"))
    right = (F.col("_k") > F.col("cut")) & (F.col("mode") != F.col("o"))
    g = j.groupBy("run").agg(F.first("at").alias("at"), F.first("wrong").alias("wrong"), F.first("cut").alias("cut"), F.first("_n").alias("n"), F.count_if(left).alias("l"), F.count_if(right).alias("r"), F.median(F.when(left, F.col("d_ppm"))).alias("before"), F.median(F.when(right, F.col("d_ppm"))).alias("after"))
    ok = (F.col("l") >= pure * F.col("cut")) & (F.col("r") >= pure * (F.col("n") - F.col("cut"))) & (F.col("l") >= least) & (F.col("r") >= least) & (F.col("n") >= 2 * least)
    return g.filter(ok).select("run", "at", "before", "after", "wrong")


def isotonic(df: DataFrame, key: str, order: str, value: str, weight: str) -> DataFrame:
    """``df`` with ``fit``: the weighted increasing regression of ``value`` along ``order`` in each group, by its min-max form: the largest, over starts up to a
    row, of the smallest weighted mean to any end from that row on. For groups of few rows, such as knots: it joins a group's rows with its spans."""
    w = Window.partitionBy(key).orderBy(order)
    d = df.withColumn("_k", F.row_number().over(w)).withColumn("_w", F.sum(weight).over(w)).withColumn("_s", F.sum(F.col(weight) * F.col(value)).over(w))
    d = materialise(d)
    starts = d.select(F.col(key).alias("_g"), F.col("_k").alias("_j"), (F.col("_w") - F.col(weight)).alias("_w0"), (F.col("_s") - F.col(weight) * F.col(value)).alias("_s0"))
    ends = d.select(F.col(key).alias("_h"), F.col("_k").alias("_e"), F.col("_w").alias("_w1"), F.col("_s").alias("_s1"))
    span = starts.join(ends, (F.col("_g") == F.col("_h")) & (F.col("_e") >= F.col("_j"))).select("_g", "_j", "_e", ((F.col("_s1") - F.col("_s0")) / (F.col("_w1") - F.col("_w0"))).alias("m"))
    # for each start the smallest mean to an end from a row on
    low = span.withColumn("_low", F.min("m").over(Window.partitionBy("_g", "_j").orderBy(F.col("_e").desc())))
    fit = low.groupBy("_g", "_e").agg(F.max("_low").alias("fit"))
    return d.join(fit, (F.col(key) == F.col("_g")) & (F.col("_k") == F.col("_e"))).drop("_k", "_w", "_s", "_g", "_e")


def start_clusters(df: DataFrame, key: str, order: str, tie: str, tol: float) -> DataFrame:
    """``df`` with ``cluster`` (the number of its cluster's first row) and ``weight`` (one over the cluster's rows): a cluster starts at its first row and takes
    the following ones within ``tol`` of that start, so that clusters never chain.

    Gaps wider than ``tol`` always cut: stretches between them are folded on their own, in order, as arrays.
    """
    w = Window.partitionBy(key).orderBy(order, tie)
    d = df.withColumn("_k", F.row_number().over(w)).withColumn("_new", F.when(F.col(order) - F.lag(order).over(w) <= tol, 0).otherwise(1)).withColumn("_part", F.sum("_new").over(w)).drop("_new")
    d = materialise(d)
    rows = d.groupBy(key, "_part").agg(F.array_sort(F.collect_list(F.struct("_k", F.col(order).cast("double").alias("x")))).alias("a"))
    zero = F.array().cast("array<struct<_k:int,x:double,c:int,s:double>>")
    # a folded row carries its cluster and where that started
    step = lambda acc, r: F.when((F.size(acc) > 0) & (r["x"] - F.try_element_at(acc, F.lit(-1))["s"] <= tol), F.concat(acc, F.array(F.struct(r["_k"].alias("_k"), r["x"].alias("x"), F.try_element_at(acc, F.lit(-1))["c"].alias("c"), F.try_element_at(acc, F.lit(-1))["s"].alias("s"))))).otherwise(F.concat(acc, F.array(F.struct(r["_k"].alias("_k"), r["x"].alias("x"), r["_k"].alias("c"), r["x"].alias("s")))))
    c = rows.select(key, F.explode(F.aggregate("a", zero, step)).alias("f")).select(key, F.col("f._k").alias("_k"), F.col("f.c").alias("cluster"))
    n = c.groupBy(key, "cluster").agg(F.count("*").alias("_n"))
    return d.join(c, [key, "_k"]).join(n, [key, "cluster"]).withColumn("weight", 1 / F.col("_n")).drop("_k", "_part", "_n")


def rolling_reference(df: DataFrame, key: str, order: str, value: str, width: int = 101, stride: int = 10, cover: float = 0.5) -> DataFrame:
    """``(key, centre, reference, n)``: the median of ``value`` over ``width`` places about every ``stride``-th one, where at least ``cover`` of them are filled.
    A row is sent to the centres that it reaches, which are as many for every row."""
    half = width // 2
    lo = F.ceil((F.col(order) - half) / stride)
    hi = F.floor((F.col(order) + half) / stride)
    d = df.filter(F.col(value).isNotNull()).select(key, F.col(value).alias("_v"), F.explode(F.sequence(F.greatest(lo, F.lit(0)), hi)).alias("_c"))
    g = d.groupBy(key, "_c").agg(F.median("_v").alias("reference"), F.count("*").alias("n"))
    return g.filter(F.col("n") >= cover * width).select(key, (F.col("_c") * stride).alias("centre"), "reference", "n")


def two_factor_nnls(df: DataFrame, key: list[str], y: str, a: str, b: str) -> DataFrame:
    """``(*key, u, v, residual)``: y = u a + v b with u, v >= 0 in closed form, and the root of the mean squared residual: the free solution where it is not
    negative, else the better of the two single ones."""
    s = df.groupBy(*key).agg(*[F.sum(F.col(p) * F.col(q)).alias(n) for n, p, q in (("aa", a, a), ("ab", a, b), ("bb", b, b), ("ay", a, y), ("by", b, y), ("yy", y, y))], F.count("*").alias("n"))
    aa, ab, bb, ay, by, yy = (F.col(c) for c in ("aa", "ab", "bb", "ay", "by", "yy"))
    det = aa * bb - ab * ab
    fu, fv = F.try_divide(ay * bb - by * ab, det), F.try_divide(by * aa - ay * ab, det)
    free = F.coalesce((fu >= 0) & (fv >= 0) & (det > 1e-12 * aa * bb), F.lit(False))
    ua, vb = F.greatest(F.coalesce(F.try_divide(ay, aa), F.lit(0.0)), F.lit(0.0)), F.greatest(F.coalesce(F.try_divide(by, bb), F.lit(0.0)), F.lit(0.0))
    only_a = (yy - 2 * ua * ay + ua * ua * aa) <= (yy - 2 * vb * by + vb * vb * bb)
    u = F.when(free, fu).when(only_a, ua).otherwise(0.0)
    v = F.when(free, fv).when(only_a, F.lit(0.0)).otherwise(vb)
    s = s.withColumn("u", u).withColumn("v", v)
    rss = yy - 2 * F.col("u") * ay - 2 * F.col("v") * by + F.col("u") * F.col("u") * aa + 2 * F.col("u") * F.col("v") * ab + F.col("v") * F.col("v") * bb
    return s.select(*key, "u", "v", F.sqrt(F.greatest(rss / F.col("n"), F.lit(0.0))).alias("residual"))
