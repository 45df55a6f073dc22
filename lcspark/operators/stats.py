"""Order statistics and correlations of groups, as aggregates and window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_quantile(df: DataFrame, group: list[str], value: str, weight: str, tie: str, q: float = 0.5) -> DataFrame:
    """``(*group, value)``: the lower weighted quantile, the first value whose running weight reaches ``q`` of the total. Weights of 0 or below don't count."""
    d = df.filter((F.col(weight) > 0) & F.col(value).isNotNull())
    w = Window.partitionBy(*group).orderBy(value, tie)
    d = d.withColumn("_cum", F.sum(weight).over(w)).withColumn("_all", F.sum(weight).over(Window.partitionBy(*group)))
    return d.filter(F.col("_cum") >= q * F.col("_all")).groupBy(*group).agg(F.min(value).alias(value))


def ion_pairs(points: DataFrame, least: int = 6, tol: float = 0.3010299956639812, shared: int = 3) -> DataFrame:
    """``(run, bin_a, bin_b, n, pearson, corr, stability)`` of ``points(run, bin, scan, i)``, one row for each scan of a bin: pairs of bins that share
    at least ``shared`` scans.

    ``pearson``: of the intensities over the scans of either, 0 where one is missing; ``corr``: of their logarithms over the scans of both, null
    below ``least``; ``stability``: the share of those whose log ratio lies within ``tol`` of the pair's median.
    """
    keys = ["run", "bin_a", "bin_b"]
    totals = points.groupBy("run", "bin").agg(F.count("*").alias("n"), F.sum("i").alias("s"), F.sum(F.col("i") * F.col("i")).alias("q")).filter(F.col("n") >= shared)
    side = lambda x: points.select("run", "scan", F.col("bin").alias(f"bin_{x}"), F.col("i").alias(f"i_{x}"), F.log10("i").alias(f"l_{x}"))
    of = lambda x: totals.select("run", F.col("bin").alias(f"bin_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "s", "q")])
    j = side("a").join(side("b"), ["run", "scan"]).filter("bin_a < bin_b").withColumn("r", F.col("l_a") - F.col("l_b"))
    log = F.try_divide(F.covar_pop("l_a", "l_b"), F.stddev_pop("l_a") * F.stddev_pop("l_b"))
    g = j.groupBy(keys).agg(F.count("*").alias("n"), log.alias("_c"), F.sum(F.col("i_a") * F.col("i_b")).alias("ab"), F.median("r").alias("_m")).filter(F.col("n") >= shared)
    near = j.join(g.select(*keys, "_m"), keys).groupBy(keys).agg(F.avg((F.abs(F.col("r") - F.col("_m")) <= tol).cast("double")).alias("stability"))
    d = g.join(near, keys).join(of("a"), ["run", "bin_a"]).join(of("b"), ["run", "bin_b"]).withColumn("_u", F.col("n_a") + F.col("n_b") - F.col("n"))
    var = lambda x: F.col(f"q_{x}") - F.col(f"s_{x}") * F.col(f"s_{x}") / F.col("_u")
    pearson = F.when((var("a") > 0) & (var("b") > 0), (F.col("ab") - F.col("s_a") * F.col("s_b") / F.col("_u")) / F.sqrt(var("a") * var("b")))
    return d.select(*keys, "n", pearson.alias("pearson"), F.when(F.col("n") >= least, F.col("_c")).alias("corr"), "stability")


def mad(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """``(*group, median, mad)``: median and unscaled median absolute deviation."""
    m = df.groupBy(*group).agg(F.median(value).alias("median"))
    return df.join(m, group).groupBy(*group).agg(F.first("median").alias("median"), F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))


def loo_median(df: DataFrame, group: list[str], value: str, tie: str) -> DataFrame:
    """``df`` with ``loo``: the median of the *other* rows of the group, null in a group of one.

    Without the row at rank r the others' k-th value is that of rank k or k + 1, so four ranks around the middle serve the whole group.
    """
    all_ = Window.partitionBy(*group)
    d = df.withColumn("_r", F.row_number().over(all_.orderBy(value, tie))).withColumn("_n", F.count("*").over(all_))
    at = lambda k: F.max(F.when(F.col("_r") == k, F.col(value))).over(all_)
    lo, hi = F.floor(F.col("_n") / 2), F.floor((F.col("_n") + 1) / 2)
    d = d.withColumn("_a", at(lo)).withColumn("_a1", at(lo + 1)).withColumn("_b", at(hi)).withColumn("_b1", at(hi + 1))
    first = F.when(F.col("_r") > lo, F.col("_a")).otherwise(F.col("_a1"))
    second = F.when(F.col("_r") > hi, F.col("_b")).otherwise(F.col("_b1"))
    return d.withColumn("loo", F.when(F.col("_n") > 1, (first + second) / 2)).drop("_r", "_n", "_a", "_a1", "_b", "_b1")


def mode(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """``(*group, value, n)``: the most frequent value, the smallest on ties."""
    n = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    best = n.groupBy(*group).agg(F.min(F.struct((-F.col("n")).alias("_n"), F.col(value).alias("v"))).alias("_b"))
    return best.select(*group, F.col("_b.v").alias(value), (-F.col("_b._n")).alias("n"))


def average_rank(value: str, partition: list[str]) -> Column:
    """Rank with ties at their average."""
    w = Window.partitionBy(*partition)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(w.partitionBy(*partition, value)) - 1) / 2.0


def spearman(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """``(*group, rho, n)`` over rows where both are known."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = d.withColumn("_x", average_rank(x, group)).withColumn("_y", average_rank(y, group))
    return d.groupBy(*group).agg(F.try_divide(F.covar_pop("_x", "_y"), F.stddev_pop("_x") * F.stddev_pop("_y")).alias("rho"), F.count("*").alias("n"))


def confusion(df: DataFrame, group: list[str], truth: Column, called: Column) -> DataFrame:
    """Counts and rates of a two-class call; nulls count as false."""
    t, c = F.coalesce(truth, F.lit(False)), F.coalesce(called, F.lit(False))
    d = df.groupBy(*group).agg(F.count_if(t & c).alias("tp"), F.count_if(t & ~c).alias("fn"), F.count_if(~t & c).alias("fp"), F.count_if(~t & ~c).alias("tn"))
    return d.withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn"))).withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("fpr", F.try_divide("fp", F.col("fp") + F.col("tn")))


def spread_rank(df: DataFrame, keys: list[str], score: str, order: list[Column], step: float) -> DataFrame:
    """``df`` with ``rank``: the place of each row in its group, ``score`` falling, then ``order``. Rows are ranked inside steps of the score, and a step starts behind the
    rows of all higher ones, so that a group of any size is sorted in as many tasks as its scores have steps."""
    d = df.withColumn("_s", F.floor(F.greatest(F.least(F.col(score) / step, F.lit(1e9)), F.lit(-1e9))))
    n = d.groupBy(*keys, "_s").agg(F.count("*").alias("_n"))
    above = F.sum("_n").over(Window.partitionBy(*keys).orderBy(F.col("_s").desc()).rowsBetween(Window.unboundedPreceding, -1))
    n = n.withColumn("_above", F.coalesce(above, F.lit(0))).drop("_n")
    w = Window.partitionBy(*keys, "_s").orderBy(F.col(score).desc(), *order)
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_s"]]
    j = d.alias("a").join(n.alias("b"), on).select("a.*", "b._above")
    return j.withColumn("rank", (F.row_number().over(w) + F.col("_above")).cast("int")).drop("_s", "_above")
