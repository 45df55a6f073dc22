"""Which ions of a study belong to one compound: correlations of their traces, their pooling over runs, consistent clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lcspark.operators.traces import study_of
from lcspark.session import materialise


def trace_pairs(dense: DataFrame) -> DataFrame:
    """``(run, a, b, n, sx, sy, xx, yy, xy, low)`` of each two ions of a run: the sums of their intensities over the scans that show either, and the height of
    the weaker. A study's steady ions are few, whatever its scans."""
    side = lambda x: dense.select("run", "scan", F.col("group_id").alias(x), F.col("inten").alias(f"i{x}"))
    j = side("a").join(side("b"), ["run", "scan"]).filter("a < b and (ia > 0 or ib > 0)")
    s = lambda x, y: F.sum(F.col(x) * F.col(y))
    g = j.groupBy("run", "a", "b").agg(F.count("*").alias("n"), F.sum("ia").alias("sx"), F.sum("ib").alias("sy"), s("ia", "ia").alias("xx"), s("ib", "ib").alias("yy"), s("ia", "ib").alias("xy"), F.max("ia").alias("_ha"), F.max("ib").alias("_hb"))
    return g.withColumn("low", F.least("_ha", "_hb")).drop("_ha", "_hb")


def pearson(n: str, sx: str, sy: str, xx: str, yy: str, xy: str):
    """Correlation from sums; null for fewer than three values or a constant side."""
    c = F.col
    va, vb = c(xx) - c(sx) * c(sx) / c(n), c(yy) - c(sy) * c(sy) / c(n)
    return F.when((c(n) >= 3) & (va > 0) & (vb > 0), (c(xy) - c(sx) * c(sy) / c(n)) / F.sqrt(va * vb))


def shape_correlations(pairs: DataFrame) -> DataFrame:
    """``(study, a, b, n_runs, weighted, median, pooled)``: a pair's correlation over the runs of its study: the mean of Fisher's z weighted by the log height
    of the weaker ion, the median, and one correlation of all scans together."""
    d = pairs.withColumn("study", study_of(F.col("run"))).withColumn("r", pearson("n", "sx", "sy", "xx", "yy", "xy"))
    w = F.when(F.col("r").isNotNull(), F.log10(F.greatest("low", F.lit(10.0))))
    z = w * F.atanh(F.least(F.greatest("r", F.lit(-0.999999)), F.lit(0.999999)))
    sums = [F.sum(c).alias(c) for c in ("n", "sx", "sy", "xx", "yy", "xy")]
    g = d.groupBy("study", "a", "b").agg(F.count("r").alias("n_runs"), F.tanh(F.sum(z) / F.sum(w)).alias("weighted"), F.median("r").alias("median"), *sums)
    return g.select("study", "a", "b", "n_runs", "weighted", "median", pearson("n", "sx", "sy", "xx", "yy", "xy").alias("pooled"))


def shared_runs(pairs: DataFrame, seen: DataFrame) -> DataFrame:
    """``pairs(a, b)`` that some run shows both of, with ``n_shared``. ``seen(group_id, run)``."""
    s = seen.select("group_id", "run").distinct()
    j = pairs.select("a", "b").join(s.withColumnRenamed("group_id", "a"), "a").join(s.withColumnRenamed("group_id", "b"), ["b", "run"])
    return j.groupBy("a", "b").agg(F.count("*").alias("n_shared"))


def height_correlations(pairs: DataFrame, heights: DataFrame, least: int = 6, ratio_least: int = 3, tol: float = 0.30103) -> DataFrame:
    """``(a, b, n, r, steady)`` of ``pairs(a, b)`` over the runs that show both, ``heights(group_id, run, height)``: the correlation of log heights (null below
    ``least`` runs or for a constant side) and the share of runs whose log ratio lies within ``tol`` of the pair's median (null below ``ratio_least``)."""
    h = heights.filter("height > 0").groupBy("group_id", "run").agg(F.log10(F.max("height")).alias("h"))
    j = pairs.select("a", "b").join(h.select(F.col("group_id").alias("a"), "run", F.col("h").alias("x")), "a").join(h.select(F.col("group_id").alias("b"), "run", F.col("h").alias("y")), ["b", "run"]).withColumn("q", F.col("y") - F.col("x"))
    g = j.groupBy("a", "b").agg(F.count("*").alias("n"), F.try_divide(F.covar_pop("x", "y"), F.nullif(F.stddev_pop("x") * F.stddev_pop("y"), F.lit(0.0))).alias("_r"), F.median("q").alias("_m"))
    s = j.join(g.select("a", "b", "_m"), ["a", "b"]).groupBy("a", "b").agg(F.avg((F.abs(F.col("q") - F.col("_m")) <= tol).cast("double")).alias("_s"))
    return g.join(s, ["a", "b"]).select("a", "b", "n", F.when(F.col("n") >= least, F.col("_r")).alias("r"), F.when(F.col("n") >= ratio_least, F.col("_s")).alias("steady"))


def consistent_clusters(members: DataFrame, pairs: DataFrame, cut: float, margin: float = 0.05, rounds: int = 4, may_leave: bool = True) -> DataFrame:
    """``(id, cluster)`` of ``members(id, cluster, w)`` and ``pairs(a, b, r)``: members that must agree with the rest of their cluster.

    A member's agreement with a cluster is the mean of its pair scores with the cluster's other members, weighted by their ``w``; pairs without a
    score count 0. A member that agrees with another cluster by ``cut`` and by ``margin`` more than with its own moves there (the best, then the
    smaller number); one below the cut with its own leaves for a cluster of its own. At most ``rounds`` passes, each from the state before it.
    Ids may be any bigint, hashes too.
    """
    both = materialise(pairs.select("a", "b", "r").union(pairs.select("b", "a", "r")).filter("r is not null and a != b"))
    # a cluster is the pass it was founded in and its number: sums of ids would overflow, or meet another cluster
    named = lambda k, n: F.struct(F.lit(k).alias("k"), F.col(n).cast("bigint").alias("n"))
    state = materialise(members.filter("cluster is not null").select("id", named(0, "cluster").alias("cluster"), F.col("w").cast("double").alias("w")))
    for k in range(rounds):
        total = state.groupBy("cluster").agg(F.sum("w").alias("_t"), F.count("*").alias("_n"))
        b = state.select(F.col("id").alias("b"), F.col("cluster").alias("c"), F.col("w").alias("wb"))
        s = both.join(b, "b").groupBy("a", "c").agg(F.sum(F.col("r") * F.col("wb")).alias("s"))
        s = s.join(total.withColumnRenamed("cluster", "c"), "c").join(state.select(F.col("id").alias("a"), F.col("cluster").alias("own"), F.col("w").alias("wa")), "a")
        rest = F.col("_t") - F.when(F.col("c") == F.col("own"), F.col("wa")).otherwise(0.0)
        s = s.withColumn("v", F.when(rest > 0, F.col("s") / rest))
        g = s.groupBy(F.col("a").alias("id")).agg(F.max(F.when(F.col("c") == F.col("own"), F.col("v"))).alias("mine"), F.max(F.when((F.col("c") != F.col("own")) & F.col("v").isNotNull(), F.struct("v", (-F.col("c.k")).alias("k"), F.bitwise_not("c.n").alias("n"), "c"))).alias("best"))
        d = state.join(total, "cluster").join(g, "id", "left").withColumn("mine", F.when(F.col("_n") > 1, F.coalesce("mine", F.lit(0.0))))
        move = F.coalesce((F.col("best.v") >= cut) & (F.col("mine").isNull() | (F.col("best.v") > F.col("mine") + margin)), F.lit(False))
        leave = F.coalesce(F.col("mine") < cut, F.lit(False)) & F.lit(may_leave)
        new = F.when(move, F.col("best.c")).when(leave, named(k + 1, "id")).otherwise(F.col("cluster"))
        state = materialise(d.select("id", new.alias("cluster"), "w", (new != F.col("cluster")).alias("changed")))
        if state.filter("changed").isEmpty():
            break
        state = state.drop("changed")
    name = state.groupBy("cluster").agg(F.max(F.struct("w", F.bitwise_not("id").alias("i"))).alias("m"))
    return state.join(name, "cluster").select("id", F.bitwise_not("m.i").alias("cluster"))
