"""What scans share: gains and m/z shifts of whole scans, saturated tops, widths at half height, peaks by prominence, cut-off pieces, split groups."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lcspark.band import band_join
from lcspark.operators.compounds import components
from lcspark.operators.features import feature_pairs
from lcspark.operators.shape import BLOCK, prominences
from lcspark.operators.traces import valid_points
from lcspark.session import keyed, materialise


def half_widths(dense: DataFrame, cands: DataFrame) -> DataFrame:
    """``(run, group_id, block, left, right)``: the times at which a candidate's trace, zeros included, crosses half its height on either side of the apex, interpolated between scans; null
    on a side where it does not fall so far."""
    key = ["run", "group_id", "block"]
    w = Window.partitionBy(*key).orderBy("scan")
    d = dense.withColumn("block", F.floor(F.col("scan") / BLOCK)).join(cands.select(*key, "scan_apex", "height"), key)
    for name, f in (("n", F.lead), ("p", F.lag)):
        d = d.withColumn(f"_m{name}", f("minutes").over(w)).withColumn(f"_i{name}", f("inten").over(w))
    half = F.col("height") / 2
    below = F.col("inten") < half
    cross = lambda m, i: F.col("minutes") + F.try_divide((F.col(m) - F.col("minutes")) * (half - F.col("inten")), F.col(i) - F.col("inten"))
    d = d.withColumn("_l", F.when(below & (F.col("scan") < F.col("scan_apex")), F.struct("scan", cross("_mn", "_in").alias("x")))).withColumn("_r", F.when(below & (F.col("scan") > F.col("scan_apex")), F.struct("scan", cross("_mp", "_ip").alias("x"))))
    return d.groupBy(*key).agg(F.max("_l").alias("l"), F.min("_r").alias("r")).select(*key, F.col("l.x").alias("left"), F.col("r.x").alias("right"))


def scan_gains(dense: DataFrame, least: int = 5) -> DataFrame:
    """``(run, scan, n, gain)``: how much more a scan shows than its run's usual: the median over its ions of the log intensity about the trace's own median, as a factor. Scans of fewer than
    ``least`` ions have none."""
    p = dense.filter("inten > 0").withColumn("y", F.log("inten"))
    m = p.groupBy("run", "group_id").agg(F.median("y").alias("_m"))
    return p.join(m, ["run", "group_id"]).groupBy("run", "scan").agg(F.count("*").alias("n"), F.exp(F.median(F.col("y") - F.col("_m"))).alias("gain")).filter(F.col("n") >= least)


def scan_shifts(dense: DataFrame, least: int = 12) -> DataFrame:
    """``(run, scan, n, a, b, chi2, jumped)``: a scan's m/z error as a + b / sqrt(m/z) ppm, fitted to its ions' deviations from their own medians with weights 1 / sd² of each trace; and whether
    it stands out: chi² beyond 2 ln(n / 0.01)."""
    p = dense.filter("inten > 0")
    m = p.groupBy("run", "group_id").agg(F.median("mz").alias("_m"))
    d = p.join(m, ["run", "group_id"]).withColumn("d", (F.col("mz") / F.col("_m") - 1) * 1e6)
    s = d.groupBy("run", "group_id").agg(F.greatest(1.4826 * F.median(F.abs("d")), F.lit(0.1)).alias("_s"))
    d = d.join(s, ["run", "group_id"]).withColumn("w", 1 / (F.col("_s") * F.col("_s"))).withColumn("x", 1 / F.sqrt("_m"))
    sums = [F.sum(e).alias(n) for n, e in (("w", F.col("w")), ("wx", F.col("w") * F.col("x")), ("wxx", F.col("w") * F.col("x") * F.col("x")), ("wd", F.col("w") * F.col("d")), ("wxd", F.col("w") * F.col("x") * F.col("d")))]
    g = d.groupBy("run", "scan").agg(F.count("*").alias("n"), *sums).filter(F.col("n") >= least)
    c = F.col
    g = g.withColumn("b", F.coalesce(F.try_divide(c("w") * c("wxd") - c("wx") * c("wd"), c("w") * c("wxx") - c("wx") * c("wx")), F.lit(0.0))).withColumn("a", (c("wd") - c("b") * c("wx")) / c("w"))
    chi = c("a") * c("wd") + c("b") * c("wxd")
    total = F.count("*").over(Window.partitionBy("run"))
    return g.withColumn("chi2", chi).withColumn("jumped", (F.col("chi2") > 2 * F.log(total / 0.01)).cast("int")).select("run", "scan", "n", "a", "b", "chi2", "jumped")


def corrected_mz(points: DataFrame, shifts: DataFrame, least: int = 3) -> DataFrame:
    """``points`` with the m/z of jumped scans moved back, in runs that have ``least`` of them; ``moved`` says which."""
    j = shifts.filter("jumped = 1")
    runs = j.groupBy("run").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select("run")
    j = j.join(runs, "run").select("run", "scan", "a", "b")
    d = points.join(j, ["run", "scan"], "left")
    return d.withColumn("moved", F.col("a").isNotNull().cast("int")).withColumn("mz", F.when(F.col("a").isNotNull(), F.col("mz") / (1 + (F.col("a") + F.col("b") / F.sqrt("mz")) * 1e-6)).otherwise(F.col("mz"))).drop("a", "b")


def saturation_factors(dense: DataFrame, least: int = 10) -> DataFrame:
    """``(run, quarter, n, factor)``: how much the m/z scatters in each quarter decade below a run's top, against the run's middle decades: the ratio of median absolute deviations, at least 1."""
    p = dense.filter("inten > 0")
    m = p.groupBy("run", "group_id").agg(F.median("mz").alias("_m"))
    top = p.groupBy("run").agg(F.log10(F.max("inten")).alias("_t"))
    d = p.join(m, ["run", "group_id"]).join(top, "run").select("run", F.floor((F.col("_t") - F.log10("inten")) * 4).cast("int").alias("quarter"), F.abs((F.col("mz") / F.col("_m") - 1) * 1e6).alias("d"))
    usual = d.filter("quarter >= 4").groupBy("run").agg(F.median("d").alias("_u"))
    g = d.filter("quarter < 4").groupBy("run", "quarter").agg(F.count("*").alias("n"), F.median("d").alias("_d")).filter(F.col("n") >= least)
    return g.join(usual, "run").select("run", "quarter", "n", F.greatest(F.coalesce(F.try_divide("_d", "_u"), F.lit(1.0)), F.lit(1.0)).alias("factor"))


def peak_seeds(dense: DataFrame, share: float = 0.3, near: int = 3, least: int = 4, reach: int = 16) -> DataFrame:
    """``(run, group_id, scan, height, prominence)``: local maxima of the three-point mean that stand ``share`` of their height out within ``reach`` scans and have ``least`` scans with signal
    within ``near``."""
    w = Window.partitionBy("run", "group_id").orderBy("scan")
    mean = (F.coalesce(F.lag("inten").over(w), F.lit(0.0)) + F.col("inten") + F.coalesce(F.lead("inten").over(w), F.lit(0.0))) / 3
    d = materialise(dense.withColumn("smooth", mean).withColumn("_n", F.sum((F.col("inten") > 0).cast("int")).over(w.rowsBetween(-near, near))))
    tops = d.withColumn("_u", F.lag("smooth").over(w)).withColumn("_d", F.lead("smooth").over(w)).filter((F.col("smooth") > F.coalesce("_u", F.lit(-1.0))) & (F.col("smooth") >= F.coalesce("_d", F.lit(-1.0))) & (F.col("_n") >= least) & (F.col("smooth") > 0))
    p = prominences(d, tops.select("run", "group_id", F.col("scan").cast("bigint").alias("block"), F.col("scan").alias("scan_lo"), F.col("scan").alias("scan_hi")), reach)
    return p.filter(F.col("prominence") >= share * F.col("top")).select("run", "group_id", F.col("top_scan").alias("scan"), F.col("top").alias("height"), "prominence")


def cut_pieces(points: DataFrame, cands: DataFrame, ppm: float = 30.0) -> DataFrame:
    """``(run, group_id, block, beyond)``: candidates whose maximum sits on one of their own bounds while the scan beyond it holds a higher centroid of the ion: the piece of a trace that goes on.
    A bound at the run's own end does not count, having no scan beyond."""
    edge = F.when(F.col("scan_apex") == F.col("scan_lo"), F.col("scan_lo") - 1).when(F.col("scan_apex") == F.col("scan_hi"), F.col("scan_hi") + 1)
    c = cands.withColumn("scan", edge).filter("scan is not null").select("run", "group_id", "block", "scan", F.col("mz").alias("mz_c"), "height")
    p = valid_points(points).select("run", "scan", "mz", "inten")
    d = band_join(c, p, "mz_c", "mz", ppm, ["run", "scan"])
    return d.groupBy("run", "group_id", "block", "height").agg(F.max("inten").alias("beyond")).filter(F.col("beyond") > F.col("height")).select("run", "group_id", "block", "beyond")


_MERGED = "id bigint, target bigint"


def merge_complementary(groups: DataFrame, seen: DataFrame, ppm: float = 5.0, rt_tol: float = 0.05) -> DataFrame:
    """``(id, target)``: groups of one ion and overlapping time that share no run become one: the group of most runs takes the others, nearest in time first, as long as no run is taken twice; one
    that was taken takes none, so that chains don't run away. ``groups``: a feature table; ``seen(group_id, run)``.

    Candidate pairs are a tolerance join; the greedy choice runs inside each connected set of pairs, on its own.
    """
    f = groups.select("study", "group_id", "mz", "rt", "rt_min", "rt_max", "n_detected")
    gap = F.abs(F.col("rt_a") - F.col("rt_b"))
    near = feature_pairs(f, ppm, (F.col("a") < F.col("b")) & (gap <= F.greatest(F.lit(rt_tol), F.coalesce(F.col("half_a") + F.col("half_b"), F.lit(0.0)))))
    runs = seen.groupBy("group_id").agg(F.collect_set("run").alias("runs"))
    p = near.select("a", "b", gap.alias("gap")).join(runs.select(F.col("group_id").alias("a"), F.col("runs").alias("_ra")), "a").join(runs.select(F.col("group_id").alias("b"), F.col("runs").alias("_rb")), "b")
    p = materialise(p.filter(~F.arrays_overlap("_ra", "_rb")).select("a", "b", "gap"))
    parts = components(p.select("a", "b"))
    node = parts.join(runs, parts["id"] == runs["group_id"]).join(f.select(F.col("group_id").alias("_g"), "n_detected"), parts["id"] == F.col("_g"))
    edges = p.join(parts.select(F.col("id").alias("a"), "component"), "a").groupBy("component").agg(F.collect_list(F.struct("a", "b", "gap")).alias("edges"))
    nodes = node.groupBy("component").agg(F.collect_list(F.struct("id", F.coalesce("n_detected", F.lit(0)).alias("n"), "runs")).alias("nodes"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, to = [], []
            for es, ns in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                have = {n["id"]: set(n["runs"]) for n in ns}
                beside: dict[int, list] = {i: [] for i in have}
                for e in es:
                    beside[e["a"]].append((e["gap"], e["b"]))
                    beside[e["b"]].append((e["gap"], e["a"]))
                size = {n["id"]: n["n"] for n in ns}
                done: set[int] = set()
                for i in sorted(have, key=lambda k: (-size[k], k)):
                    if i in done:
                        continue
                    done.add(i)
                    for _, j in sorted(beside[i]):
                        if j not in done and size[j] <= size[i] and not have[j] & have[i]:
                            have[i] |= have[j]
                            done.add(j)
                            ids.append(j)
                            to.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(to, pa.int64())], names=["id", "target"])

    return keyed(edges.join(nodes, "component"), "component").select("edges", "nodes").mapInArrow(work, _MERGED)
