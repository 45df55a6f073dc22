"""Operators on features and their members: consensus, neighbours, pairs, presence and grouping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lcspark.band import band_join
from lcspark.constants import C13
from lcspark.operators.stats import weighted_quantile
from lcspark.session import keyed


def consensus(members: DataFrame) -> DataFrame:
    """``(group_id, n_detected, mz, rt, mz_ppm_spread, rt_sd)`` of ``members(group_id, mz, rt, height, id)``: height-weighted lower median m/z,
    median time, spread and population deviation. Members without m/z, time or height are left out."""
    d = members.filter((F.col("height") > 0) & (F.col("height") < float("inf")) & F.col("group_id").isNotNull() & F.col("mz").isNotNull() & F.col("rt").isNotNull())
    mz = weighted_quantile(d, ["group_id"], "mz", "height", "id").withColumnRenamed("mz", "_c")
    g = d.groupBy("group_id").agg(F.count("*").alias("n_detected"), F.median("rt").alias("rt"), F.max("mz").alias("_hi"), F.min("mz").alias("_lo"), F.stddev_pop("rt").alias("rt_sd"))
    return g.join(mz, "group_id").select("group_id", "n_detected", F.col("_c").alias("mz"), "rt", ((F.col("_hi") - F.col("_lo")) / F.col("_c") * 1e6).alias("mz_ppm_spread"), "rt_sd")


def feature_pairs(features: DataFrame, ppm: float, extra: Column) -> DataFrame:
    """``(study, a, b, mz_a, mz_b, rt_a, rt_b, half_a, half_b)``, a < b: features of one study within ``ppm`` that satisfy ``extra``."""
    half = (F.col("rt_max") - F.col("rt_min")) / 2
    a = features.select("study", F.col("group_id").alias("a"), F.col("mz").alias("mz_a"), F.col("rt").alias("rt_a"), half.alias("half_a"))
    b = features.select("study", F.col("group_id").alias("b"), F.col("mz").alias("mz_b"), F.col("rt").alias("rt_b"), half.alias("half_b"))
    return band_join(a, b, "mz_a", "mz_b", ppm, ["study"], extra)


def isomer_candidates(features: DataFrame, ppm: float = 10.0) -> DataFrame:
    """Pairs of one m/z whose windows touch although their times differ."""
    gap = F.abs(F.col("rt_a") - F.col("rt_b"))
    return feature_pairs(features, ppm, (F.col("a") < F.col("b")) & (gap > 0) & (gap <= F.col("half_a") + F.col("half_b")))


def proven_pairs(features: DataFrame, seen: DataFrame, ppm: float = 10.0, rt_tol: float = 0.05, least: int = 3, share: float = 0.5, order: float = 0.9) -> DataFrame:
    """``(a, b, n_codetected, n_timed, share, gap)``: isomer candidates that ``seen(group_id, run, rt)``, a row for each detection with its apex
    (null where unknown), proves to be two compounds.

    Both in at least ``least`` runs and in ``share`` of the runs of the rarer; where both apexes are known, in at least ``least`` runs too, the same
    order in ``order`` of them and a median gap of ``rt_tol`` or more. A pair without that many known times is not proven.
    """
    n = seen.groupBy("group_id").agg(F.count("*").alias("n"))
    side = lambda x: seen.select(F.col("group_id").alias(x), "run", F.col("rt").alias(f"rt_{x}"))
    both = isomer_candidates(features, ppm).select("a", "b").join(side("a"), "a").join(side("b"), ["b", "run"]).withColumn("d", F.col("rt_b") - F.col("rt_a"))
    g = both.groupBy("a", "b").agg(F.count("*").alias("n_codetected"), F.count("d").alias("n_timed"), F.count_if(F.col("d") > 0).alias("_later"), F.median(F.abs("d")).alias("gap"))
    g = g.join(n.select(F.col("group_id").alias("a"), F.col("n").alias("_na")), "a").join(n.select(F.col("group_id").alias("b"), F.col("n").alias("_nb")), "b")
    g = g.withColumn("share", F.col("n_codetected") / F.least("_na", "_nb")).filter((F.least("n_codetected", "n_timed") >= least) & (F.col("share") >= share) & (F.col("gap") >= rt_tol))
    return g.filter(F.greatest(F.col("_later"), F.col("n_timed") - F.col("_later")) >= order * F.col("n_timed")).select("a", "b", "n_codetected", "n_timed", "share", "gap")


def shared_positions(pairs: DataFrame, seen: DataFrame) -> DataFrame:
    """``(id, rt)``: the median apex of each member of ``pairs(a, b)`` over the runs it is seen in together with a partner."""
    s = seen.filter("rt is not null").select(F.col("group_id").alias("id"), "run", "rt")
    p = pairs.select(F.col("a").alias("id"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    both = p.join(s, "id").join(seen.select(F.col("group_id").alias("other"), "run"), ["other", "run"]).select("id", "run", "rt").distinct()
    return both.groupBy("id").agg(F.median("rt").alias("rt"))


def isolated(features: DataFrame, ppm: float = 10.0, window: float = 0.5) -> DataFrame:
    """Features with no other of the study within ``ppm`` and ``window`` minutes."""
    f = features.select("group_id", "study", "mz", "rt")
    other = f.select("study", F.col("group_id").alias("g2"), F.col("mz").alias("mz2"), F.col("rt").alias("rt2"))
    return band_join(f, other, "mz", "mz2", ppm, ["study"], (F.col("g2") != F.col("group_id")) & (F.abs(F.col("rt2") - F.col("rt")) <= window), "left_anti")


def mutual_matches(left: DataFrame, right: DataFrame, ppm: float = 10.0, window: float = 0.2) -> DataFrame:
    """``(a, b, drt)``: pairs within ``ppm`` and ``window`` of which either end has no other partner. ``left(a, key, mz_a, rt_a)``, ``right(b, key, mz_b, rt_b)``."""
    d = band_join(left, right, "mz_a", "mz_b", ppm, ["key"], F.abs(F.col("rt_b") - F.col("rt_a")) <= window)
    d = d.withColumn("_na", F.count("*").over(Window.partitionBy("a"))).withColumn("_nb", F.count("*").over(Window.partitionBy("b")))
    return d.filter("_na = 1 and _nb = 1").select("a", "b", (F.col("rt_b") - F.col("rt_a")).alias("drt"))


def possible_isotopes(features: DataFrame, ppm: float = 5.0, window: float = 0.05) -> DataFrame:
    """``(group_id, parent_id, k)``: of the co-eluting features one to three isotope steps below with more detections, the one detected most;
    then the smallest step, then the smallest id."""
    child = features.select("study", "group_id", "rt", "n_detected", F.col("charge").alias("z"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k"), "mz").filter("z > 0")
    child = child.withColumn("below", F.col("mz") - F.col("k") * F.lit(C13) / F.col("z"))
    parent = features.select("study", F.col("group_id").alias("parent_id"), F.col("mz").alias("mz_p"), F.col("rt").alias("rt_p"), F.col("n_detected").alias("n_p"))
    d = band_join(child, parent, "below", "mz_p", ppm, ["study"], (F.col("n_p") > F.col("n_detected")) & (F.abs(F.col("rt_p") - F.col("rt")) <= window))
    best = d.groupBy("group_id").agg(F.min(F.struct((-F.col("n_p")).alias("n"), "k", "parent_id")).alias("_b"))
    return best.select("group_id", F.col("_b.parent_id").alias("parent_id"), F.col("_b.k").alias("k"))


def coeluting(features: DataFrame, window: float = 0.02) -> DataFrame:
    """``(study, a, b, mz_a, mz_b)``, a < b: features within ``window`` minutes that overlap by at least half the narrower width."""
    f = features.filter("rt_min is not null and rt_max is not null")
    side = lambda x: f.select("study", F.col("group_id").alias(x), F.col("mz").alias(f"mz_{x}"), F.col("rt").alias(f"rt_{x}"), F.col("rt_min").alias(f"lo_{x}"), F.col("rt_max").alias(f"hi_{x}"))
    a = side("a").withColumn("_t", F.floor(F.col("rt_a") / window))
    b = side("b").withColumnRenamed("study", "_s")
    t = F.floor(F.col("rt_b") / window)
    b = b.withColumn("_u", F.explode(F.array(t - 1, t, t + 1)))
    overlap = F.least("hi_a", "hi_b") - F.greatest("lo_a", "lo_b")
    ok = (F.col("study") == F.col("_s")) & (F.col("_t") == F.col("_u")) & (F.col("a") < F.col("b")) & (F.abs(F.col("rt_a") - F.col("rt_b")) <= window)
    return a.join(b, ok & (overlap >= 0.5 * F.least(F.col("hi_a") - F.col("lo_a"), F.col("hi_b") - F.col("lo_b")))).select("study", "a", "b", "mz_a", "mz_b")


#: Mass differences of ions of one compound.
RELATIONS = {"M+1": C13, "Na-H": 21.981944, "K-H": 37.955882, "NH3": 17.026549, "H2O": 18.010565, "HCOOH": 46.005479}


def mass_relations(pairs: DataFrame, ppm: float = 10.0) -> DataFrame:
    """``(a, b, relation)``: co-eluting pairs whose m/z difference is a known one within ``ppm`` of the larger m/z, the nearest relation."""
    known = F.array(*[F.struct(F.lit(n).alias("relation"), F.lit(v).alias("delta")) for n, v in RELATIONS.items()])
    gap = F.abs(F.col("mz_a") - F.col("mz_b"))
    d = pairs.withColumn("_r", F.explode(known)).withColumn("_off", F.abs(gap - F.col("_r.delta"))).filter(F.col("_off") <= F.greatest("mz_a", "mz_b") * (ppm / 1e6))
    return d.groupBy("a", "b").agg(F.min(F.struct("_off", "_r.relation")).alias("_b")).select("a", "b", F.col("_b.relation").alias("relation"))


def presence(cells: DataFrame, dropped: Column, least: int = 3) -> DataFrame:
    """``(row_no, n_runs, n_filled, kept)``: filled cells over the runs that are not ``dropped``, and the presence rule on the others."""
    d = cells.filter(~dropped).groupBy("row_no").agg(F.count("*").alias("n_runs"), F.count_if(F.col("filled") == 1).alias("n_filled"))
    return d.withColumn("kept", (F.col("n_runs") - F.col("n_filled") >= F.least(F.lit(least), F.col("n_runs"))).cast("int"))


def islands(members: DataFrame, key: str, mz: str, ppm: float) -> DataFrame:
    """``members`` with ``island``: the stretch of m/z that no gap wider than ``ppm`` cuts. Gaps are found on occupied buckets, not on rows."""
    w = ppm * 1e-6
    d = members.withColumn("_k", F.floor(F.log(mz) / w))
    occupied = d.select(key, "_k").distinct()
    order = Window.partitionBy(key).orderBy("_k")
    occupied = occupied.withColumn("_new", F.when(F.col("_k") - F.lag("_k").over(order) <= 2, 0).otherwise(1)).withColumn("island", F.sum("_new").over(order)).drop("_new")
    return d.join(occupied, [key, "_k"]).drop("_k")


_MEMBERS = "study string, member_id bigint, group_no bigint"


def _claim(mz: np.ndarray, rt: np.ndarray, width: np.ndarray, height: np.ndarray, run: np.ndarray, ids: np.ndarray, ppm: float, rt_tol: float, sig: np.ndarray) -> np.ndarray:
    """Group of each member (the id of its seed). Tallest first, a seed claims of every other run the free member nearest in time."""
    group = np.full(len(mz), -1, np.int64)
    by_mz = np.argsort(mz, kind="stable")
    sorted_mz = mz[by_mz]
    widest = float(sig.max(initial=0.0))
    for s in np.lexsort((ids, -height)):
        if group[s] >= 0:
            continue
        group[s] = ids[s]
        far = max(ppm, 3 * np.hypot(sig[s], widest)) * 1e-6
        lo, hi = np.searchsorted(sorted_mz, [mz[s] * (1 - far), mz[s] * (1 + far)])
        j = by_mz[lo : hi + 1]
        gap = np.abs(rt[j] - rt[s])
        ok = (group[j] < 0) & (run[j] != run[s]) & (np.abs(mz[j] - mz[s]) <= mz[s] * 1e-6 * np.maximum(ppm, 3 * np.hypot(sig[j], sig[s]))) & (gap <= np.maximum(rt_tol, 0.5 * np.minimum(width[j], width[s])))
        j, gap = j[ok], gap[ok]
        order = np.lexsort((ids[j], -height[j], gap))
        _, first = np.unique(run[j][order], return_index=True)
        group[j[order[first]]] = ids[s]
    return group


def group_members(members: DataFrame, ppm: float = 5.0, rt_tol: float = 0.05, most_ppm: float = 30.0) -> DataFrame:
    """``(study, member_id, group_no)`` of ``members(study, member_id, run, mz, rt, width, height)``: cross-run groups, each named by its seed. With a column ``sigma``, a member's m/z scatter in
    ppm, a pair's tolerance is three times the two's together, ``ppm`` to ``most_ppm``.

    The rule looks no farther than its tolerances, so each m/z island is grouped on its own; islands are cut again where a member lies beyond the reach of all
    before it, each by its own width, so that neither a crowded m/z nor one wide peak makes a large task.
    """
    d = members.dropna(subset=["study", "member_id", "run", "mz", "rt", "height"]).withColumn("width", F.coalesce("width", F.lit(0.0)))
    # a pair of which both have the largest scatter still lies within the largest tolerance
    sigma = F.least(F.greatest(F.coalesce(F.col("sigma"), F.lit(0.0)), F.lit(0.0)), F.lit(most_ppm / 3 / 2**0.5)) if "sigma" in members.columns else F.lit(0.0)
    d = islands(d.withColumn("sigma", sigma), "study", "mz", max(ppm, most_ppm) if "sigma" in members.columns else ppm)
    order = Window.partitionBy("study", "island").orderBy("rt", "member_id")
    # a pair spans no more than the smaller reach of the two
    reach = F.greatest(F.col("width") * 0.5, F.lit(rt_tol))
    d = d.withColumn("_to", F.max(F.col("rt") + reach).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    d = d.withColumn("_new", F.when(F.col("rt") <= F.col("_to"), 0).otherwise(1)).withColumn("part", F.sum("_new").over(order))

    def work(t: pa.Table) -> pa.Table:
        a = {c: t[c].to_numpy() for c in ("mz", "rt", "width", "height", "member_id", "sigma")}
        run = np.unique(np.array(t["run"].to_pylist()), return_inverse=True)[1]
        g = _claim(a["mz"], a["rt"], a["width"], a["height"], run, a["member_id"], ppm, rt_tol, a["sigma"])
        return pa.table({"study": t["study"], "member_id": pa.array(a["member_id"], pa.int64()), "group_no": pa.array(g, pa.int64())})

    d = d.select("study", "island", "part", "member_id", "run", "mz", "rt", "width", "sigma", F.col("height").cast("double").alias("height"))
    return keyed(d, "study", "island", "part").groupBy("study", "island", "part").applyInArrow(work, _MEMBERS)
