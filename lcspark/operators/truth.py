"""Scoring of results against known peaks: matches on a grid of tolerances, nearest truth, decoys, labelled pairs, peak groups, counts and vials."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lcspark.band import band_join
from lcspark.constants import C13

#: The grid of tolerances of a recall, in ppm and minutes.
PPM_GRID, RT_GRID = (5.0, 10.0, 20.0), (0.05, 0.1, 0.2)


def recall_grid(truth: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, ppm, window, n_truth, n_hit, recall)`` of ``truth(*keys, id, mz_t, rt_t)`` and ``found(*keys, mz, rt)``: truths that have a found peak within
    each tolerance of the grid. One join at the widest tolerance; of each truth and cell only the nearest are kept, map-side."""
    d = band_join(found, truth, "mz", "mz_t", 1.01 * max(PPM_GRID), keys, F.abs(F.col("rt") - F.col("rt_t")) <= max(RT_GRID))
    off = F.abs(F.col("mz") - F.col("mz_t")) / F.col("mz_t") * 1e6
    late = F.abs(F.col("rt") - F.col("rt_t"))
    cells = [(p, w) for p in PPM_GRID for w in RT_GRID]
    hit = d.groupBy(*keys, "id").agg(*[F.max(((off <= p) & (late <= w)).cast("int")).alias(f"h{k}") for k, (p, w) in enumerate(cells)])
    n = truth.groupBy(*keys).agg(F.count("*").alias("n_truth"))
    g = n.join(hit.groupBy(*keys).agg(*[F.sum(f"h{k}").alias(f"h{k}") for k in range(len(cells))]), keys, "left")
    g = g.select(*keys, "n_truth", F.explode(F.array(*[F.struct(F.lit(p).alias("ppm"), F.lit(w).alias("window"), F.coalesce(F.col(f"h{k}"), F.lit(0)).alias("n_hit")) for k, (p, w) in enumerate(cells)])).alias("c"))
    return g.select(*keys, "c.ppm", "c.window", "n_truth", "c.n_hit", (F.col("c.n_hit") / F.col("n_truth")).alias("recall"))


def decoys(truth: DataFrame, shift: float = 0.05) -> DataFrame:
    """``truth`` twice, its m/z moved up and down by ``shift``: what a method finds there it finds by chance."""
    return truth.withColumn("mz_t", F.explode(F.array(F.col("mz_t") - shift, F.col("mz_t") + shift))).withColumn("id", F.xxhash64("id", "mz_t"))


def nearest_truth(found: DataFrame, truth: DataFrame, keys: list[str], ppm: float = 10.0, window: float = 0.5) -> DataFrame:
    """``(found_id, id, d_rt)``: of the truths within ``ppm`` and ``window`` the nearest in time, then the smaller id."""
    d = band_join(found, truth, "mz", "mz_t", ppm, keys, F.abs(F.col("rt") - F.col("rt_t")) <= window)
    best = d.groupBy("found_id").agg(F.min(F.struct(F.abs(F.col("rt_t") - F.col("rt")).alias("o"), "id", (F.col("rt_t") - F.col("rt")).alias("d"))).alias("b"))
    return best.select("found_id", F.col("b.id").alias("id"), F.col("b.d").alias("d_rt"))


def labelled_partners(light: DataFrame, heavy: DataFrame, keys: list[str], ppm: float = 5.0, window: float = 0.05, most: int = 60) -> DataFrame:
    """``(a, b, n_carbons)``: co-eluting ions ``n`` 13C steps apart, n from 1 to what the mass can hold, of ``light(*keys, a, mz_a, rt_a)`` and
    ``heavy(*keys, b, mz_b, rt_b)``; of several counts the nearest one."""
    n = F.least(F.floor(F.col("mz_a") / 12), F.lit(most)).cast("int")
    x = light.filter("mz_a >= 12").withColumn("n_carbons", F.explode(F.sequence(F.lit(1), n))).withColumn("above", F.col("mz_a") + F.col("n_carbons") * C13)
    d = band_join(x, heavy, "above", "mz_b", ppm, keys, F.abs(F.col("rt_a") - F.col("rt_b")) <= window)
    best = d.groupBy("a", "b").agg(F.min(F.struct(F.abs(F.col("mz_b") - F.col("above")).alias("o"), "n_carbons")).alias("m"))
    return best.select("a", "b", F.col("m.n_carbons").alias("n_carbons"))


def vial_medians(cells: DataFrame, design: DataFrame, group: str, run: str, vial: str, value: str) -> DataFrame:
    """``(group, vial, n_runs, value)``: the median over a vial's injections of ``cells(group, run, value)``, an absent one counting 0. ``design(run, vial)``.

    The zeros are not made: with ``n`` injections and ``p`` present values the median is a rank among the present ones, moved by the zeros."""
    n = design.groupBy(vial).agg(F.countDistinct(run).alias("_n"))
    d = cells.groupBy(group, run).agg(F.max(value).alias("_v")).join(design.select(run, vial).distinct(), run)
    g = d.groupBy(group, vial).agg(F.array_sort(F.collect_list("_v")).alias("_a")).join(n, vial)
    zeros = F.col("_n") - F.size("_a")
    at = lambda k: F.when(k <= zeros, F.lit(0.0)).otherwise(F.try_element_at("_a", (k - zeros).cast("int")))
    middle = (at(F.floor((F.col("_n") + 1) / 2)) + at(F.floor(F.col("_n") / 2) + 1)) / 2
    return g.select(group, vial, F.col("_n").alias("n_runs"), middle.alias(value))


def level_slopes(df: DataFrame, group: str, level: str, value: str, least: int = 3) -> DataFrame:
    """``(group, n_levels, slope, r2)`` of log value on log level over at least ``least`` positive levels."""
    d = df.filter((F.col(level) > 0) & (F.col(value) > 0)).select(group, F.log10(level).alias("_x"), F.log10(value).alias("_y"))
    return d.groupBy(group).agg(F.countDistinct("_x").alias("n_levels"), F.regr_slope("_y", "_x").alias("slope"), F.regr_r2("_y", "_x").alias("r2")).filter(F.col("n_levels") >= least)


def count_classes(df: DataFrame, truth: Column, found: Column) -> list[Column]:
    """Counts of groups whose number of peaks is right, missed (none found), merged (fewer) or too many."""
    return [F.count_if(found == truth).alias("correct"), F.count_if((found == 0) & (truth > 0)).alias("missed"), F.count_if((found < truth) & (found > 0)).alias("merged"), F.count_if(found > truth).alias("extra")]


def peak_groups(peaks: DataFrame, key: str, gap: float = 0.1) -> DataFrame:
    """``peaks(key, id, rt, height)`` with ``chain`` (peaks of a key no more than ``gap`` apart in time) and ``place``: the chain's rank by summed height."""
    w = Window.partitionBy(key).orderBy("rt", "id")
    d = peaks.withColumn("_new", F.when(F.col("rt") - F.lag("rt").over(w) <= gap, 0).otherwise(1)).withColumn("chain", F.sum("_new").over(w)).drop("_new")
    h = d.groupBy(key, "chain").agg(F.sum("height").alias("_h"))
    h = h.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.col("_h").desc(), "chain"))).drop("_h")
    return d.join(h, [key, "chain"])


def annotated(peaks: DataFrame, key: str, deltas: dict[str, tuple[str, float]], ppm: float = 10.0, wide: float = 0.0) -> DataFrame:
    """``peaks(key, id, mz, height)`` of a key named by their distance to the key's tallest one: ``(id, base, name, kind)``: an isotope, an adduct, a fragment (lighter,
    unexplained) or other. ``deltas``: name to (kind, m/z difference); ``wide``: tolerance in Da beside ``ppm``."""
    base = peaks.groupBy(key).agg(F.max(F.struct("height", (-F.col("id")).alias("k"), "mz")).alias("b")).select(key, (-F.col("b.k")).alias("base"), F.col("b.mz").alias("_mz"))
    known = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind"), F.lit(float(v)).alias("v")) for n, (k, v) in deltas.items()])
    d = peaks.join(base, key).withColumn("_d", F.col("mz") - F.col("_mz"))
    near = F.filter(F.transform(known, lambda x: F.struct(F.abs(F.col("_d") - x["v"]).alias("o"), x["name"].alias("name"), x["kind"].alias("kind"))), lambda x: x["o"] <= F.greatest(F.col("mz") * (ppm / 1e6), F.lit(wide)))
    best = F.array_min(near)
    kind = F.when(F.col("id") == F.col("base"), "base").when(best.isNotNull(), best["kind"]).when(F.col("_d") < 0, "fragment").otherwise("other")
    return d.select("id", "base", F.when(F.col("id") != F.col("base"), best["name"]).alias("name"), kind.alias("kind"))


def both_apexes(pairs: DataFrame, found: DataFrame, keys: list[str], ppm: float = 10.0) -> DataFrame:
    """``pairs(*keys, pair, mz_t, rt_1, rt_2)``: whether each of two neighbouring apexes has a found one nearer than half their distance."""
    d = band_join(found, pairs, "mz", "mz_t", ppm, keys, F.least(F.abs(F.col("rt") - F.col("rt_1")), F.abs(F.col("rt") - F.col("rt_2"))) < F.abs(F.col("rt_2") - F.col("rt_1")) / 2)
    one = F.abs(F.col("rt") - F.col("rt_1")) < F.abs(F.col("rt") - F.col("rt_2"))
    g = d.groupBy("pair").agg(F.max(one.cast("int")).alias("first"), F.max((~one).cast("int")).alias("second"))
    return pairs.select("pair").join(g, "pair", "left").select("pair", F.coalesce("first", F.lit(0)).alias("first"), F.coalesce("second", F.lit(0)).alias("second"))


def run_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """One row for each run of several tables: ``{name: DataFrame(run, ...)}`` of one row a run, joined on all runs that any knows."""
    runs = reduce(DataFrame.union, [t.select("run") for t in tables.values()]).distinct()
    for t in tables.values():
        runs = runs.join(t, "run", "left")
    return runs
