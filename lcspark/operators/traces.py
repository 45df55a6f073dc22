"""Operators on scans and centroids: chromatograms, boxes, noise, neighbours and trace filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lcspark.band import band_join
from lcspark.session import materialise

LOWEST, HIGHEST = 50.0, 1700.0


def valid_points(points: DataFrame) -> DataFrame:
    """Centroids with a finite positive intensity and m/z."""
    i = F.col("inten").cast("double")
    ok = (i > 0) & (i < float("inf")) & (F.col("mz") > 0) & (F.col("mz") < float("inf"))
    return points.filter(ok).select("run", "scan", "pos", "mz", i.alias("inten"))


def scan_summary(scans: DataFrame, points: DataFrame) -> DataFrame:
    """``(run, scan, n_points, tic, base_mz, base_inten)`` of every scan; empty scans keep a row with zeros."""
    p = valid_points(points).groupBy("run", "scan").agg(F.count("*").alias("n_points"), F.sum("inten").alias("tic"), F.max(F.struct("inten", (-F.col("mz")).alias("m"))).alias("_b"))
    return scans.select("run", "scan").distinct().join(p, ["run", "scan"], "left").select("run", "scan", F.coalesce("n_points", F.lit(0)).alias("n_points"), F.coalesce("tic", F.lit(0.0)).alias("tic"), (-F.col("_b.m")).alias("base_mz"), F.coalesce("_b.inten", F.lit(0.0)).alias("base_inten"))


def study_of(run: Column) -> Column:
    return F.split_part(run, F.lit("_"), F.lit(1))


def run_key(file: Column) -> Column:
    """The run a file name means: no folder, no ``.mzML``, lower case, ``_`` for ``-`` and blanks trimmed."""
    name = F.regexp_replace(F.lower(F.trim(file)), r"^.*[/\\]", "")
    return F.regexp_replace(F.regexp_replace(F.trim(name), r"\.mzml$", ""), r"[-\s]+", "_")


#: The same in SQL, and the SQL of a query on ``ms2_map`` with every spelling of ``file`` as its run.
RUN_SQL = r"regexp_replace(regexp_replace(trim(regexp_replace(lower(trim(file)), '^.*[/\\]', '')), '\.mzml$', ''), '[-\s]+', '_', 'g')"


def by_run(sql: str) -> str:
    return sql.replace("ms2_map", f"(select * replace ({RUN_SQL} as file) from ms2_map)")


def chromatogram(points: DataFrame, targets: DataFrame, ppm: float = 10.0) -> DataFrame:
    """``(run, group_id, scan, mz, inten)``: the highest centroid of each scan within ``ppm`` of a target of the run's study (lower position on ties).

    Scans without a centroid have no row; they count as 0 and are restored by a join with the scans where they are needed.
    """
    p = valid_points(points).withColumn("study", study_of(F.col("run")))
    hits = band_join(p, targets.select("study", "group_id", F.col("mz").alias("target_mz")), "mz", "target_mz", ppm, ["study"], F.abs(F.col("mz") - F.col("target_mz")) <= F.col("target_mz") * (ppm / 1e6))
    best = hits.groupBy("run", "group_id", "scan").agg(F.max(F.struct("inten", (-F.col("pos")).alias("p"), "mz")).alias("_b"))
    return best.select("run", "group_id", "scan", F.col("_b.mz").alias("mz"), F.col("_b.inten").alias("inten"))


def boxes(trace: DataFrame, times: DataFrame, features: DataFrame) -> DataFrame:
    """``(run, group_id, n_scans, height, area)`` of each feature's box in each run: the highest centroid and the trapezoid over the scans present."""
    t = trace.join(times.select("run", "scan", "minutes"), ["run", "scan"])
    f = features.select(F.col("group_id").alias("_g"), F.col("study").alias("_s"), "rt_min", "rt_max")
    d = t.join(f, (F.col("group_id") == F.col("_g")) & (study_of(F.col("run")) == F.col("_s")) & F.col("minutes").between(F.col("rt_min"), F.col("rt_max")))
    w = Window.partitionBy("run", "group_id").orderBy("minutes", "scan")
    d = d.withColumn("_a", (F.col("minutes") - F.lag("minutes").over(w)) * (F.col("inten") + F.lag("inten").over(w)) / 2)
    return d.groupBy("run", "group_id").agg(F.count("*").alias("n_scans"), F.max("inten").alias("height"), F.coalesce(F.sum("_a"), F.lit(0.0)).alias("area"))


def ranked_value(df: DataFrame, key: list[str], value: str, q: float, steps: int = 64) -> DataFrame:
    """``(*key, value)``: the exact quantile, interpolated between ranks, of positive values, however many a key has.

    Values are counted in logarithmic bins (``steps`` an octave, map-side combined); only the bins that hold the two ranks are looked at again, and
    the values in them counted by themselves, so that no state keeps all values of a key.
    """
    d = df.withColumn("_b", F.floor(F.log2(value) * steps))
    n = d.groupBy(*key, "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*key).orderBy("_b")
    n = n.withColumn("_to", F.sum("_n").over(w)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*key)))
    at = q * (F.col("_all") - 1)
    n = n.withColumn("_lo", F.floor(at)).withColumn("_part", at - F.floor(at)).withColumn("_from", F.col("_to") - F.col("_n"))
    n = n.filter((F.col("_from") <= F.least(F.col("_lo") + 1, F.col("_all") - 1)) & (F.col("_to") > F.col("_lo")))
    inside = d.join(n.select(*key, "_b", "_from", "_lo", "_part", "_all"), [*key, "_b"]).groupBy(*key, "_b", "_from", "_lo", "_part", "_all", value).agg(F.count("*").alias("_n"))
    r = Window.partitionBy(*key, "_b").orderBy(value)
    inside = inside.withColumn("_to", F.col("_from") + F.sum("_n").over(r)).withColumn("_at", F.col("_to") - F.col("_n"))
    one = lambda k: F.max(F.when((F.col("_at") <= k) & (F.col("_to") > k), F.col(value)))
    high = F.least(F.col("_lo") + 1, F.col("_all") - 1)
    g = inside.groupBy(*key).agg(one(F.col("_lo")).alias("a"), one(high).alias("b"), F.max("_part").alias("p"))
    return g.select(*key, (F.col("a") + (F.col("b") - F.col("a")) * F.col("p")).alias(value))


def noise_cells(points: DataFrame, times: DataFrame, bands: int = 16, least: int = 50) -> DataFrame:
    """``(run, band, block, n, noise)``: median intensity per logarithmic m/z band and minute; cells of fewer than ``least`` centroids take the
    run's first percentile."""
    p = valid_points(points).filter(F.col("mz").between(LOWEST, HIGHEST)).join(times.select("run", "scan", "minutes"), ["run", "scan"])
    band = F.least(F.floor(bands * F.log(F.col("mz") / LOWEST) / F.log(F.lit(HIGHEST / LOWEST))), F.lit(bands - 1)).cast("int")
    p = p.select("run", band.alias("band"), F.floor("minutes").cast("int").alias("block"), "inten")
    p = materialise(p)
    floor_ = ranked_value(p, ["run"], "inten", 0.01).withColumnRenamed("inten", "_floor")
    cells = p.groupBy("run", "band", "block").agg(F.count("*").alias("n"), F.median("inten").alias("_m"))
    return cells.join(floor_, "run").select("run", "band", "block", "n", F.when(F.col("n") >= least, F.col("_m")).otherwise(F.col("_floor")).alias("noise"))


def sidebands(points: DataFrame, ppm: float = 100.0, ratio: float = 10.0) -> DataFrame:
    """Centroids beside one at least ``ratio`` times as strong in the same scan."""
    p = valid_points(points)
    strong = p.select("run", "scan", F.col("mz").alias("mz_b"), F.col("inten").alias("inten_b"))
    return band_join(p, strong, "mz", "mz_b", ppm, ["run", "scan"], (F.col("inten_b") >= ratio * F.col("inten")), "left_semi")


def next_neighbours(points: DataFrame, ppm: float = 20.0) -> DataFrame:
    """``(run, scan, pos, ppm)``: for each centroid the strongest within ``ppm`` in the following scan, and how far it lies."""
    p = valid_points(points)
    after = p.select("run", (F.col("scan") - 1).alias("scan"), F.col("pos").alias("pos_b"), F.col("mz").alias("mz_b"), F.col("inten").alias("inten_b"))
    d = band_join(p, after, "mz", "mz_b", ppm, ["run", "scan"])
    best = d.groupBy("run", "scan", "pos", "mz").agg(F.max(F.struct("inten_b", (-F.col("pos_b")).alias("p"), "mz_b")).alias("_b"))
    return best.select("run", "scan", "pos", ((F.col("_b.mz_b") / F.col("mz") - 1) * 1e6).alias("ppm"))


def smooth121(value: Column, window) -> Column:
    """[1, 2, 1] / 4 along a trace, missing neighbours as 0."""
    return (F.coalesce(F.lag(value).over(window), F.lit(0.0)) + 2 * value + F.coalesce(F.lead(value).over(window), F.lit(0.0))) / 4


def savgol_residual(value: Column, window) -> Column:
    """Residual of the five-point quadratic Savitzky-Golay fit, scaled to the noise of a reading; null at the ends."""
    fit = (-3 * F.lag(value, 2).over(window) + 12 * F.lag(value).over(window) + 17 * value + 12 * F.lead(value).over(window) - 3 * F.lead(value, 2).over(window)) / 35
    return (value - fit) / F.sqrt(F.lit(1 - 17 / 35))


def scan_islands(scans: DataFrame) -> DataFrame:
    """``(run, first_scan, last_scan, n)``: stretches of consecutive scan numbers."""
    d = scans.select("run", "scan").distinct()
    w = Window.partitionBy("run").orderBy("scan")
    d = d.withColumn("_k", F.col("scan") - F.row_number().over(w))
    return d.groupBy("run", "_k").agg(F.min("scan").alias("first_scan"), F.max("scan").alias("last_scan"), F.count("*").alias("n")).drop("_k")


def occupied_bins(points: DataFrame, ppm: float = 10.0, least: int = 10) -> DataFrame:
    """``(run, bin, n_scans)``: distinct scans of each logarithmic m/z bin that has at least ``least``."""
    p = valid_points(points).select("run", "scan", F.floor(F.log("mz") / (ppm * 1e-6)).alias("bin"))
    return p.distinct().groupBy("run", "bin").agg(F.count("*").alias("n_scans")).filter(F.col("n_scans") >= least)
