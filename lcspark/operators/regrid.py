"""Irregular readings onto a regular grid by intervals of validity.

A reading holds from its time to the next reading of its source, at most ``hold``. The intervals are intersected with the grid cells, which
gives time-weighted averages and the covered fraction; cells without a reading are marked. No step sorts a whole source in one task: readings
are ordered inside blocks of ``BLOCK`` cells, and only the first and last time of each block are ordered over the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 2048


def scan_readings(scans: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """``(run, scan, minutes, inten)``: each delivered scan once, in minutes, with the summed intensity of its centroids (0 for an empty scan).

    A scan delivered twice counts once, by its latest row with a time; scans without any time are left out. Seconds are converted; the unit of
    a run is the one named in any of its rows, and where no row names one, times beyond 200 are seconds. Null, NaN, infinite and non-positive
    intensities don't count.
    """
    s = scans.filter(F.col("run").isNotNull() & F.col("rt").isNotNull() & ~F.isnan("rt") & (F.abs("rt") < float("inf")))
    units = scans.groupBy("run").agg(F.max(F.when(F.lower(F.trim("rt_unit")).isin("second", "minute"), F.lower(F.trim("rt_unit")))).alias("_unit"), F.max(F.when(~F.isnan("rt"), F.col("rt"))).alias("_most"))
    s = s.groupBy("run", "scan").agg(F.max_by("rt", F.struct(F.coalesce(F.col("loaded_at").cast("double"), F.lit(-1e18)), "rt")).alias("rt"))
    s = s.join(units, "run").select("run", "scan", F.when(F.coalesce(F.col("_unit") == "second", F.col("_most") > 200), F.col("rt") / 60).otherwise(F.col("rt")).alias("minutes"))
    if points is None:
        return s.withColumn("inten", F.lit(0.0))
    ok = F.col("inten").cast("double")
    sums = points.filter((ok > 0) & ~F.isnan(ok) & (ok < float("inf"))).groupBy("run", "scan").agg(F.sum(ok).alias("_sum"))
    return s.join(sums, ["run", "scan"], "left").select("run", "scan", "minutes", F.coalesce("_sum", F.lit(0.0)).alias("inten"))


def with_next(df: DataFrame, source: str, time: str, width: float) -> DataFrame:
    """``df`` with ``_next``: the time of the source's following reading (null at the end). ``width``: of a block in time.

    Rows of one time follow each other at no distance, in any order. ``df`` is read twice.
    """
    d = df.withColumn("_blk", F.floor(F.col(time) / width))
    firsts = d.groupBy(source, "_blk").agg(F.min(time).alias("_first"))
    firsts = firsts.select(source, "_blk", F.lead("_first").over(Window.partitionBy(source).orderBy("_blk")).alias("_after"))
    inside = F.lead(time).over(Window.partitionBy(source, "_blk").orderBy(time))
    return d.withColumn("_next", inside).join(firsts, [source, "_blk"], "left").withColumn("_next", F.coalesce("_next", "_after")).drop("_blk", "_after")


def cell_of(time: Column, cell: float) -> Column:
    """The k with ``cell * k <= time < cell * (k + 1)``, held exactly also where the division rounds across a border."""
    k = F.floor(time / cell)
    return F.when(time < k * F.lit(cell), k - 1).when(time >= (k + 1) * F.lit(cell), k + 1).otherwise(k)


def regrid(readings: DataFrame, source: str, time: str, value: str, cell: float, hold: float | None = None) -> DataFrame:
    """``(source, cell, value, coverage, n_readings, status)``: one row for each cell from a source's first to its last reading.

    ``value`` is the average of the step function weighted by time (null where nothing covers the cell), ``coverage`` the covered fraction
    of the cell, ``status`` is ``measured``, ``held`` (covered by an earlier reading only) or ``missing``: no reading and no cover.
    Null and NaN times are left out; null values count as no reading's value but their times do. ``hold`` is one cell unless given.
    """
    hold = cell if hold is None else hold
    r = readings.select(F.col(source).alias("_s"), F.col(time).alias("_t"), F.col(value).cast("double").alias("_y")).filter(F.col("_s").isNotNull() & F.col("_t").isNotNull() & ~F.isnan("_t"))
    spans = with_next(r, "_s", "_t", cell * BLOCK).withColumn("_end", F.least(F.coalesce("_next", F.col("_t")), F.col("_t") + hold))
    own = cell_of(F.col("_t"), cell)
    parts = spans.select("_s", "_t", "_y", "_end", own.alias("_own"), F.explode(F.sequence(own, cell_of(F.col("_end"), cell))).alias("cell"))
    weight = F.greatest(F.least("_end", (F.col("cell") + 1) * cell) - F.greatest("_t", F.col("cell") * cell), F.lit(0.0))
    held = F.when(F.col("_y").isNotNull(), weight).otherwise(0.0)
    cells = parts.groupBy("_s", "cell").agg(
        F.try_divide(F.sum(F.col("_y") * held), F.sum(held)).alias("value"), F.least(F.sum(held) / cell, F.lit(1.0)).alias("coverage"), F.count_if(F.col("cell") == F.col("_own")).alias("n_readings"), F.avg(F.when(F.col("cell") == F.col("_own"), F.col("_y"))).alias("_plain")
    )
    cells = cells.withColumn("value", F.coalesce("value", "_plain")).drop("_plain")
    # what follows the last reading is not part of the series
    known = cells.filter("n_readings > 0").select("_s", "cell")
    gaps = gap_cells(known, "_s", "cell")
    held_cells = cells.filter("n_readings = 0").select("_s", "cell", F.col("value").alias("_v"), F.col("coverage").alias("_c"))
    gaps = gaps.join(held_cells, ["_s", "cell"], "left").select("_s", "cell", F.col("_v").alias("value"), F.coalesce("_c", F.lit(0.0)).alias("coverage"), F.lit(0).cast("bigint").alias("n_readings"), F.when(F.col("_c") > 0, "held").otherwise("missing").alias("status"))
    return cells.filter("n_readings > 0").withColumn("status", F.lit("measured")).unionByName(gaps).withColumnRenamed("_s", source)


def gap_cells(cells: DataFrame, source: str, cell: str) -> DataFrame:
    """``(source, cell)``: every cell between the first and last of ``cells`` of a source that is not among them."""
    d = cells.select(source, F.col(cell).alias("_k")).distinct().withColumn("_blk", F.floor(F.col("_k") / BLOCK))
    lasts = d.groupBy(source, "_blk").agg(F.max("_k").alias("_last"))
    lasts = lasts.select(source, "_blk", F.lag("_last").over(Window.partitionBy(source).orderBy("_blk")).alias("_before"))
    before = F.lag("_k").over(Window.partitionBy(source, "_blk").orderBy("_k"))
    d = d.withColumn("_prev", before).join(lasts, [source, "_blk"], "left").withColumn("_prev", F.coalesce("_prev", "_before")).filter(F.col("_k") - F.col("_prev") > 1)
    # a long gap is made in pieces, not as one array
    d = d.select(source, "_k", F.explode(F.sequence(F.col("_prev") + 1, F.col("_k") - 1, F.lit(BLOCK).cast("bigint"))).alias("_from"))
    return d.select(source, F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + (BLOCK - 1), F.col("_k") - 1))).alias(cell))
