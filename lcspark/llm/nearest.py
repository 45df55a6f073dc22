"""Records of two tables paired by the nearest time within a tolerance, by expanding-ring joins.

The first ring joins left rows with the right rows of their own and the two adjacent fine time buckets. Those buckets hold every right row
within one bucket's width, so a match at most that far away is provably the nearest. Rows without such a match go on to buckets of twice the
width, until the width covers the tolerance. Most rows thus meet only a few near candidates, and only the unresolved ones are joined again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lcspark.session import materialise, small

FIRST_WIDTH = 0.02
PPM = 10.0
MARGIN = 0.05


def nearest_feature(spectra: DataFrame, features: DataFrame) -> DataFrame:
    """``(map_id, group_id, distance)`` of ``spectra(map_id, study, precursor_mz, t)`` and ``features(group_id, study, mz, rt_min, rt_max)``.

    Times in minutes. A feature is eligible in the same study within 10 ppm and 0.05 min around its bounds; of these the one whose middle is
    nearest wins, ties going to the smaller ``group_id``. Spectra without an eligible feature get no row; nulls and NaN in a compared column
    never match; a ``map_id`` given twice with the same values gets one row. The widest tolerance is taken from the features, and the number of
    rings is its logarithm. Features are broadcast while they are few, counted first; beyond that the join shuffles both sides on study, m/z
    and time bucket, where AQE splits a hot key.
    """
    f = features.select("group_id", "study", F.col("mz").alias("_mz"), "rt_min", "rt_max").dropna()
    f = f.filter(~F.isnan("_mz") & (F.col("_mz") > 0) & ~F.isnan("rt_min") & ~F.isnan("rt_max")).withColumn("_mid", (F.col("rt_min") + F.col("rt_max")) / 2)
    tolerance = f.agg(F.max(F.abs(F.col("rt_max") - F.col("_mid")) + MARGIN)).first()[0]
    w = 1.1 * PPM * 1e-6
    by_mz = F.floor(F.log("_mz") / w)
    f = small(f.withColumn("_m", F.explode(F.array(by_mz - 1, by_mz, by_mz + 1))))
    open_ = spectra.select("map_id", "study", "precursor_mz", "t").dropna().distinct()
    open_ = open_.filter(~F.isnan("precursor_mz") & (F.col("precursor_mz") > 0) & ~F.isnan("t")).withColumn("_m", F.floor(F.log("precursor_mz") / w))
    done: list[DataFrame] = []
    width = FIRST_WIDTH
    while tolerance is not None:
        last = width >= tolerance
        right = f.withColumn("_b", F.floor(F.col("_mid") / width)).withColumnRenamed("study", "_study").withColumnRenamed("_m", "_fm")
        bucket = F.floor(F.col("t") / width)
        left = open_.withColumn("_t", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
        near = (F.col("study") == F.col("_study")) & (F.col("_m") == F.col("_fm")) & (F.col("_t") == F.col("_b"))
        near &= (F.abs(F.col("precursor_mz") - F.col("_mz")) <= F.col("precursor_mz") * PPM / 1e6) & (F.col("t") >= F.col("rt_min") - MARGIN) & (F.col("t") <= F.col("rt_max") + MARGIN)
        met = left.join(right, near, "left").groupBy("map_id", "study", "precursor_mz", "t", "_m")
        best = F.min(F.when(F.col("group_id").isNotNull(), F.struct(F.abs(F.col("t") - F.col("_mid")).alias("distance"), "group_id")))
        ring = materialise(met.agg(best.alias("best")))
        resolved = ring.filter("best is not null" if last else f"best.distance <= {width!r}D")
        done.append(resolved.select("map_id", "best.group_id", "best.distance"))
        if last:
            break
        open_ = ring.filter(f"best is null or best.distance > {width!r}D").drop("best")
        width *= 2
    if not done:
        return features.select(F.lit(None).cast("bigint").alias("map_id"), "group_id", F.lit(0.0).alias("distance")).filter("false")
    return reduce(DataFrame.unionByName, done)


def unassigned_spectra(ms2_map: DataFrame) -> DataFrame:
    """MS2 rows that have no feature yet, their times in minutes."""
    return ms2_map.filter("group_id is null and precursor_mz is not null").select("map_id", "study", "precursor_mz", (F.col("rt_s") / 60).alias("t"))
