"""Tolerance joins. Spark plans ``abs(a - b) <= tol`` as a nested loop; a bucket of the logarithm makes it an equi-join with the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def band_join(probe: DataFrame, build: DataFrame, probe_mz: str, build_mz: str, ppm: float, on: list[str] | None = None, extra: Column | None = None, how: str = "inner", da: float | None = None) -> DataFrame:
    """Rows of both sides with ``|build - probe| <= probe * ppm / 1e6``, equal ``on`` columns (kept from ``probe``) and the condition ``extra``.

    The build side, which should be the smaller one, is exploded over the three buckets that its partners may have; the probe side keeps one
    bucket per row, so that a large table is neither multiplied nor scanned twice. Rows with null, NaN or non-positive m/z match nothing. With
    ``how`` inner, left, left_semi or left_anti. With ``da`` the tolerance is so many Da, whatever the m/z. Column names other than ``on`` must differ
    between the sides.
    """
    on = on or []
    width = 1.01 * ppm * 1e-6
    bucket = lambda c: F.when(F.col(c) > 0, F.floor(F.log(c) / width if da is None else F.col(c) / da))
    b = build.select(*[F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in build.columns])
    at = bucket(build_mz)
    b = b.withColumn("_bb", F.explode(F.array(at - 1, at, at + 1)))
    p = probe.withColumn("_pb", bucket(probe_mz))
    cond = (F.col("_pb") == F.col("_bb")) & (F.abs(F.col(build_mz) - F.col(probe_mz)) <= (F.col(probe_mz) * (ppm / 1e6) if da is None else F.lit(da)))
    for c in on:
        cond = (p[c] == F.col(f"_on_{c}")) & cond
    if extra is not None:
        cond = cond & extra
    return p.join(b, cond, how).drop("_pb", "_bb", *[f"_on_{c}" for c in on])


def near_time_buckets(df: DataFrame, lo: Column, hi: Column, width: float, name: str) -> DataFrame:
    """``df`` once for each time bucket that its interval touches."""
    return df.withColumn(name, F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width))))
