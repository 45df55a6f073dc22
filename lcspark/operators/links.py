"""Centroids linked to their neighbours and climbed to their apexes, as joins: no run, island or basin is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lcspark.band import band_join
from lcspark.operators.traces import valid_points
from lcspark.session import materialise

#: A centroid's number in its run.
SCAN_STEP = 1_000_000


def numbered(points: DataFrame) -> DataFrame:
    """Valid centroids with ``id``, scan and position in one number."""
    return valid_points(points).withColumn("id", F.col("scan").cast("bigint") * SCAN_STEP + F.col("pos"))


def links(points: DataFrame, ppm: float = 20.0, reach: int = 3) -> DataFrame:
    """``(run, id, effective, link)``: the neighbour that each centroid climbs to, null at an apex.

    Neighbours: on either side the strongest centroid within ``ppm`` of the nearest of ``reach`` scans that has one, and the adjacent ones of the
    centroid's own scan if as near. A centroid's effective intensity is its own and its scan neighbours'. It climbs to the neighbour of the highest
    effective intensity above its own (ties: stronger, then earlier).
    """
    p = numbered(points).select("run", "scan", "id", "mz", "inten")
    w = Window.partitionBy("run", "scan").orderBy("mz", "id")
    near = lambda c: F.when(F.abs(c("mz").over(w) - F.col("mz")) <= F.col("mz") * (ppm / 1e6), c("id").over(w))
    value = lambda c: F.when(F.abs(c("mz").over(w) - F.col("mz")) <= F.col("mz") * (ppm / 1e6), c("inten").over(w))
    p = p.select("*", near(F.lag).alias("left"), near(F.lead).alias("right"), (F.col("inten") + F.coalesce(value(F.lag), F.lit(0.0)) + F.coalesce(value(F.lead), F.lit(0.0))).alias("effective"))
    p = materialise(p)
    q = p.select("run", "id", "mz", F.col("scan").alias("_own"), F.explode(F.array(*[F.lit(k) for k in range(-reach, reach + 1) if k])).alias("d")).withColumn("scan", F.col("_own") + F.col("d"))
    other = p.select("run", "scan", F.col("id").alias("id_b"), F.col("mz").alias("mz_b"), F.col("inten").alias("inten_b"))
    hit = band_join(q, other, "mz", "mz_b", ppm, ["run", "scan"])
    side = hit.groupBy("run", "id", (F.col("d") > 0).alias("after")).agg(F.min(F.struct(F.abs("d").alias("k"), (-F.col("inten_b")).alias("i"), F.col("id_b").alias("b"))).alias("m")).select("run", "id", F.col("m.b").alias("to"))
    scan_side = p.select("run", "id", F.explode(F.array_compact(F.array("left", "right"))).alias("to"))
    e = side.unionByName(scan_side).join(p.select("run", F.col("id").alias("to"), F.col("effective").alias("e"), F.col("inten").alias("i")), ["run", "to"])
    best = e.groupBy("run", "id").agg(F.max(F.struct("e", "i", (-F.col("to")).alias("t"))).alias("m"))
    d = p.select("run", "id", "effective").join(best, ["run", "id"], "left")
    up = (F.col("m.e") > F.col("effective"))
    return d.select("run", "id", "effective", F.when(up, -F.col("m.t")).alias("link"))


def roots(linked: DataFrame) -> DataFrame:
    """``(run, id, root)`` of ``linked(run, id, link)``: where climbing ends. Each round doubles the steps taken; what has arrived is put aside."""
    state = materialise(linked.select("run", "id", F.coalesce("link", "id").alias("at"), F.col("link").isNull().alias("done")))
    done = state.filter("done").select("run", "id", F.col("at").alias("root"))
    open_ = state.filter("not done").select("run", "id", "at")
    jump = state.select("run", F.col("id").alias("at"), F.col("at").alias("to"), F.col("done").alias("top"))
    while not open_.isEmpty():
        step = materialise(open_.join(jump, ["run", "at"]).select("run", "id", F.col("to").alias("at"), "top"))
        # one that stands on a top has arrived
        done = done.unionByName(step.filter("top").select("run", "id", F.col("at").alias("root")))
        open_ = step.filter("not top").select("run", "id", "at")
        # everyone's next jump is where the one it stands on jumps to
        jump = materialise(jump.alias("a").join(jump.alias("b"), (F.col("a.run") == F.col("b.run")) & (F.col("a.to") == F.col("b.at"))).select(F.col("a.run").alias("run"), F.col("a.at").alias("at"), F.when(F.col("a.top"), F.col("a.to")).otherwise(F.col("b.to")).alias("to"), (F.col("a.top") | F.col("b.top")).alias("top")))
    return done


def basins(points: DataFrame, rooted: DataFrame, least: int = 4) -> DataFrame:
    """``(run, root, scan_lo, scan_hi, n_scans, n_points, height, area, mz)``: what climbs to each apex, of ``least`` scans or more."""
    p = numbered(points).join(rooted, ["run", "id"])
    g = p.groupBy("run", "root").agg(F.min("scan").alias("scan_lo"), F.max("scan").alias("scan_hi"), F.countDistinct("scan").alias("n_scans"), F.count("*").alias("n_points"), F.max("inten").alias("height"), F.sum("inten").alias("area"), (F.sum(F.col("mz") * F.col("inten")) / F.sum("inten")).alias("mz"))
    return g.filter(F.col("n_scans") >= least)
