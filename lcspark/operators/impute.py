"""Filling missing values from similar records, with masks of the filled values.

Numerics: a mixed-effects model ``y = mean + group effect + time effect + noise`` whose effects are shrunk by ``n / (n + noise / variance)``
(best linear unbiased prediction, variances by moments). Categories: a multinomial model per group whose prior is the overall share of the
categories. Both need only per-group sums, so a group of any size is pre-aggregated on the map side and never collected. The sums are written
once and the few numbers of a model read back, so that the plan of a prediction is a join with effects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lcspark.session import materialise, small

VERDICTS = ("yes", "maybe", "no")


def category_posterior(known: DataFrame, group: str, value: str, strength: float = 0.01) -> DataFrame:
    """``(group, value, posterior)``: of each group's known values the most probable under a multinomial with a Dirichlet prior.

    The prior is the share of the categories in ``known`` times ``strength`` pseudo-records. With a strength below one record the group's own
    majority decides and the overall share only breaks ties; remaining ties go to the smallest value. Groups without a known value get no
    row. Nulls in either column are left out. Where categories are as many as the groups (identifiers), the shares stay a distributed table.
    """
    counts = materialise(known.filter(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 1
    shares = small(counts.groupBy(value).agg(F.sum("_n").alias("_s")))
    scored = counts.join(shares, value).select(group, value, "_n", (F.col("_n") + F.lit(strength) * F.col("_s") / F.lit(total)).alias("_w"))
    best = scored.groupBy(group).agg(F.min(F.struct((-F.col("_w")).alias("_w"), F.col(value))).alias("_b"), F.sum("_n").alias("_g"))
    return best.select(group, F.col(f"_b.{value}").alias(value), (-F.col("_b._w") / (F.col("_g") + strength)).alias("posterior"))


def mixed_effects(df: DataFrame, value: str, group: str, time: str) -> DataFrame:
    """``df`` with ``<value>_predicted`` (the shrunken prediction for every row) and ``<value>_filled`` (1 where ``value`` is null or NaN).

    Effects of groups or times without a known value are 0, so the prediction falls back to the overall mean; it is null only if no value is
    known at all. Two aggregates with map-side combine, which ``df`` is read for and once more for the prediction: pass a written or cheap one. Times
    are joined by broadcast while they are few, groups on their key, where AQE splits a hot one.
    """
    y = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    d = df.withColumn("_y", y)
    times = materialise(d.groupBy(time).agg(F.sum("_y").alias("_s"), F.count("_y").alias("_nt"), F.sum(F.col("_y") * F.col("_y")).alias("_q")))
    n, s, q = times.agg(F.sum("_nt"), F.sum("_s"), F.sum("_q")).first()
    if not n:
        return df.withColumn(f"{value}_predicted", F.lit(None).cast("double")).withColumn(f"{value}_filled", F.lit(1))
    mean = s / n
    var = max((q - n * mean * mean) / (n - 1), 0.0) if n > 1 else 0.0
    times = times.select(time, "_nt", (F.try_divide("_s", "_nt") - mean).alias("_d"))
    tau = times.agg(F.var_samp("_d") - F.avg(F.lit(var) / F.greatest(F.col("_nt"), F.lit(1)))).first()[0]
    tau = max(tau or 0.0, 0.0)
    shrink = F.col("_nt") / (F.col("_nt") + F.lit(var / tau)) if tau > 0 else F.lit(0.0)
    times = times.select(F.col(time).alias("_time"), F.coalesce(F.col("_d") * shrink, F.lit(0.0)).alias("_te"))
    groups = materialise(d.groupBy(group).agg((F.avg("_y") - mean).alias("_d"), F.count("_y").alias("_ng"), F.var_samp("_y").alias("_w")))
    noise, spread = groups.agg(F.try_divide(F.sum(F.col("_w") * (F.col("_ng") - 1)), F.sum(F.when(F.col("_w").isNotNull(), F.col("_ng") - 1))), F.var_samp("_d")).first()
    noise, spread = noise or 0.0, spread or 0.0
    between = F.greatest(F.lit(spread) - noise / F.greatest(F.col("_ng"), F.lit(1)), F.lit(1e-9))
    groups = groups.select(F.col(group).alias("_group"), F.coalesce(F.col("_d") * F.col("_ng") / (F.col("_ng") + F.lit(noise) / between), F.lit(0.0)).alias("_ge"))
    out = d.join(groups, F.col(group) == F.col("_group"), "left").join(small(times), F.col(time) == F.col("_time"), "left")
    predicted = F.lit(mean) + F.coalesce("_ge", F.lit(0.0)) + F.coalesce("_te", F.lit(0.0))
    return out.withColumn(f"{value}_predicted", predicted).withColumn(f"{value}_filled", F.col("_y").isNull().cast("int")).drop("_y", "_group", "_ge", "_time", "_te")


def fill_widths(features: DataFrame) -> DataFrame:
    """``aligned_feature_table`` with ``rt_min``, ``rt_max`` and ``rt_sd`` filled, and the masks ``rt_min_filled``, ``rt_max_filled``, ``rt_sd_filled``.

    A peak's two half widths and its spread in time follow its compound (group) and grow with the retention time (time effect: study and minute):
    each is predicted by the mixed-effects model and, being a length, not below 0; a bound is the apex less or plus the half width. Rows without an
    apex time keep a null bound, mask 0; ``rt_sd`` needs none. Columns other than the table's own are left behind.
    """
    d = features.select("group_id", "study", "compound_id", "rt", "rt_min", "rt_max", "rt_sd")
    d = d.withColumn("_left", F.col("rt") - F.col("rt_min")).withColumn("_right", F.col("rt_max") - F.col("rt")).withColumn("_time", F.concat_ws("|", "study", F.floor("rt").cast("string")))
    d = materialise(d.withColumnRenamed("_time", "minute"))
    for c in ("_left", "_right", "rt_sd"):
        d = mixed_effects(d, c, "compound_id", "minute").withColumn(f"{c}_predicted", F.when(F.col(f"{c}_predicted").isNotNull(), F.greatest(f"{c}_predicted", F.lit(0.0))))
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    d = d.withColumn("_lo", F.coalesce(known("rt_min"), F.col("rt") - F.col("_left_predicted"))).withColumn("_hi", F.coalesce(known("rt_max"), F.col("rt") + F.col("_right_predicted"))).withColumn("_sd", F.coalesce(known("rt_sd"), F.col("rt_sd_predicted")))
    mask = lambda old, new: (known(old).isNull() & F.col(new).isNotNull()).cast("int")
    return d.select("group_id", "study", "compound_id", "rt", F.col("_lo").alias("rt_min"), mask("rt_min", "_lo").alias("rt_min_filled"), F.col("_hi").alias("rt_max"), mask("rt_max", "_hi").alias("rt_max_filled"), F.col("_sd").alias("rt_sd"), mask("rt_sd", "_sd").alias("rt_sd_filled"))


def real_count(c: Column) -> Column:
    """A count that is not missing in one of its forms."""
    return F.when(c >= 0, c)


def fill_block_groups(mask: DataFrame) -> DataFrame:
    """``filled_mask`` with ``group_id`` filled from its block (``row_no``), ``group_id_filled`` and the posterior of the filled value.

    A missing group is null or below 1. A block without a known group stays null. Null ``row_no`` is no block. Of several groups in a block the
    most frequent fills, the smallest on ties. Columns other than the table's own five are left behind.
    """
    d = mask.select("mask_id", "row_no", "group_id", "run", "filled").withColumn("_g", F.when(F.col("group_id") >= 1, F.col("group_id")))
    model = category_posterior(d.select("row_no", F.col("_g").alias("_fill")), "row_no", "_fill").withColumnRenamed("row_no", "_row")
    d = d.join(model, F.col("row_no") == F.col("_row"), "left")
    return d.withColumn("group_id_filled", (F.col("_g").isNull() & F.col("_fill").isNotNull()).cast("int")).withColumn("group_id", F.coalesce("_g", "_fill")).drop("_g", "_fill", "_row")


def fill_features(features: DataFrame, filled_blocks: DataFrame) -> DataFrame:
    """``aligned_feature_table`` with ``n_filled`` and ``possible_halogen`` filled, and the masks ``n_filled_filled``, ``possible_halogen_filled``.

    ``n_filled`` is the expected number of filled cells of the feature's block given what is known of it: a known cell counts as it is, an
    unknown one by the mixed-effects prediction (feature and run), rounded at the end; a block without unknown cells thus gives its exact
    count. A verdict is filled by the multinomial of the compound. Values without such evidence stay null and their mask 0.
    """
    cells = filled_blocks.filter(F.col("group_id").isNotNull()).select("group_id", "run", F.col("filled").cast("double").alias("cell"))
    cells = mixed_effects(cells, "cell", "group_id", "run").withColumn("_x", F.when(F.col("cell_filled") == 1, F.least(F.greatest("cell_predicted", F.lit(0.0)), F.lit(1.0))).otherwise((F.col("cell") == 1).cast("double")))
    counts = cells.groupBy(F.col("group_id").alias("_gid")).agg(F.round(F.sum(F.coalesce("_x", F.lit(0.0)))).cast("int").alias("_n"))
    features = features.select("group_id", "study", "compound_id", "n_filled", "possible_halogen")
    d = features.withColumn("_real", real_count(F.col("n_filled"))).withColumn("_verdict", F.when(F.col("possible_halogen").isin(*VERDICTS), F.col("possible_halogen")))
    verdicts = category_posterior(d.select("compound_id", F.col("_verdict").alias("_fill")), "compound_id", "_fill").select(F.col("compound_id").alias("_cid"), "_fill")
    d = d.join(counts, F.col("group_id") == F.col("_gid"), "left").join(verdicts, F.col("compound_id") == F.col("_cid"), "left")
    d = d.withColumn("n_filled_filled", (F.col("_real").isNull() & F.col("_n").isNotNull()).cast("int")).withColumn("n_filled", F.coalesce("_real", "_n"))
    d = d.withColumn("possible_halogen_filled", (F.col("_verdict").isNull() & F.col("_fill").isNotNull()).cast("int")).withColumn("possible_halogen", F.coalesce("_verdict", "_fill"))
    return d.drop("_real", "_verdict", "_n", "_gid", "_fill", "_cid")
