"""Feature tables as tab-separated text, compound lists, and the parameters beside them; and tables of other pickers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Digits behind the point in the text of a column; others as they are.
DIGITS = {"mz": 6, "rt": 4, "rt_min": 4, "rt_max": 4, "height": 1, "area": 3, "fwhm": 5, "snr": 2, "score": 4, "mz_sd_ppm": 3, "neutral_mass": 5}
# How other pickers name the columns of a feature table.
NAMES = {
    "mz": ("mz", "m/z", "mass", "row m/z", "mzmed", "precursor m/z"), "rt": ("rt", "rt (min)", "retention time", "row retention time", "rtmed", "time"), "rt_min": ("rt_min", "rt start", "rtmin"), "rt_max": ("rt_max", "rt end", "rtmax"),
    "height": ("height", "peak height", "intensity", "max intensity", "into"), "area": ("area", "peak area"),
}


def write_features(features: DataFrame, path: str) -> None:
    """One file a partition, with a header; numbers in the digits of their column, nulls empty, arrays joined by ``;``."""
    out = []
    for name, kind in features.dtypes:
        c = F.col(f"`{name}`")
        if kind.startswith("array"):
            c = F.array_join(c, ";")
        elif name in DIGITS:
            c = F.when(F.isnan(c), None).otherwise(F.format_string(f"%.{DIGITS[name]}f", c.cast("double")))
            c = F.when(F.col(f"`{name}`").isNotNull(), c)
        out.append(c.cast("string").alias(name))
    features.select(*out).write.option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)


def read_features(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).schema(schema).csv(path)


def import_features(spark: SparkSession, path: str, seconds: bool | None = None) -> DataFrame:
    """``(file, mz, rt, rt_min, rt_max, height, area)`` of another picker's tables: columns by their usual names, whatever their case; missing ones null. Times in minutes: ``seconds`` says what
    they are, else a file whose times pass 200 is in seconds."""
    d = spark.read.option("sep", "\t").option("header", True).csv(path)
    found = {c.strip().lower(): c for c in d.columns}
    pick = {k: next((found[n] for n in names if n in found), None) for k, names in NAMES.items()}
    if pick["mz"] is None or pick["rt"] is None:
        raise ValueError(f"no m/z or time among {', '.join(d.columns)}")
    number = lambda k: (F.expr(f"try_cast(`{pick[k]}` as double)") if pick[k] else F.lit(None).cast("double")).alias(k)
    d = d.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("file"), *[number(k) for k in NAMES]).filter("mz > 0 and rt is not null")
    if seconds is None:
        most = d.groupBy("file").agg(F.max("rt").alias("_m"))
        d = d.join(most, "file").withColumn("_s", F.col("_m") > 200).drop("_m")
    else:
        d = d.withColumn("_s", F.lit(seconds))
    minutes = lambda c: F.when(F.col("_s"), F.col(c) / 60).otherwise(F.col(c)).alias(c)
    return d.select("file", "mz", minutes("rt"), minutes("rt_min"), minutes("rt_max"), "height", "area")


def write_parameters(parameters: DataFrame, path: str) -> None:
    """A JSON object a run."""
    parameters.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def read_parameters(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path).select(F.from_json("value", schema).alias("p")).select("p.*")


def compound_list(roles: DataFrame, features: DataFrame) -> DataFrame:
    """``(compound, neutral_mass, n_ions, base_mz, rt, ions)`` of ``roles(id, center, role, neutral_mass)``: a row a compound, its ions as text, in order of m/z."""
    d = roles.join(features.select(F.col("group_id").alias("id"), "mz", "rt"), "id")
    g = d.groupBy(F.col("center").alias("compound")).agg(F.max("neutral_mass").alias("neutral_mass"), F.count("*").alias("n_ions"), F.max(F.when(F.col("id") == F.col("center"), F.col("mz"))).alias("base_mz"), F.median("rt").alias("rt"), F.array_sort(F.collect_list(F.struct("mz", "role"))).alias("i"))
    return g.select("compound", "neutral_mass", "n_ions", "base_mz", "rt", F.array_join(F.transform("i", lambda x: F.concat_ws(" ", F.format_string("%.4f", x["mz"]), x["role"])), ";").alias("ions"))
