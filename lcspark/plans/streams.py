"""Window-shaped queries on the loading times of scans, in the batch form of the streaming operators, and picking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lcspark.operators.pick import pick
from lcspark.operators.regrid import scan_readings
from lcspark.sources.msp import msp_text
from lcspark.sources.tables import read
from lcspark.streaming.events import load_sessions, scans_per_window


def _scans(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "scans")


def q_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return scans_per_window(_scans(spark, d)).select(F.unix_seconds("start").alias("start"), "run", "n", "n_timed")


def q_sliding(spark: SparkSession, d: str) -> DataFrame:
    return scans_per_window(_scans(spark, d), "10 minutes", "5 minutes").select(F.unix_seconds("start").alias("start"), "run", "n", "n_timed")


def q_session(spark: SparkSession, d: str) -> DataFrame:
    return load_sessions(_scans(spark, d)).select(F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "run", "n")


def q_pick(spark: SparkSession, d: str) -> DataFrame:
    """Features of every run."""
    return pick(read(spark, d, "points"), scan_readings(_scans(spark, d)))


def q_msp(spark: SparkSession, d: str) -> DataFrame:
    """The library as .msp records."""
    return read(spark, d, "library").select("library_index", msp_text().alias("record"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
ORACLES = {
    "q_tumbling": "select cast(floor(epoch(loaded_at) / 300) * 300 as bigint) as start, run, count(*) as n, count(rt) as n_timed from scans where loaded_at is not null group by 1, 2",
    "q_sliding": "select cast(floor(epoch(loaded_at) / 300) * 300 - k * 300 as bigint) as start, run, count(*) as n, count(rt) as n_timed from scans, unnest([0, 1]) t(k) where loaded_at is not null group by 1, 2",
    "q_session": """with s as (select run, epoch_us(loaded_at) as t, case when epoch_us(loaded_at) - lag(epoch_us(loaded_at)) over (partition by run order by loaded_at) <= 60000000 then 0 else 1 end as fresh from scans where loaded_at is not null),
k as (select run, t, sum(fresh) over (partition by run order by t rows unbounded preceding) as k from s) select min(t) as start, max(t) + 60000000 as "end", run, count(*) as n from k group by run, k""",
}
