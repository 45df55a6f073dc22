"""Session settings, shared-folder checkpoints and checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows of a side that is ever broadcast. A side is counted first; beyond the bound the join shuffles.
BROADCAST_ROWS = 200_000


def session(master: str = "local[*]", partitions: int = 8) -> SparkSession:
    """A local session with the settings the library expects (UTC, AQE); on a cluster use the cluster's own."""
    return (
        SparkSession.builder.master(master)
        .appName("lcspark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def materialise(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, so that its plan is cut and lost executors cost no recomputation.

    The folder is ``spark.checkpoint.dir``. Only a local session, where driver and executors are one machine, makes one where that is unset.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint(eager=True)


def small(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``bound`` rows, else unchanged. Counts ``df``: pass a materialised or cheap one."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores before costly work on each row, where its files are fewer than the cores; else unchanged, so that large tables are not
    shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def keyed(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` partitioned by ``keys`` into the session's number of shuffle partitions, for costly work on each group: small bytes don't merge them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns`` computed once: a generator is not merged into the expressions that use them, as a projection would be."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))
