"""New runs as they arrive: picked batch by batch, and stuck readings found with state kept between batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState


def ingest(points: DataFrame, features_of: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Each batch of ``points`` (a stream whose files are whole runs) through ``features_of`` into ``out``, a folder a batch: a batch that is repeated after a failure writes over
    its own folder, so that no run is counted twice."""

    def write(batch: DataFrame, number: int) -> None:
        features_of(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_STUCK = "run string, channel string, from_scan int, to_scan int, n int, value double"


def stuck_readings(readings: DataFrame, least: int = 8, spread: float = 1e-3) -> DataFrame:
    """``(run, channel, from_scan, to_scan, n, value)`` of a stream ``readings(run, channel, scan, value)``: stretches of ``least`` or more readings in scan order that stay within ``spread`` of
    their first. A stretch that goes on in a later batch is reported when it ends; the state of a channel is its open stretch, four numbers."""

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("scan")
        first, last, n, value = state.get if state.exists else (0, 0, 0, 0.0)
        out = []
        for scan, v in zip(rows["scan"].tolist(), rows["value"].tolist()):
            if n and abs(v - value) <= spread * abs(value):
                last, n = scan, n + 1
                continue
            if n >= least:
                out.append((*key, first, last, n, value))
            first, last, n, value = scan, scan, 1, v
        state.update((first, last, n, value))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _STUCK.split(", ")])

    ok = readings.filter("run is not null and channel is not null and scan is not null and value is not null and not isnan(value)")
    return ok.select("run", "channel", "scan", F.col("value").cast("double").alias("value")).groupBy("run", "channel").applyInPandasWithState(work, _STUCK, "first int, last int, n int, value double", "append", "NoTimeout")
