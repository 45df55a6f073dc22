"""The N best items of every group by a merge of stored, sorted runs.

Rows are stored as bucketed runs: each partition is ordered by bucket, group and rank order, and keeps N rows of a group at most, so that a
group of any size sends no more than N rows of each run. The runs of a bucket are then merged by a loser tree; after N outputs of a group
every run that still stands in it seeks to its next group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lcspark.session import materialise

#: Rows of a bucket on the average: the runs of one bucket are what a task merges at a time.
BUCKET_ROWS = 20_000
#: Stand for nulls inside the merge.
NO_LIBRARY, NO_HIT, NO_MATCHES = 2**62, 2**63 - 1, -(2**31)
_RUN = "bucket int, run int, place bigint, group_id bigint, spectrum string, score double, n_matched int, library_index bigint, hit_id bigint"
_OUT = "group_id bigint, spectrum string, rank int, hit_id bigint, score double, n_matched int, library_index bigint"


class LoserTree:
    """Merges sorted runs of comparable keys. ``None`` ends a run; ``top`` is the run with the smallest key."""

    def __init__(self, keys: list):
        self.size = max(1, len(keys))
        self.keys = list(keys) or [None]
        self.lost = [-1] * self.size
        for i in range(self.size):
            self._play(i, True)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return x is not None and (y is None or x < y)

    def _play(self, i: int, first: bool = False) -> None:
        node = (i + self.size) // 2
        while node:
            rival = self.lost[node]
            if rival < 0 and first:
                self.lost[node] = i
                return
            if self._less(rival, i):
                self.lost[node], i = i, rival
            node //= 2
        self.top = i

    def replace(self, key) -> None:
        """The top run's next key, or ``None``."""
        self.keys[self.top] = key
        self._play(self.top)


def _cut_run(n: int):
    """Keeps the first ``n`` rows of each group of a sorted partition and names the run."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = TaskContext.get().partitionId()
        last, had, place = None, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            g, s = b["group_id"].to_numpy(), b["spectrum"].dictionary_encode()
            c, names = s.indices.to_numpy(), s.dictionary.to_pylist()
            new = np.append(True, (g[1:] != g[:-1]) | (c[1:] != c[:-1]))
            first = (int(g[0]), names[c[0]])
            before = had if first == last else 0
            start = np.flatnonzero(new)
            at = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
            at[: start[1] if len(start) > 1 else len(g)] += before
            last, had = (int(g[-1]), names[c[-1]]), int(at[-1]) + 1
            kept = b.filter(pa.array(at < n))
            order = pa.array(np.arange(place, place + kept.num_rows))
            place += kept.num_rows
            yield kept.add_column(1, "run", pa.array(np.full(kept.num_rows, run, np.int32))).add_column(2, "place", order)

    return cut


def _merged(t: pa.Table, n: int) -> Iterator[pa.RecordBatch]:
    """The best ``n`` rows of each group of one bucket's runs, which stand one after the other, each in its stored order."""
    a = {c: t[c].to_numpy(zero_copy_only=False) for c in ("run", "group_id", "score", "n_matched", "library_index", "hit_id")}
    names, sp = np.unique(t["spectrum"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
    run, g = a["run"], a["group_id"]
    starts = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    ends = np.append(starts[1:], len(run)).tolist()
    new = np.flatnonzero(np.append(True, (run[1:] != run[:-1]) | (g[1:] != g[:-1]) | (sp[1:] != sp[:-1])))
    # where a run's next group begins
    ahead = np.repeat(np.append(new[1:], len(run)), np.diff(np.append(new, len(run)))).tolist()
    columns = [g.tolist(), sp.tolist(), (-a["score"]).tolist(), (-a["n_matched"].astype(np.int64)).tolist(), a["library_index"].tolist(), a["hit_id"].tolist()]
    row = lambda p: tuple(c[p] for c in columns)
    place = starts.tolist()
    tree = LoserTree([row(p) for p in place])
    took: list[int] = []
    ranks: list[int] = []
    group, had = None, 0
    while (top := tree.keys[tree.top]) is not None:
        r = tree.top
        if top[:2] != group:
            group, had = top[:2], 0
        p = place[r]
        if had < n:
            had += 1
            took.append(p)
            ranks.append(had)
            p += 1
        else:
            p = ahead[p]
        place[r] = p
        tree.replace(row(p) if p < ends[r] else None)
    kept = t.select(["group_id", "spectrum", "hit_id", "score", "n_matched", "library_index"]).take(pa.array(took, pa.int64())).add_column(2, "rank", pa.array(ranks, pa.int32()))
    yield from kept.combine_chunks().to_batches()


def _merge_runs(n: int):
    """Merges bucket by bucket, so that a task holds the runs of one bucket at a time."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            bucket = b["bucket"].to_numpy()
            cut = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)).tolist()
            for lo, hi in zip(cut, cut[1:]):
                if held and held[0]["bucket"][0].as_py() != bucket[lo]:
                    yield from _merged(pa.Table.from_batches(held), n)
                    held = []
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from _merged(pa.Table.from_batches(held), n)

    return merge


def top_hits(hits: DataFrame, n: int = 3) -> DataFrame:
    """``(group_id, spectrum, rank, hit_id, score, n_matched, library_index)``: the ``n`` best hits of each feature's spectrum copy.

    Rows with a null group and with a null or NaN score are left out; a null spectrum is a copy of its own. A repeated (group_id, spectrum,
    library_index) counts once, by its smallest hit id, a null one last. Order: score, then n_matched falling (null last), then library_index (null
    last), then hit id. The repeats are removed by an aggregate on all three keys, which spreads the rows of a hot group over all partitions; these
    partitions are the runs. ``hits`` is counted first, so that buckets grow in number, not in size.
    """
    d = hits.select("hit_id", "group_id", "spectrum", "score", "n_matched", "library_index").dropna(subset=["group_id", "score"]).filter(~F.isnan("score"))
    values = F.struct(F.coalesce(F.col("hit_id").cast("bigint"), F.lit(NO_HIT)).alias("hit_id"), F.col("score").cast("double").alias("score"), F.coalesce(F.col("n_matched").cast("int"), F.lit(NO_MATCHES)).alias("n_matched"))
    # a sign before a spectrum's name tells it from none
    copy = F.coalesce(F.concat(F.lit("="), "spectrum"), F.lit(""))
    one = d.groupBy("group_id", copy.alias("spectrum"), F.coalesce("library_index", F.lit(NO_LIBRARY)).alias("library_index")).agg(F.min(values).alias("_h"))
    tasks = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(tasks, -(-hits.count() // BUCKET_ROWS))
    rows = one.select(F.pmod(F.xxhash64("group_id", "spectrum"), F.lit(buckets)).cast("int").alias("bucket"), "group_id", "spectrum", "_h.score", "_h.n_matched", "library_index", "_h.hit_id")
    ordered = rows.sortWithinPartitions("bucket", "group_id", "spectrum", F.col("score").desc(), F.col("n_matched").desc(), "library_index", "hit_id")
    runs = materialise(ordered.mapInArrow(_cut_run(n), _RUN))
    best = runs.repartition(tasks, "bucket").sortWithinPartitions("bucket", "run", "place").mapInArrow(_merge_runs(n), _OUT)
    best = best.withColumn("spectrum", F.when(F.col("spectrum") != "", F.substring("spectrum", 2, 2**31 - 1)))
    return best.withColumn("library_index", F.nullif("library_index", F.lit(NO_LIBRARY))).withColumn("n_matched", F.nullif("n_matched", F.lit(NO_MATCHES))).withColumn("hit_id", F.nullif("hit_id", F.lit(NO_HIT)))
