"""Implausible readings of ion traces, flagged by a Kalman filter per ion and run.

1. Ions: log-m/z histogram per run (map-side combined), rolling sums, local maxima that are occupied nearly throughout.
2. Centroids within 20 ppm of an ion form its trace; strong centroids 100 to 600 ppm off are its possible jumps. One bucketed join.
3. Traces are cut into stretches of ``STRETCH`` scans with ``MARGIN`` scans of warm-up on both sides, so that neither a long run nor a run with
   a third of all rows makes a large task. Arrow tasks filter many stretches at a time: a local linear trend of log intensity is run forwards
   and backwards, standardised innovations above a threshold are withheld from the update, and both forecasts are fused into the local level.
4. The run's usual scatter is the median over its stretches; a reading is a spike if it is off the fused level by ten times that.
Stuck stretches are those whose innovation variance vanishes; jumps stand where the trace has no reading, at the level forecast for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lcspark.session import BROADCAST_ROWS, materialise, small

ION_PPM, JUMP_FROM_PPM, JUMP_TO_PPM = 20.0, 100.0, 600.0
STRETCH, MARGIN = 2048, 64
#: Centroids below this are stray ones.
STRAY = 4001.0
SPIKE, STUCK_RUN, STUCK_SPREAD, LOWEST_MZ, HIGHEST_MZ, HIGHEST_INTEN = 10.0, 8, 1e-3, 50.0, 1700.0, 1e12
#: Shares of the noise variance by which level and slope of a trace may move from scan to scan, and the share of the slope that lasts.
LEVEL_DRIFT, SLOPE_DRIFT, DAMPING = 0.05, 0.01, 0.95
BIN = 5e-6
#: Parts that the scans of an ion are spread over where its table is too large to be broadcast.
SALTS = 32


def impossible(points: DataFrame) -> DataFrame:
    """Centroids with an intensity or m/z that cannot be: NaN, infinite, 0 or below, above 1e12; m/z NaN or outside 50..1700. Nulls are no case."""
    i, m = F.col("inten").cast("double"), F.col("mz")
    bad_i = F.isnan(i) | (i <= 0) | (i > HIGHEST_INTEN)
    bad_m = F.isnan(m) | (m < LOWEST_MZ) | (m > HIGHEST_MZ)
    return points.filter(F.coalesce(bad_i, F.lit(False)) | F.coalesce(bad_m, F.lit(False)))


def possible(points: DataFrame) -> DataFrame:
    i, m = F.col("inten").cast("double"), F.col("mz")
    return points.filter(F.col("run").isNotNull() & F.col("scan").isNotNull() & (i > 0) & (i <= HIGHEST_INTEN) & (m >= LOWEST_MZ) & (m <= HIGHEST_MZ))


def ions(points: DataFrame, least_share: float = 0.25) -> DataFrame:
    """``(run, ion_mz, usual)``: m/z values occupied nearly throughout a run, with their usual intensity.

    A run's ions are the local maxima of its m/z histogram (rolling over 20 ppm to both sides) that hold at least ``least_share`` of the
    highest one's count and 5 centroids: an ion seen in less than a quarter of the scans that the commonest one is seen in has no usual behaviour to
    be judged by, and its centroids are only checked for impossible values. The windows order the occupied bins of a run, whose number the m/z range bounds whatever the run's size.
    """
    d = points.withColumn("_bin", F.floor(F.log("mz") / BIN))
    h = d.groupBy("run", "_bin").agg(F.count("*").alias("_n"), F.sum("mz").alias("_mz"), F.sum(F.log(F.col("inten").cast("double"))).alias("_i"))
    near = Window.partitionBy("run").orderBy("_bin").rangeBetween(-4, 4)
    h = h.select("run", "_bin", F.sum("_n").over(near).alias("_n"), F.sum("_mz").over(near).alias("_mz"), F.sum("_i").over(near).alias("_i"))
    top = Window.partitionBy("run").orderBy("_bin").rangeBetween(-8, 8)
    h = h.filter("_n >= 5").withColumn("_best", F.max(F.struct("_n", -F.col("_bin"))).over(top)).withColumn("_most", F.max("_n").over(Window.partitionBy("run")))
    h = h.filter((F.col("_best.col2") == -F.col("_bin")) & (F.col("_n") >= least_share * F.col("_most")))
    return h.select("run", (F.col("_mz") / F.col("_n")).alias("ion_mz"), F.exp(F.col("_i") / F.col("_n")).alias("usual"))


def traces(points: DataFrame, ion_table: DataFrame) -> DataFrame:
    """``(run, ion_mz, scan, pos, y, jump)``: log intensity of each ion's centroids, and with ``jump`` of strong centroids standing off it."""
    w = 2e-4
    reach = JUMP_TO_PPM * 1e-6 + 1e-5
    lo, hi = F.floor((F.log("ion_mz") - reach) / w), F.floor((F.log("ion_mz") + reach) / w)
    near = ion_table.select(F.col("run").alias("_run"), "ion_mz", F.explode(F.sequence(lo, hi)).alias("_b"))
    d = points.select("run", "scan", "pos", "mz", F.log(F.col("inten").cast("double")).alias("y"), F.floor(F.log("mz") / w).alias("_bin"), F.pmod("scan", F.lit(SALTS)).alias("_salt"))
    off = F.abs(F.col("mz") / F.col("ion_mz") - 1) * 1e6
    on = (F.col("run") == F.col("_run")) & (F.col("_bin") == F.col("_b"))
    if near.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        near = F.broadcast(near)
    else:
        # an ion of a long run is a hot key: its scans are spread, and the ion table, which is small beside the points, is repeated for them
        near = near.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on = on & (F.col("_salt") == F.col("_s"))
    d = d.join(near, on).withColumn("_off", off)
    jump = (F.col("_off") >= JUMP_FROM_PPM) & (F.col("_off") <= JUMP_TO_PPM) & (F.col("y") > float(np.log(STRAY)))
    return d.filter((F.col("_off") <= ION_PPM) | jump).select("run", "ion_mz", "scan", "pos", "y", (F.col("_off") > ION_PPM).alias("jump"))


_OUT = "run string, scan int, pos bigint, kind string, off double, scatter double, weight double"


def _filtered(y: np.ndarray, n: np.ndarray, r: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Forecast of each reading from those before it, and the forecast's variance, under a local linear trend.

    ``y``: padded to a matrix, a series of ``n`` readings with noise variance ``r`` in each row. Readings beyond ``threshold`` standardised
    innovations are withheld from the update, but the third in a row is a new level.
    """
    s, t = y.shape
    head = y[:, : min(5, t)]
    with np.errstate(all="ignore"):
        level = np.nan_to_num(np.nanmedian(np.where(np.arange(head.shape[1]) < n[:, None], head, np.nan), axis=1))
    slope, p11, p12, p22 = np.zeros(s), 2.0 * r, np.zeros(s), 0.1 * r
    ahead, var, held = np.empty_like(y), np.empty_like(y), np.zeros(s, int)
    for k in range(t):
        slope = DAMPING * slope
        level = level + slope
        p12, p22 = DAMPING * p12, DAMPING**2 * p22
        p11, p12, p22 = p11 + 2 * p12 + p22 + LEVEL_DRIFT * r, p12 + p22, p22 + SLOPE_DRIFT * r
        ahead[:, k], var[:, k] = level, p11
        e, total = y[:, k] - level, p11 + r
        out = np.abs(e) > threshold * np.sqrt(total)
        held = np.where(out, held + 1, 0)
        renew = held >= 3
        use = (k < n) & (~out | renew)
        k1, k2 = np.where(use, p11 / total, 0.0), np.where(use & ~renew, p12 / total, 0.0)
        level, slope = level + np.where(use & renew, 0.9, k1) * e, slope + k2 * e
        p11, p12, p22 = (1 - k1) * p11, (1 - k1) * p12, p22 - k2 * p12
        held = np.where(renew, 0, held)
    return ahead, var


def _series(stretch: int, run: list, scan: np.ndarray, pos: np.ndarray, y: np.ndarray, jump: np.ndarray, seg: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict:
    """Candidates and scatter of some stretches. Each is rows ``starts[i]:ends[i]``, by scan."""
    own = [np.arange(a, b)[~jump[a:b]] for a, b in zip(starts, ends)]
    # one centroid of a trace per scan is filtered, the strongest; the others are no trace
    own = [x[np.lexsort((-y[x], scan[x]))] for x in own]
    own = [x[np.append(True, np.diff(scan[x]) > 0)] if len(x) else x for x in own]
    n = np.array([len(x) for x in own])
    width = max(int(n.max()), 1)
    m = np.zeros((len(own), width))
    for i, x in enumerate(own):
        m[i, : len(x)] = y[x]
    inside = np.arange(width) < n[:, None]
    d = np.abs(np.diff(m, axis=1))
    d[~inside[:, 1:]] = np.nan
    with np.errstate(all="ignore"):
        med = np.nanmedian(d, axis=1) if width > 1 else np.full(len(own), np.nan)
    sd = np.where(np.isfinite(med), med, 0.0) / 0.6745 / np.sqrt(2)
    r = np.maximum(sd, 1e-4) ** 2
    fore, fv = _filtered(m, n, r, 5.0)
    turn = np.where(inside, (n[:, None] - 1) - np.arange(width), np.arange(width))
    back, bv = _filtered(np.take_along_axis(m, turn, 1), n, r, 5.0)
    back, bv = np.take_along_axis(back, turn, 1), np.take_along_axis(bv, turn, 1)
    first, last = np.arange(width) == 0, np.arange(width) == n[:, None] - 1
    fv, bv = np.where(first, 1e9, fv), np.where(last, 1e9, bv)
    level = (fore / fv + back / bv) / (1 / fv + 1 / bv)
    off = np.where(inside, m - level, 0.0)
    # off to both sides: the forecasts may lie apart at a change of level, which is no spike
    both = np.where((np.sign(m - fore) == np.sign(m - back)) | first | last, np.minimum(np.where(first, np.inf, np.abs(m - fore)), np.where(last, np.inf, np.abs(m - back))), 0.0)
    both = np.where(inside & np.isfinite(both), both, 0.0)
    rows: dict[str, list] = {k: [] for k in ("run", "scan", "pos", "kind", "off", "scatter", "weight")}

    def put(i: int, at: int, kind: str | None, by: float) -> None:
        for k, v in zip(rows, (run[starts[i]], int(scan[at]), int(pos[at]), kind, by, None, None)):
            rows[k].append(v)

    for i, x in enumerate(own):
        core = scan // stretch == seg[starts[i]]
        inner = int(np.count_nonzero(core[x])) if len(x) else 0
        if len(x) >= 4 and inner:
            for k, v in zip(rows, (run[starts[i]], None, None, None, None, float(sd[i]), float(inner))):
                rows[k].append(v)
        # vanishing innovation variance: readings equal to one part in a thousand
        k = 0
        while k < len(x):
            e, lo, hi = k + 1, m[i, k], m[i, k]
            while e < len(x) and max(hi, m[i, e]) - min(lo, m[i, e]) <= STUCK_SPREAD:
                lo, hi, e = min(lo, m[i, e]), max(hi, m[i, e]), e + 1
            if e - k >= STUCK_RUN:
                for j in range(k, e):
                    if core[x[j]]:
                        put(i, x[j], "stuck", 0.0)
                k = e
            else:
                k += 1
        for j in np.flatnonzero(both[i, : len(x)] > 4 * max(sd[i], 1e-3)):
            if core[x[j]]:
                put(i, x[j], "spike", float(both[i, j]))
        if len(x):
            for at in np.arange(starts[i], ends[i])[jump[starts[i] : ends[i]]]:
                j = int(np.searchsorted(scan[x], scan[at]))
                if core[at] and not (j < len(x) and scan[x[j]] == scan[at]):
                    near = [fore[i, j] if j < len(x) else level[i, j - 1], back[i, j - 1] if j else level[i, j]]
                    put(i, at, "mz_jump", float(np.min(np.abs(y[at] - np.array(near)))))
    return rows


def _filter_stretches(stretch: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by stretch and scan; filtered a few hundred stretches at a time."""
    schema = pa.schema([("run", pa.string()), ("scan", pa.int32()), ("pos", pa.int64()), ("kind", pa.string()), ("off", pa.float64()), ("scatter", pa.float64()), ("weight", pa.float64())])
    rest: pa.Table | None = None

    def cuts(t: pa.Table) -> np.ndarray:
        """Where a stretch begins: another ion, part or run; a hash that two share does not join them."""
        key, ion, seg, run = t["trace"].to_numpy(), t["ion_mz"].to_numpy(), t["seg"].to_numpy(), t["run"].combine_chunks().dictionary_encode()
        run = (run.combine_chunks() if isinstance(run, pa.ChunkedArray) else run).indices.to_numpy()
        return np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (ion[1:] != ion[:-1]) | (seg[1:] != seg[:-1]) | (run[1:] != run[:-1])))

    def work(t: pa.Table) -> pa.RecordBatch:
        cut = cuts(t)
        ends = np.append(cut[1:], t.num_rows)
        a = {c: t[c].to_numpy() for c in ("scan", "pos", "y", "jump", "seg")}
        # by length, so that the padded matrix of a chunk stays full
        order = np.argsort(ends - cut, kind="stable")
        run = t["run"].to_pylist()
        out: dict[str, list] = {n: [] for n in schema.names}
        for k in range(0, len(order), 128):
            o = order[k : k + 128]
            for c, v in _series(stretch, run, **a, starts=cut[o], ends=ends[o]).items():
                out[c] += v
        return pa.RecordBatch.from_pydict(out, schema=schema)

    for b in batches:
        t = pa.Table.from_batches([b])
        rest = t if rest is None else pa.concat_tables([rest, t])
        if rest.num_rows >= 200_000:
            last = int(cuts(rest)[-1])
            if last:
                yield work(rest.slice(0, last))
                rest = rest.slice(last)
    if rest is not None and rest.num_rows:
        yield work(rest)


def flag_readings(points: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """``(run, scan, pos, kind)``: ``impossible``, ``stuck``, ``spike`` and ``mz_jump`` centroids of ``points(run, scan, pos, mz, inten)``.

    Rows with a null run, scan, m/z or intensity are not judged; rows given twice are flagged once. A centroid that is both stuck and a spike
    is stuck. Empty tables give an empty result; other columns are not looked at.
    """
    points = points.select("run", "scan", "pos", "mz", "inten")
    good = possible(points)
    ion_table = materialise(ions(good))
    d = traces(good, ion_table)
    # the stretch of a scan, and the neighbouring one whose margin it lies in
    at, rest = F.floor(F.col("scan") / stretch), F.pmod(F.col("scan"), F.lit(stretch))
    segs = F.when(rest < MARGIN, F.array(at, at - 1)).when(rest >= stretch - MARGIN, F.array(at, at + 1)).otherwise(F.array(at))
    d = d.withColumn("seg", F.explode(segs)).withColumn("trace", F.xxhash64("run", "ion_mz", "seg"))
    found = materialise(d.repartition("trace").sortWithinPartitions("trace", "run", "ion_mz", "seg", "scan").mapInArrow(partial(_filter_stretches, stretch), _OUT))
    scatter = found.filter("scatter is not null").groupBy("run").agg(F.percentile_approx("scatter", 0.5, 10_000).alias("usual"))
    cases = found.filter("kind is not null").drop("scatter", "weight").join(small(scatter), "run")
    limit = F.greatest(F.col("usual"), F.lit(1e-3)) * SPIKE
    cases = cases.filter((F.col("kind") == "stuck") | ((F.col("kind") == "spike") & (F.col("off") > limit)) | ((F.col("kind") == "mz_jump") & (F.col("off") <= limit)))
    # stuck before spike before jump
    cases = cases.groupBy("run", "scan", "pos").agg(F.max("kind").alias("_k"), F.min("off").alias("_o"), F.bool_or(F.col("kind") == "stuck").alias("_stuck"))
    cases = cases.select("run", "scan", "pos", F.when(F.col("_stuck"), "stuck").otherwise(F.col("_k")).alias("kind"))
    return cases.unionByName(impossible(points).select("run", "scan", "pos", F.lit("impossible").alias("kind")).distinct())
