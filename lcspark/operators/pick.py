"""Chromatographic features of centroided runs.

A run is cut into tiles of m/z and scans that overlap by more than a peak is wide, whatever lies in them, so that no task grows with a run; of a tile the peaks
are kept whose apex lies in its core. Within one, every centroid is joined to the strongest near centroid of the scans around it, and peaks grow from the strongest centroid down:
a centroid joins the highest peak it touches, and two peaks that meet at it become one unless the lower stands out by its persistence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lcspark.operators.traces import valid_points
from lcspark.session import keyed, small

#: Tiles: width in log m/z and overlap in ppm, scans and their overlap.
TILE, OVERLAP_PPM, STRETCH, OVERLAP_SCANS = 0.03, 100.0, 2048, 192

_FEATURES = "run string, mz double, rt double, rt_apex double, rt_min double, rt_max double, height double, area double, fwhm double, n_scans int, n_points int, mz_sd_ppm double, snr double"


def neighbours(scan: np.ndarray, mz: np.ndarray, inten: np.ndarray, ppm: float, reach: int) -> np.ndarray:
    """For each centroid (sorted by scan, then m/z) the strongest within ``ppm`` in the nearest following scan that has one, else -1."""
    n = len(scan)
    out = np.full(n, -1)
    key = np.log(mz)
    wide = ppm * 1e-6
    step = 2.0 * (key.max() - key.min() + 1)
    place = scan * step + key
    for d in range(1, reach + 1):
        todo = np.flatnonzero(out < 0)
        lo = np.searchsorted(place, (scan[todo] + d) * step + key[todo] - wide)
        hi = np.searchsorted(place, (scan[todo] + d) * step + key[todo] + wide, "right")
        best = np.where(hi > lo, lo, -1)
        for k in range(1, int((hi - lo).max(initial=0))):
            more = lo + k < hi
            at = np.minimum(lo + k, n - 1)
            best = np.where(more & (inten[at] > inten[best]), at, best)
        out[todo] = best
    return out


def basins(scan: np.ndarray, mz: np.ndarray, inten: np.ndarray, ppm: float, reach: int, share: float, noise: float) -> np.ndarray:
    """Peak of each centroid, named by its apex. Merged: peaks less persistent than ``share`` of their apex or three times the noise."""
    nxt = neighbours(scan, mz, inten, ppm, reach)
    near: list[list[int]] = [[] for _ in scan]
    for i, j in enumerate(nxt.tolist()):
        if j >= 0:
            near[i].append(j)
            near[j].append(i)
    order = np.lexsort((np.arange(len(scan)), -inten)).tolist()
    rank = {p: k for k, p in enumerate(order)}
    root = list(range(len(scan)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    level = inten.tolist()
    for p in order:
        tops = sorted({top(q) for q in near[p] if rank[q] < rank[p]}, key=rank.get)
        if tops:
            root[p] = tops[0]
            for t in tops[1:]:
                if level[t] - level[p] < max(share * level[t], 3 * noise):
                    root[t] = tops[0]
    return np.array([top(i) for i in range(len(scan))])


def _row(run: str, t: np.ndarray, scan: np.ndarray, mz: np.ndarray, inten: np.ndarray, noise: float) -> tuple:
    by = np.lexsort((-inten, scan))
    first = np.append(True, np.diff(scan[by]) > 0)
    x, y = t[by][first], inten[by][first]
    k = int(y.argmax())
    height = float(y[k])
    area = float(((y[1:] + y[:-1]) / 2 * np.diff(x)).sum())
    core, flank = y >= 0.9 * height, inten >= 0.5 * height

    def crossing(side: slice) -> float:
        xs, ys = x[side], y[side]
        below = np.flatnonzero(ys < height / 2)
        if not len(below):
            return float(xs[-1])
        b = below[0]
        return float(xs[b - 1] + (xs[b] - xs[b - 1]) * (ys[b - 1] - height / 2) / (ys[b - 1] - ys[b]))

    fwhm = crossing(slice(k, None)) - crossing(slice(k, None, -1))
    m = float((mz[flank] * inten[flank]).sum() / inten[flank].sum())
    base = float(min(y[0], y[-1]))
    sd = float(np.sqrt((inten[flank] * (mz[flank] / m - 1) ** 2).sum() / inten[flank].sum()) * 1e6)
    return run, m, float((x[core] * y[core]).sum() / y[core].sum()), float(x[k]), float(x[0]), float(x[-1]), height, area, fwhm, len(x), len(mz), sd, (height - base) / noise if noise > 0 else float("inf")


def pick(points: DataFrame, times: DataFrame, ppm: float = 15.0, reach: int = 3, share: float = 0.5, min_scans: int = 4, min_snr: float = 3.0) -> DataFrame:
    """Features of ``points`` with the scan times ``times(run, scan, minutes)``: apex, bounds, height, trapezoid area, FWHM, m/z and its spread.

    A run's noise is the lower quartile of its intensities. Ties between centroids go to the earlier one. Points that are not valid, or of scans without a
    time, are left out; empty tables give no feature. A peak longer than ``OVERLAP_SCANS`` to one side of its apex is cut at a tile's end.
    """
    p = valid_points(points).join(times.select("run", "scan", "minutes"), ["run", "scan"])
    noise = small(p.groupBy("run").agg(F.percentile_approx("inten", 0.25, 1000).alias("noise")))
    x = F.log("mz") / TILE
    edge = OVERLAP_PPM * 1e-6 / TILE
    tiles = lambda lo, hi: F.explode(F.sequence(F.floor(lo), F.floor(hi)))
    p = p.withColumn("tile", tiles(x - edge, x + edge)).withColumn("part", tiles((F.col("scan") - OVERLAP_SCANS) / STRETCH, (F.col("scan") + OVERLAP_SCANS) / STRETCH)).join(noise, "run")

    def work(key: tuple, g: pa.Table) -> pa.Table:
        tile, part = key[1].as_py(), key[2].as_py()
        a = {c: g[c].to_numpy() for c in ("scan", "mz", "inten", "minutes")}
        by = np.lexsort((a["mz"], a["scan"]))
        a = {c: v[by] for c, v in a.items()}
        run, floor_ = g["run"][0].as_py(), float(g["noise"][0].as_py())
        label = basins(a["scan"].astype(np.int64), a["mz"], a["inten"], ppm, reach, share, floor_)
        core = (np.floor(np.log(a["mz"]) / TILE) == tile) & (a["scan"] // STRETCH == part)
        order = np.argsort(label, kind="stable")
        rows = []
        for own in np.split(order, np.flatnonzero(np.diff(label[order])) + 1) if len(order) else ():
            # a peak is named by its apex, which one tile alone has in its core
            if core[label[own[0]]] and len(own) >= min_scans and len(np.unique(a["scan"][own])) >= min_scans:
                r = _row(run, a["minutes"][own], a["scan"][own], a["mz"][own], a["inten"][own], floor_)
                if r[-1] >= min_snr:
                    rows.append(r)
        names = [c.split()[0] for c in _FEATURES.split(", ")]
        kinds = [pa.string(), *[pa.float64()] * 8, pa.int32(), pa.int32(), pa.float64(), pa.float64()]
        return pa.table({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(zip(names, kinds))})

    return keyed(p, "run", "tile", "part").groupBy("run", "tile", "part").applyInArrow(work, _FEATURES)
