"""Operators on MS2 spectra, library records and hits: assignment, search, ranking, consensus and denoising."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lcspark.band import band_join
from lcspark.constants import C13, ELECTRON, MASS
from lcspark.functions import chem
from lcspark.functions.spectra import LEAST_GAP, METHODS, NOISE_SHARE, PRECURSOR_MARGIN, centroided, cleaned
from lcspark.session import once, spread


def assign(spectra: DataFrame, features: DataFrame, ppm: float = 10.0) -> DataFrame:
    """``(map_id, group_id)``: of the study's features within ``ppm`` whose window holds the spectrum's time the one detected most, then the
    nearest apex, then the smallest id."""
    s = spectra.select("map_id", "study", "precursor_mz", (F.col("rt_s") / 60).alias("t")).filter("precursor_mz > 0 and t is not null")
    f = features.select("study", "group_id", F.col("mz").alias("mz_f"), "rt", "rt_min", "rt_max", "n_detected")
    d = band_join(s, f, "precursor_mz", "mz_f", ppm, ["study"], F.col("t").between(F.col("rt_min"), F.col("rt_max")))
    best = d.groupBy("map_id").agg(F.min(F.struct((-F.col("n_detected")).alias("n"), F.abs(F.col("t") - F.col("rt")).alias("off"), "group_id")).alias("_b"))
    return best.select("map_id", F.col("_b.group_id").alias("group_id"))


def first_of(df: DataFrame, group: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group with their ``rank``; the limit is applied before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= n)


def candidates(queries: DataFrame, records: DataFrame, ppm: float = 10.0) -> DataFrame:
    """``queries(query_id, q_mz, q_mode)`` joined with the records of compatible mode (equal, or one unknown) and precursor m/z."""
    ok = (F.col("q_mode") == F.col("mode")) | (F.col("q_mode") == 0) | (F.col("mode") == 0)
    return band_join(queries, records.select("library_index", F.col("precursor_mz").alias("l_mz"), "mode"), "q_mz", "l_mz", ppm, extra=ok)


_PEAKS = "array<struct<mz:double,share:double>>"


def clean_spectra(records: DataFrame, key: str, tol: float = 0.02) -> DataFrame:
    """``(key, clean)``: every record's cleaned peaks, however many pairs it is in: those below the precursor, none under a hundredth of the
    strongest, shares that sum to 1. Null, NaN and non-positive values are left out; a record without peaks has an empty array.

    Peaks that crowd within ``gap`` are merged strongest first, which takes a map over those few records; all else stays in the JVM.
    """
    gap = max(LEAST_GAP, 2 * tol)
    top = F.when(F.col("precursor_mz") > 0, F.col("precursor_mz") - PRECURSOR_MARGIN)
    finite = lambda c: c.isNotNull() & (F.abs(c) < float("inf"))
    peaks = F.transform("peaks", lambda p: F.struct(p["mz"].cast("double").alias("mz"), p["inten"].cast("double").alias("inten")))
    p = F.array_sort(F.filter(peaks, lambda p: finite(p["mz"]) & finite(p["inten"]) & (p["inten"] > 0) & (top.isNull() | (p["mz"] < top))))
    d = once(records.select(F.col(key).cast("bigint").alias(key), "peaks", "precursor_mz"), p=F.coalesce(p, F.array().cast("array<struct<mz:double,inten:double>>")))
    steps = F.zip_with(F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(0))), F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), lambda a, b: b["mz"] - a["mz"])
    d = once(d, crowded=F.exists(steps, lambda x: x <= gap)).select(key, "p", "crowded")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("mz", pa.float64()), ("inten", pa.float64())]))
        for b in batches:
            out = []
            for x in b.column(1).to_pylist():
                m, i = centroided(np.array([y["mz"] for y in x]), np.array([y["inten"] for y in x]), gap)
                out.append([{"mz": u, "inten": v} for u, v in zip(m.tolist(), i.tolist())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], names=[key, "p"])

    d = d.filter("not crowded").select(key, "p").unionByName(d.filter("crowded").select(key, "p").mapInArrow(merge, f"{key} bigint, p array<struct<mz:double,inten:double>>"))
    d = once(d, top=F.array_max(F.transform("p", lambda x: x["inten"])))
    d = once(d, k=F.filter("p", lambda x: x["inten"] >= NOISE_SHARE * F.col("top")))
    d = once(d, total=F.aggregate("k", F.lit(0.0), lambda a, x: a + x["inten"]))
    return d.select(key, F.transform("k", lambda x: F.struct(x["mz"].alias("mz"), (x["inten"] / F.col("total")).alias("share"))).alias("clean"))


#: Below this entropy a spectrum's shares are raised to ``0.25 + 0.25 * entropy``; and the powers of the weighted cosine.
LOW_ENTROPY, INTEN_POWER, MZ_POWER = 3.0, 0.6, 3


def _weighted(share: Column, entropy: Column) -> Column:
    return F.when(entropy < LOW_ENTROPY, F.pow(share, 0.25 + 0.25 * entropy)).otherwise(share)


def _scored_peaks(clean: DataFrame, key: str, side: str) -> DataFrame:
    """A row for each peak with what the scores need of it: share, entropy-weighted share, weighted intensity, and the spectrum's two sizes."""
    s = once(clean.filter(F.size("clean") > 0), h=F.aggregate("clean", F.lit(0.0), lambda a, p: a - p["share"] * F.log(p["share"])))
    s = once(s, e=F.aggregate("clean", F.lit(0.0), lambda a, p: a + _weighted(p["share"], F.col("h"))))
    strong = lambda p: F.pow(p["share"], INTEN_POWER) * F.pow(p["mz"], MZ_POWER)
    s = once(s, n=F.aggregate("clean", F.lit(0.0), lambda a, p: a + p["share"] * p["share"]), d=F.aggregate("clean", F.lit(0.0), lambda a, p: a + strong(p) * strong(p)))
    s = s.select(key, "h", "e", "n", "d", F.explode("clean").alias("p"))
    return s.select(key, F.col("p.mz").alias(f"m{side}"), F.col("p.share").alias(f"p{side}"), (_weighted(F.col("p.share"), F.col("h")) / F.col("e")).alias(f"w{side}"), strong(F.col("p")).alias(f"d{side}"), F.col("n").alias(f"pp{side}"), F.col("d").alias(f"dd{side}"))


def _shared(x: Column, y: Column) -> Column:
    """What a matched pair of peaks adds to the entropy similarity."""
    return 0.5 * ((x + y) * F.log2(x + y) - x * F.log2(x) - y * F.log2(y))


def score_pairs(pairs: DataFrame, a: DataFrame, b: DataFrame, methods: tuple[str, ...] = METHODS, tol: float = 0.02, ppm: float = 0.0) -> DataFrame:
    """``(query_id, library_index, n_matched, *methods)`` of ``pairs(query_id, library_index)``: scores of the cleaned spectra ``a(query_id, clean)``
    and ``b(library_index, clean)``; 0 where no peak matches.

    Peaks match within ``max(tol, ppm)``. Cleaned peaks lie farther apart than twice that (checked up to m/z 2500), so that a peak has one
    partner at most and the match is a band join on (record, m/z bucket); the scores are sums over it.
    """
    if unknown := set(methods) - set(METHODS):
        raise ValueError(f"unknown method {unknown}; one of {', '.join(METHODS)}")
    width = max(tol, ppm * 1e-6 * 2500)
    if 2 * width > max(LEAST_GAP, 2 * tol):
        raise ValueError("peaks that match must be nearer than half the gap of cleaned ones")
    at = F.floor(F.col("ma") / width)
    q = pairs.select("query_id", "library_index").distinct().join(_scored_peaks(a, "query_id", "a"), "query_id").withColumn("_at", at)
    to = F.floor(F.col("mb") / width)
    r = _scored_peaks(b, "library_index", "b").withColumnRenamed("library_index", "_l").withColumn("_to", F.explode(F.array(to - 1, to, to + 1)))
    near = (F.col("library_index") == F.col("_l")) & (F.col("_at") == F.col("_to")) & (F.abs(F.col("ma") - F.col("mb")) <= F.greatest(F.lit(tol), ppm * 1e-6 * F.col("mb")))
    g = q.join(r, near).groupBy("query_id", "library_index")
    one = lambda c: F.max(c)
    cosine = lambda s, x, y: F.least(F.coalesce(F.try_divide(s, F.sqrt(x * y)), F.lit(0.0)), F.lit(1.0))
    clip = lambda c: F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))
    d = g.agg(
        F.count("*").cast("int").alias("n_matched"),
        clip(F.sum(_shared(F.col("pa"), F.col("pb")))).alias("entropy"),
        clip(F.sum(_shared(F.col("wa"), F.col("wb")))).alias("weighted_entropy"),
        cosine(F.sum(F.col("pa") * F.col("pb")), one("ppa"), one("ppb")).alias("dot"),
        cosine(F.sum(F.col("da") * F.col("db")), one("dda"), one("ddb")).alias("weighted_dot"),
        F.collect_list(F.struct("pa", "wb")).alias("m"),
        F.sum("pa").alias("s"),
        F.sum(F.col("pa") * F.log("pa")).alias("t"),
    )
    if "reverse_entropy" in methods:
        # the query's matched peaks alone, as a spectrum of their own
        d = d.withColumn("h", F.log("s") - F.col("t") / F.col("s"))
        d = once(d, e=F.aggregate("m", F.lit(0.0), lambda x, p: x + _weighted(p["pa"] / F.col("s"), F.col("h"))))
        d = d.withColumn("reverse_entropy", clip(F.aggregate("m", F.lit(0.0), lambda x, p: x + _shared(_weighted(p["pa"] / F.col("s"), F.col("h")) / F.col("e"), p["wb"]))))
    out = pairs.select("query_id", "library_index").join(d, ["query_id", "library_index"], "left")
    return out.select("query_id", "library_index", F.coalesce("n_matched", F.lit(0)).alias("n_matched"), *[F.coalesce(m, F.lit(0.0)).alias(m) for m in methods])


def identify(queries: DataFrame, library: DataFrame, ppm: float = 10.0, method: str = "weighted_entropy", least: float = 0.1, tol: float = 0.02) -> DataFrame:
    """``(query_id, library_index, rank, score, n_matched)``: the listed hits of every query spectrum, ranked by score and matched peaks.

    ``queries(query_id, precursor_mz, mode, peaks)``, ``library(library_index, precursor_mz, mode, peaks)``. Listed: score above ``least`` and a
    matched peak. Ties keep the library's order.
    """
    q = queries.select("query_id", F.col("precursor_mz").alias("q_mz"), F.col("mode").alias("q_mode"))
    pairs = candidates(q, library, ppm).select("query_id", "library_index")
    a, b = clean_spectra(queries, "query_id", tol), clean_spectra(library, "library_index", tol)
    s = score_pairs(pairs, a, b, (method,), tol).filter((F.col(method) > least) & (F.col("n_matched") > 0))
    order = [F.col(method).desc(), F.col("n_matched").desc(), F.col("library_index")]
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).select("query_id", "library_index", "rank", F.col(method).alias("score"), "n_matched")


def _voted(spectra: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray, tol: float, vote: float = 0.5, margin: float = 1.5, least: int = 2) -> tuple[list[float], list[float]]:
    """Peaks of several cleaned spectra kept by a weighted vote. A spectrum whose own noise floor hides a peak abstains."""
    mz, share, of = (np.concatenate(x) for x in (([m for m, _ in spectra]), ([s for _, s in spectra]), ([np.full(len(m), k) for k, (m, _) in enumerate(spectra)])))
    floor = np.array([s.min() if len(s) else 1.0 for _, s in spectra])
    free, out = np.ones(len(mz), bool), []
    for k in np.lexsort((mz, -(weight[of] * share))):
        if not free[k]:
            continue
        near = np.flatnonzero(free & (np.abs(mz - mz[k]) <= tol))
        near = near[np.argsort(np.abs(mz[near] - mz[k]), kind="stable")]
        near = near[np.unique(of[near], return_index=True)[1]]
        free[near] = False
        w = weight[of[near]]
        total = (w * share[near]).sum()
        mean = total / w.sum()
        silent = np.ones(len(weight), bool)
        silent[of[near]] = False
        voters = w.sum() + weight[silent & (mean >= margin * floor)].sum()
        if len(near) >= least and w.sum() >= vote * voters:
            out.append(((w * share[near] * mz[near]).sum() / total, total / voters))
    out.sort()
    size = sum(s for _, s in out) or 1.0
    return [m for m, _ in out], [s / size for _, s in out]


def consensus_spectra(spectra: DataFrame, group: list[str], tol: float = 0.02, most: int = 20) -> DataFrame:
    """One spectrum for each group of ``spectra(*group, id, weight, precursor_mz, peaks)``: ``(*group, n_used, n_peaks, peaks)``.

    The ``most`` spectra of the largest weight are merged, which is the rule of the operator and bounds a group's task whatever its size; the
    limit is applied before the shuffle. Groups of one spectrum, or whose vote keeps nothing, give their top spectrum.
    """
    d = first_of(spectra, group, [F.col("weight").desc_nulls_last(), F.col("id")], most)
    g = d.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("rank", "weight", "precursor_mz", "peaks"))).alias("s"))
    types = ", ".join(f"{c} {t}" for c, t in g.dtypes[: len(group)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("mz", pa.float64()), ("share", pa.float64())]))
        for b in batches:
            used, peaks = [], []
            for s in b.column(len(group)).to_pylist():
                c = [(cleaned([p["mz"] for p in x["peaks"]], [p["inten"] for p in x["peaks"]], x["precursor_mz"], tol), x["weight"] or 1.0) for x in s if x["peaks"]]
                c = [(x, w) for x, w in c if len(x[0])]
                m, i = _voted([x for x, _ in c], np.array([w for _, w in c], float), tol) if len(c) > 1 else ([], [])
                used.append(len(c) if m else min(len(c), 1))
                if not m and c:
                    m, i = c[0][0][0].tolist(), c[0][0][1].tolist()
                peaks.append([{"mz": x, "share": y} for x, y in zip(m, i)])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(group)], pa.array(used, pa.int32()), pa.array([len(p) for p in peaks], pa.int32()), pa.array(peaks, kind)], names=[*group, "n_used", "n_peaks", "peaks"])

    return g.mapInArrow(work, f"{types}, n_used int, n_peaks int, peaks {_PEAKS}")


ORDER = tuple(MASS)


HALOGENS = ("F", "Cl", "Br", "I")


def exchanged(formula_counts: list[int], mz: np.ndarray, precursor: float, tol: float) -> np.ndarray:
    """Which fragments are halide exchange products (halide to hydroxyl): losses of precursor + H2O that carry a halogen."""
    below = precursor - mz > tol
    if not below.any() or not any(formula_counts[ORDER.index(e)] for e in HALOGENS):
        return np.zeros(len(mz), bool)
    wet = [n + {"H": 2, "O": 1}.get(e, 0) for e, n in zip(ORDER, formula_counts)]
    out = np.zeros(len(mz), bool)
    out[below] = explained(wet, mz[below], precursor + 2 * MASS["H"] + MASS["O"], tol, halogen=True)
    return out


def explained(formula_counts: list[int], mz: np.ndarray, precursor: float, tol: float, halogen: bool = False) -> np.ndarray:
    """Which fragments are a loss of a plausible sub-formula of the precursor: the heavy atoms are enumerated, hydrogens solved for. ``halogen``: only
    losses that carry one."""
    heavy = [(e, n) for e, n in zip(ORDER, formula_counts) if e != "H" and n]
    h_most = formula_counts[ORDER.index("H")]
    delta = precursor - mz
    top = float(delta.max(initial=0.0)) + tol
    mass = np.zeros(1)
    atoms = {e: np.zeros(1, np.int32) for e in ORDER}
    for e, n in heavy:
        k = np.arange(n + 1)
        grown = mass[:, None] + k * MASS[e]
        keep = grown <= top
        for o in atoms:
            atoms[o] = np.broadcast_to(atoms[o][:, None], grown.shape)[keep]
        atoms[e] = np.broadcast_to(k, grown.shape)[keep].astype(np.int32)
        mass = grown[keep]
    c, n_, o_, s_, p_ = (atoms[e] for e in ("C", "N", "O", "S", "P"))
    mono = sum(atoms[e] for e in ("F", "Cl", "Br", "I", "Na", "K"))
    most_h = 2 * (c + o_ + s_) + 3 * (n_ + p_) + mono + 4 * atoms["Si"] + np.where(c > 0, 2, 0)
    whole = sum(atoms[e] for e in ORDER if e != "H")
    kinds = sum((atoms[e] > 0).astype(int) for e in ORDER if e != "H")
    ratio = (n_ <= 4 * c) & (o_ <= 3 * c) & (p_ <= 2 * c) & (s_ <= 3 * c) & (atoms["F"] <= 6 * c) & (atoms["Si"] <= c)
    for e in ("Cl", "Br", "I"):
        ratio &= atoms[e] <= 2 * c
    small = (c == 0) & (whole >= 1) & (whole <= 6) & (kinds <= 2)
    good = np.where(c > 0, ratio, small | (whole == 0))
    if halogen:
        good &= sum(atoms[e] for e in HALOGENS) > 0
    order = np.argsort(mass, kind="stable")
    mass, most_h, good, bare = mass[order], most_h[order], good[order], (whole == 0)[order]
    out = np.zeros(len(mz), bool)
    for k, x in enumerate(delta):
        if abs(x) <= tol:
            out[k] = True
        elif x > 0:
            lo, hi = np.searchsorted(mass, [x - tol - h_most * MASS["H"], x + tol])
            h = np.floor((x - mass[lo:hi]) / MASS["H"] + 0.5)
            fits = (h >= 0) & (h <= h_most) & (np.abs(mass[lo:hi] + h * MASS["H"] - x) <= tol) & good[lo:hi]
            out[k] = bool((fits & np.where(bare[lo:hi], (h >= 1) & (h <= 4), h <= most_h[lo:hi])).any())
    return out


def denoised(records: DataFrame, tol: float = 0.005) -> DataFrame:
    """``(library_index, n_peaks, n_kept, keep)`` of the records that the rule of ``passed`` applies to."""
    return passed(records, tol).filter("applied = 1").drop("applied")


def passed(records: DataFrame, tol: float = 0.005) -> DataFrame:
    """``(library_index, n_peaks, n_kept, keep, applied)`` of every record: the peaks that sub-formula losses of a known formula and adduct explain,
    halide exchange products, and isotope peaks one 13C above a kept one at least as tall.

    A map over the records, each on its own. Records of an unknown formula or adduct, of another charge than 1, or impossible as an ion, keep all
    their peaks with ``applied`` 0.
    """
    n = chem.counts(F.col("formula"))
    delta, k, z = chem.adduct_parts(F.col("precursor_type"))
    gained = F.regexp_extract_all(F.regexp_extract("precursor_type", r"\A\[[0-9]*M(.*)\]", 1), F.lit(r"([+-][0-9]*[A-Za-z][A-Za-z0-9]*)"), F.lit(1))
    pieces = F.create_map(*[x for p, f in chem.ADDUCT_PIECES.items() for x in (F.lit(p), F.lit(f))])

    def term_count(t: Column, e: str) -> Column:
        times = F.coalesce(F.nullif(F.regexp_extract(t, r"\A[+-]([0-9]*)", 1), F.lit("")).cast("int"), F.lit(1))
        piece = F.try_element_at(pieces, F.regexp_extract(t, r"\A[+-][0-9]*(.*)\z", 1))
        return F.when(t.startswith("-"), -1).otherwise(1) * times * F.coalesce(chem.count_of(piece, e), F.lit(0))

    def gained_of(e: str) -> Column:
        return F.aggregate(gained, F.lit(0), lambda a, t: a + term_count(t, e))

    ion = F.array(*[(k * n[e] + gained_of(e)).cast("int") for e in ORDER])
    known = chem.is_formula(F.col("formula")) & delta.isNotNull()
    d = records.select("library_index", F.when(known, ion).alias("ion"), F.when(known, z).alias("z"), "peaks")
    # a record takes milliseconds
    d = spread(d.withColumn("ion", F.when(~F.exists("ion", lambda x: x < 0) & (F.abs("z") == 1), F.col("ion"))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: tuple[list, list, list, list] = ([], [], [], [])
            for ion_, z_, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                p = sorted((x["mz"], x["inten"]) for x in p or () if x and x["mz"] is not None and x["inten"] is not None)
                mz = np.array([m for m, _ in p], float)
                if ion_ is None:
                    keep = np.ones(len(mz), bool)
                else:
                    prec = sum(MASS[e] * c for e, c in zip(ORDER, ion_)) - z_ * ELECTRON
                    keep = explained(ion_, mz, prec, tol) | exchanged(ion_, mz, prec, tol)
                for k_ in range(len(mz)):
                    keep[k_] |= any(keep[j] and p[j][1] >= p[k_][1] and abs(mz[k_] - mz[j] - C13) <= tol for j in range(k_))
                for col, v in zip(rows, (len(mz), int(keep.sum()), keep.tolist(), int(ion_ is not None))):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.list_(pa.bool_())), pa.array(rows[3], pa.int32())], names=["library_index", "n_peaks", "n_kept", "keep", "applied"])

    return d.mapInArrow(work, "library_index bigint, n_peaks int, n_kept int, keep array<boolean>, applied int")
