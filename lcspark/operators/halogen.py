"""Isotope patterns of ions and the halogens they speak for."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lcspark.band import band_join
from lcspark.constants import C13

# Share of each isotope by whole mass steps above the lightest.
SHARES = {
    "C": (0.9893, 0.0107), "H": (0.999885, 0.000115), "N": (0.99636, 0.00364), "O": (0.99757, 0.00038, 0.00205), "S": (0.9499, 0.0075, 0.0425),
    "Cl": (0.7576, 0.0, 0.2424), "Br": (0.5069, 0.0, 0.4931), "Si": (0.92223, 0.04685, 0.03092), "P": (1.0,), "F": (1.0,), "I": (1.0,),
}
# Atoms per Da of the average organic molecule.
AVERAGE = {"C": 4.9384 / 111.1254, "H": 7.7583 / 111.1254, "N": 1.3577 / 111.1254, "O": 1.4773 / 111.1254}
# Atom sets that a pattern is compared with; gains that make a verdict, and the least M+2; the relative and absolute scatter of a ratio.
HYPOTHESES = {"none": {}, "Si": {"Si": 1}, "S": {"S": 1}, "S2": {"S": 2}, "Cl": {"Cl": 1}, "Cl2": {"Cl": 2}, "Cl3": {"Cl": 3}, "Br": {"Br": 1}, "Br2": {"Br": 2}, "BrCl": {"Br": 1, "Cl": 1}}
STEPS, STRONG, POSSIBLE, LEAST_M2 = 5, 9.0, 4.0, 0.12
RATIO_SD, RATIO_FLOOR = 0.15, 0.01
# An even step lies between that of chlorine or bromine and that of carbon: its middle, and half its width, a mass step each.
EVEN_STEP, EVEN_HALF = 1.0011, 0.0023


@cache
def _atoms(element: str, n: int) -> np.ndarray:
    out = np.array([1.0])
    for _ in range(n):
        out = np.convolve(out, SHARES[element])[:STEPS]
    return np.pad(out, (0, max(0, STEPS - len(out))))


def pattern(composition: dict[str, int]) -> np.ndarray:
    """Probability of each whole mass step above the monoisotopic ion."""
    out = np.zeros(STEPS)
    out[0] = 1.0
    for e, n in composition.items():
        out = np.convolve(out, _atoms(e, int(n)))[:STEPS]
    return out


def _ratio(p: np.ndarray) -> float:
    return float(p[1] / p[0])


def _expected(mass: float, extra: dict[str, int], first: float) -> np.ndarray:
    """Ratios of the steps to the lightest ion for an average molecule with ``extra`` atoms, its carbons as M+1 (``first``) demands them."""
    own = {"S": 31.972, "Cl": 34.969, "Br": 78.918, "Si": 27.977}
    rest = max(mass - sum(own[e] * n for e, n in extra.items()), 12.0)
    atoms = {e: round(a * rest) for e, a in AVERAGE.items()}
    if np.isfinite(first):
        carbon = SHARES["C"][1] / SHARES["C"][0]
        others = _ratio(pattern({**{e: n for e, n in atoms.items() if e != "C"}, **extra}))
        atoms["C"] = int(np.clip(round((first - others) / carbon), 1, max(rest // 12, 1)))
    p = pattern({**atoms, **extra})
    return p[1:] / p[0]


def verdict(mass: float, ratios: list[float | None]) -> tuple[str, str]:
    """(``yes``, ``maybe`` or ``no``; best pattern) of an ion from its M+1, M+2, ... ratios to M; a missing one is not compared.

    Ions above 5,000 Da, where the lightest isotope vanishes, get no verdict; ratios above 100 speak for nothing and count as missing.
    """
    got = np.array([np.nan if r is None else r for r in (list(ratios) + [None] * STEPS)[: STEPS - 1]], float)
    got[~(np.abs(got) <= 100)] = np.nan
    known = np.isfinite(got)
    if not known[1] or not 12 <= mass <= 5000:
        return "no", "none"
    fit = {}
    for name, extra in HYPOTHESES.items():
        want = _expected(mass, extra, got[0])
        fit[name] = float(np.minimum((((got - want) / np.sqrt((RATIO_SD * want) ** 2 + RATIO_FLOOR**2))[known]) ** 2, 400).sum())
    halogen = {k: v for k, v in fit.items() if "Cl" in k or "Br" in k}
    best = min(halogen, key=halogen.get)
    gain = min(v for k, v in fit.items() if k not in halogen) - halogen[best]
    if gain >= POSSIBLE and got[1] >= LEAST_M2:
        return ("yes" if gain >= STRONG else "maybe"), best
    return "no", min(fit, key=fit.get)


def _steps(ions: DataFrame, peaks: DataFrame, keys: list[str], ppm: float) -> DataFrame:
    """``ions(*keys, scan, mz_o, inten_o)`` with ``k`` and ``inten_k``: the highest of ``peaks(run, scan, mz, inten)`` one to four mass steps above in the same scan. Two narrow
    joins: odd steps are carbon's within ``ppm``, even ones a span of a few mDa."""
    out = []
    for even in (0, 1):
        ks = [k for k in range(1, STEPS) if k % 2 == 1 - even]
        a = ions.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).withColumn("_at", F.col("mz_o") + F.col("k") * (EVEN_STEP if even else C13))
        far = F.col("mz_o") * ppm / 1e6 + (F.col("k") * EVEN_HALF if even else 0.0)
        d = band_join(a, peaks.select("run", "scan", "mz", "inten"), "_at", "mz", 0.0, ["run", "scan"], F.abs(F.col("mz") - F.col("_at")) <= far, da=max(ks) * EVEN_HALF * even + 2000 * ppm / 1e6)
        out.append(d.groupBy(*keys, "scan", "k").agg(F.max("inten").alias("inten_k")))
    return out[0].unionByName(out[1])


def patterns(own: DataFrame, peaks: DataFrame, ppm: float = 10.0, half: float = 0.5) -> DataFrame:
    """``(run, group_id, mz, n_scans, r1, r2, r3, r4)`` of each trace of ``own(run, group_id, scan, mz, inten)``: its isotope steps in ``peaks(run, scan, mz, inten)``, summed over the scans in
    which it reaches ``half`` of its height, as ratios to it; null for a step that no scan shows."""
    key = ["run", "group_id"]
    top = own.filter("inten > 0").groupBy(*key).agg(F.max("inten").alias("_h"))
    core = own.join(top, key).filter(F.col("inten") >= half * F.col("_h")).select(*key, "scan", F.col("mz").alias("mz_o"), F.col("inten").alias("inten_o"))
    base = core.groupBy(*key).agg(F.count("*").alias("n_scans"), F.sum("inten_o").alias("_s"), (F.sum(F.col("mz_o") * F.col("inten_o")) / F.sum("inten_o")).alias("mz"))
    got = _steps(core, peaks, key, ppm).groupBy(*key).agg(*[F.sum(F.when(F.col("k") == k, F.col("inten_k"))).alias(f"_s{k}") for k in range(1, STEPS)])
    return base.join(got, key, "left").select(*key, "mz", "n_scans", *[(F.col(f"_s{k}") / F.col("_s")).alias(f"r{k}") for k in range(1, STEPS)])


def judged(ratios: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, mz, verdict, pattern, n_ratios)`` of ``ratios(*keys, mz, r1, r2, r3, r4)``: each row on its own, in an Arrow map."""
    types = ", ".join(f"{k} {t}" for k, t in ratios.select(*keys).dtypes)

    def work(batches):
        for x in batches:
            q = list(zip(*[x[f"r{k}"].to_pylist() for k in range(1, STEPS)]))
            rows = [verdict(m, list(v)) for m, v in zip(x["mz"].to_pylist(), q)]
            n = [sum(v is not None for v in y) for y in q]
            yield pa.RecordBatch.from_arrays([*[x[k] for k in keys], x["mz"], pa.array([v for v, _ in rows], pa.string()), pa.array([p for _, p in rows], pa.string()), pa.array(n, pa.int32())], names=[*keys, "mz", "verdict", "pattern", "n_ratios"])

    return ratios.select(*keys, "mz", *[f"r{k}" for k in range(1, STEPS)]).mapInArrow(work, f"{types}, mz double, verdict string, pattern string, n_ratios int")


def halogens(ions: DataFrame, ppm: float = 10.0) -> DataFrame:
    """``(run, scan, mz, verdict, pattern, n_ratios)`` of ``ions(run, scan, mz, inten)``, the peaks of spectra: each peak that has one two mass steps above it, by its steps in the same
    spectrum."""
    d = ions.select("run", "scan", F.col("mz").alias("mz_o"), F.col("inten").alias("inten_o"))
    got = _steps(d, ions, ["run", "mz_o", "inten_o"], ppm)
    one = got.groupBy("run", "scan", F.col("mz_o").alias("mz"), "inten_o").agg(*[(F.max(F.when(F.col("k") == k, F.col("inten_k"))) / F.first("inten_o")).alias(f"r{k}") for k in range(1, STEPS)])
    return judged(one.filter("r2 is not null"), ["run", "scan"])
