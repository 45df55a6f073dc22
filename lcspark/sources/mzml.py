"""mzML runs as DataFrames: one task decodes one file as a stream of spectra."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import partial
from xml.etree.ElementTree import iterparse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPECTRUM = "run string, scan int, native_id string, ms_level int, rt double, rt_unit string, polarity string, precursor_mz double, isolation_lo double, isolation_hi double, mz array<double>, inten array<float>"
# Accession numbers of the controlled vocabulary.
LEVEL, CENTROID, PROFILE, POSITIVE, NEGATIVE, TIME, SELECTED, TARGET, LOWER, UPPER = (
    "MS:1000511 MS:1000127 MS:1000128 MS:1000130 MS:1000129 MS:1000016 MS:1000744 MS:1000827 MS:1000828 MS:1000829".split()
)
DOUBLE, ZLIB, MZ_ARRAY, INTEN_ARRAY = "MS:1000523 MS:1000574 MS:1000514 MS:1000515".split()
UNITS = {"UO:0000031": "minute", "UO:0000010": "second"}


def _array(node) -> tuple[str | None, np.ndarray]:
    kinds = {p.get("accession") for p in node if p.tag.endswith("cvParam")}
    raw = next((base64.b64decode(p.text or "") for p in node if p.tag.endswith("binary")), b"")
    if ZLIB in kinds and raw:
        raw = zlib.decompress(raw)
    what = "mz" if MZ_ARRAY in kinds else "inten" if INTEN_ARRAY in kinds else None
    return what, np.frombuffer(raw, "<f8" if DOUBLE in kinds else "<f4").astype(float)


def spectra(source) -> Iterator[dict]:
    """The spectra of an mzML stream in file order; elements are freed as they are read."""
    for _, node in iterparse(source, events=("end",)):
        if not node.tag.endswith("}spectrum") and node.tag != "spectrum":
            continue
        s: dict = {"native_id": node.get("id"), "ms_level": None, "rt": None, "rt_unit": None, "polarity": None, "precursor_mz": None, "isolation": (None, None), "profile": False, "mz": np.empty(0), "inten": np.empty(0)}
        selected = target = lower = upper = None
        for p in node.iter():
            acc = p.get("accession")
            if acc == LEVEL:
                s["ms_level"] = int(p.get("value"))
            elif acc == PROFILE:
                s["profile"] = True
            elif acc in (POSITIVE, NEGATIVE):
                s["polarity"] = "pos" if acc == POSITIVE else "neg"
            elif acc == TIME:
                s["rt"], s["rt_unit"] = float(p.get("value")), UNITS.get(p.get("unitAccession"))
            elif acc == SELECTED:
                selected = selected or float(p.get("value"))
            elif acc == TARGET:
                target = target or float(p.get("value"))
            elif acc == LOWER:
                lower = float(p.get("value"))
            elif acc == UPPER:
                upper = float(p.get("value"))
            elif p.tag.endswith("binaryDataArray"):
                what, x = _array(p)
                if what:
                    s[what] = x
        s["precursor_mz"] = selected or target
        if target and lower is not None and upper is not None:
            s["isolation"] = (target - lower, target + upper)
        node.clear()
        yield s


def _decoded(polarity: str | None, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import io

    for b in batches:
        for path, content in zip(b["path"], b["content"]):
            run = re.sub(r"\.mzml$", "", path.rsplit("/", 1)[-1], flags=re.I)
            rows: list[tuple] = []
            n_ms1 = n_profile = 0
            seen: set[str] = set()
            for k, s in enumerate(spectra(io.BytesIO(content)), 1):
                n = re.search(r"(\d+)\s*$", s["native_id"] or "")
                ok = np.isfinite(s["mz"]) & np.isfinite(s["inten"]) & (s["inten"] > 0)
                order = np.argsort(s["mz"][ok], kind="stable")
                n_ms1 += s["ms_level"] == 1
                n_profile += s["ms_level"] == 1 and s["profile"]
                if polarity and s["polarity"] and s["polarity"] != polarity:
                    continue
                seen |= {s["polarity"]} - {None}
                if len(seen) > 1:
                    raise ValueError(f"{path} holds both polarities; ask for one")
                if not s["profile"]:
                    rows.append((run, int(n[1]) if n else k, s["native_id"], s["ms_level"], s["rt"], s["rt_unit"], s["polarity"], s["precursor_mz"], *s["isolation"], s["mz"][ok][order], s["inten"][ok][order].astype(np.float32)))
                if len(rows) >= 500:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in SPECTRUM.split(", ")])
                    rows = []
            if n_ms1 and n_profile == n_ms1:
                raise ValueError(f"{path} holds profile spectra only; it must be centroided first")
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SPECTRUM.split(", ")])


def read_mzml(spark: SparkSession, path: str, polarity: str | None = None) -> DataFrame:
    """The centroided spectra of the mzML files at ``path``. Profile spectra beside centroided ones, and peaks that are not finite and positive, are left out; a file of
    profile spectra alone is refused, and so is one of both polarities unless ``polarity`` (``pos`` or ``neg``) chooses."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(partial(_decoded, polarity), SPECTRUM)


def ms1_tables(spectra_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``scans`` and ``points`` of the MS1 spectra; empty scans are kept."""
    one = spectra_.filter("ms_level = 1")
    points = one.select("run", "scan", F.posexplode(F.arrays_zip("mz", "inten")).alias("pos", "p")).select("run", "scan", F.col("pos").cast("bigint").alias("pos"), "p.mz", "p.inten")
    return one.select("run", "scan", "rt", "polarity", "rt_unit"), points
