"""Spectral libraries as .msp text: a reader that Spark splits by files and records, and a writer.

A record is a block of lines: ``KEY: value`` lines, then peak lines that start with a digit. It ends at a blank line after its peaks or at the
next ``NAME``. Keys are compared without case and punctuation and the first of a kind counts; peaks may stand several to a line, parted by
``;`` or blanks, as ``m/z intensity`` or ``m/z:intensity``. MS1 records and records without peaks are left out and counted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lcspark.session import materialise

RECORD = "lib string, rec int, name string, precursor_mz double, precursor_type string, mode tinyint, formula string, inchikey string, smiles string, comment string, peaks array<struct<mz:double,inten:float>>, n_skipped int"

# The keys a library may use for a column, without case and punctuation.
KEYS = {
    "name": "name", "precursormz": "precursor_mz", "pepmass": "precursor_mz", "precursortype": "precursor_type", "adduct": "precursor_type", "ionmode": "polarity", "polarity": "polarity",
    "mslevel": "level", "spectrumtype": "level", "formula": "formula", "inchikey": "inchikey", "smiles": "smiles", "comment": "comment", "comments": "comment",
}
_KEY = re.compile(r"\s*([A-Za-z][\w /.-]*?)\s*:\s*(.*)")
_PAIR = re.compile(r"([0-9.]+(?:[eE][+-]?\d+)?)[\s:,\t]+([0-9.]+(?:[eE][+-]?\d+)?)")


def records(text: str) -> Iterator[tuple[dict[str, str], list[tuple[float, float]]]]:
    """The records of an .msp text, fields as text."""
    fields: dict[str, str] = {}
    peaks: list[tuple[float, float]] = []

    def whole() -> bool:
        return bool(fields or peaks)

    for line in text.splitlines():
        s = line.strip()
        if not s:
            if peaks:
                yield fields, peaks
                fields, peaks = {}, []
            continue
        if s[0].isdigit():
            for part in s.split('"')[0].split(";"):
                pairs = _PAIR.findall(part)
                peaks += [(float(a), float(b)) for a, b in pairs]
            continue
        if m := _KEY.match(s):
            key = KEYS.get(re.sub(r"[^a-z0-9]", "", m[1].lower()))
            if key == "name" and whole() and ("name" in fields or peaks):
                yield fields, peaks
                fields, peaks = {}, []
            if key and key not in fields:
                fields[key] = m[2].strip()
    if whole():
        yield fields, peaks


def _mode(fields: dict[str, str]) -> int:
    text = (fields.get("polarity") or fields.get("precursor_type", "")[-1:]).strip().lower()
    return 1 if text[:1] in ("p", "+") else 2 if text[:1] in ("n", "-") else 0


def _number(text: str | None) -> float | None:
    try:
        x = float((text or "").split()[0])
    except (ValueError, IndexError):
        return None
    return x if x == x and abs(x) != float("inf") else None


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for path, text in zip(b["path"], b["value"]):
            rows, skipped = [], 0
            for f, p in records(text or ""):
                if f.get("level", "").strip().lower() in ("1", "ms1") or not p:
                    skipped += 1
                    continue
                text_of = lambda k: f.get(k) or None  # noqa: B023, E731
                rows.append((len(rows), f.get("name", ""), _number(f.get("precursor_mz")), text_of("precursor_type"), _mode(f), text_of("formula"), text_of("inchikey"), text_of("smiles"), text_of("comment"), [{"mz": m, "inten": i} for m, i in sorted(p)]))
            d = pd.DataFrame(rows, columns=["rec", "name", "precursor_mz", "precursor_type", "mode", "formula", "inchikey", "smiles", "comment", "peaks"])
            d.insert(0, "lib", re.sub(r"\.msp$", "", path.rsplit("/", 1)[-1], flags=re.I))
            yield d.assign(n_skipped=skipped)


def read_msp(spark: SparkSession, path: str) -> DataFrame:
    """The records of the .msp files at ``path``: one row each, ``rec`` counting from 0 in a file, peaks ascending, ``mode`` 1, 2 or 0 (unknown).

    Files are the splits; a library that is larger than a task should hold is delivered in several files.
    """
    d = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return d.mapInPandas(_parsed, RECORD)


SPLIT = "lib string, block long, skipped boolean, name string, precursor_mz double, precursor_type string, mode int, formula string, inchikey string, smiles string, comment string, peaks array<struct<mz:double,inten:double>>"


def _parsed_records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in SPLIT.split(", ")]
    for b in batches:
        rows = []
        for path, block, text in zip(b["path"], b["block"], b["value"]):
            lib = re.sub(r"\.msp$", "", path.rsplit("/", 1)[-1], flags=re.I)
            for f, p in records(text or ""):
                skip = f.get("level", "").strip().lower() in ("1", "ms1") or not p
                text_of = lambda k: f.get(k) or None  # noqa: B023, E731
                rows.append((lib, block, skip, f.get("name", ""), _number(f.get("precursor_mz")), text_of("precursor_type"), _mode(f), text_of("formula"), text_of("inchikey"), text_of("smiles"), text_of("comment"), [{"mz": m, "inten": i} for m, i in sorted(p)]))
        yield pd.DataFrame(rows, columns=columns)


def read_msp_split(spark: SparkSession, path: str, separator: str = "\n\n") -> tuple[DataFrame, DataFrame]:
    """Libraries of any size: the loaded records with ``rec``, and ``(lib, n_loaded, n_skipped)``, also of a file that holds skipped ones only.

    Files are split where ``separator`` stands, inside a file too, so that a task holds a block of it. ``rec`` counts the loaded records of a file in its order: inside a block, behind those
    of the blocks before it; no file is sorted as a whole.
    """
    t = spark.read.option("lineSep", separator).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    d = t.filter("length(trim(value)) > 0").mapInPandas(_parsed_records, SPLIT).withColumn("_id", F.monotonically_increasing_id())
    d = materialise(d)
    counts = d.groupBy("lib").agg(F.count_if(~F.col("skipped")).alias("n_loaded"), F.count_if("skipped").alias("n_skipped"))
    kept = d.filter(~F.col("skipped")).drop("skipped")
    blocks = kept.groupBy("lib", "block").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("lib").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("_before", before).drop("_n")
    rec = F.row_number().over(Window.partitionBy("lib", "block").orderBy("_id")) - 1
    out = kept.withColumn("_k", rec).join(blocks, ["lib", "block"]).withColumn("rec", (F.col("_before") + F.col("_k")).cast("int"))
    return out.drop("_k", "_before", "_id", "block"), counts


def read_library(spark: SparkSession, path: str) -> DataFrame:
    """A library by the form of its file: ``.msp`` text, else a Parquet table."""
    return read_msp_split(spark, path)[0] if path.lower().rstrip("/").endswith((".msp", "*")) else spark.read.parquet(path)


def msp_text(peaks: str = "peaks") -> Column:
    """A library row as one .msp record; null fields are left out."""
    line = lambda key, c: F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.concat(F.lit(f"{key}: "), F.col(c).cast("string")))
    rows = F.array_join(F.transform(peaks, lambda p: F.concat_ws(" ", F.format_string("%.6f", p["mz"]), F.format_string("%.6g", p["inten"].cast("double")))), "\n")
    mode = F.when(F.col("mode") == 1, "IONMODE: Positive").when(F.col("mode") == 2, "IONMODE: Negative")
    return F.concat_ws("\n", line("NAME", "name"), line("PRECURSORMZ", "precursor_mz"), line("PRECURSORTYPE", "precursor_type"), mode, line("FORMULA", "formula"), line("INCHIKEY", "inchikey"), line("SMILES", "smiles"), line("COMMENT", "comment"), F.concat(F.lit("Num Peaks: "), F.size(peaks).cast("string")), rows, F.lit(""))


def write_msp(library: DataFrame, path: str) -> None:
    """``library`` as .msp files, one for each partition."""
    library.select(msp_text().alias("value")).write.mode("errorifexists").text(path)
