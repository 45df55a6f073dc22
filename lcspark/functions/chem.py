"""Formulas, adducts and plausibility rules as JVM expressions over an element-count map of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lcspark.constants import ADDUCT_PIECES, COMBINATIONS, ELECTRON, MASS
from lcspark.session import once


def is_formula(formula: Column) -> Column:
    """A plain formula over the known elements: no charge, isotope or bracket."""
    return formula.rlike(r"\A(?:(?:Br|Cl|Si|Na|I|K|S|P|F|O|N|C|H)[0-9]*+)++\z")


def count_of(formula: Column, element: str) -> Column:
    """How often ``element`` stands in a formula; repeated symbols add up."""
    after = "(?![a-z])"
    found = F.regexp_extract_all(formula, F.lit(f"{element}{after}([0-9]*)"), F.lit(1))
    return F.aggregate(found, F.lit(0), lambda acc, x: acc + F.when(x == "", 1).otherwise(F.expr("0") + x.cast("int")))


def counts(formula: Column) -> dict[str, Column]:
    return {e: count_of(formula, e) for e in MASS}


def with_counts(df: DataFrame, formula: str) -> tuple[DataFrame, dict[str, Column]]:
    """The rows with a plain formula and their element counts, each parsed once."""
    d = once(df.filter(is_formula(F.col(formula))), _n=F.struct(*[c.alias(e) for e, c in counts(F.col(formula)).items()]))
    return d, {e: F.col("_n")[e] for e in MASS}


def mass_of(n: dict[str, Column]) -> Column:
    """Monoisotopic mass of element counts."""
    total = F.lit(0.0)
    for e, m in MASS.items():
        total = total + n[e] * F.lit(m)
    return total


def hill(n: dict[str, Column]) -> Column:
    """Hill-order text of element counts: C, H, then by symbol."""
    order = ["C", "H", *sorted(e for e in MASS if e not in ("C", "H"))]
    return F.concat(*[F.when(n[e] > 1, F.concat(F.lit(e), n[e].cast("string"))).when(n[e] == 1, e).otherwise("") for e in order])


def dbe2(n: dict[str, Column]) -> Column:
    """Twice the double-bond equivalents: odd for even-electron ions."""
    return 2 * n["C"] + 2 * n["Si"] + 2 + n["N"] + n["P"] - n["H"] - n["F"] - n["Cl"] - n["Br"] - n["I"] - n["Na"] - n["K"]


def piece_mass(piece: str) -> float:
    import re

    return sum(MASS[e] * int(k or 1) for e, k in re.findall(r"([A-Z][a-z]?)(\d*)", piece))


def adduct_parts(adduct: Column) -> tuple[Column, Column, Column]:
    """(mass added to the molecules, number of molecules, signed charge) of an adduct name; nulls where it is unknown or an isotopologue.

    Terms are looked up in a map of the named pieces, so that one expression serves all adducts.
    """
    text = F.regexp_replace(adduct, " ", "")
    shape = r"\A\[([0-9]*)M((?:[+-][A-Za-z0-9]+)*)\]([0-9]*)([+-])\z"
    ok = text.rlike(shape)
    g = lambda k: F.regexp_extract(text, shape, k)
    number = lambda c: F.when(c == "", 1).otherwise(F.nullif(c, F.lit("")).cast("int"))
    masses = F.create_map(*[x for p, f in ADDUCT_PIECES.items() for x in (F.lit(p), F.lit(piece_mass(f)))])
    terms = F.regexp_extract_all(g(2), F.lit(r"([+-][0-9]*[A-Za-z][A-Za-z0-9]*)"), F.lit(1))
    term = lambda t: F.when(t.startswith("-"), -1.0).otherwise(1.0) * number(F.regexp_extract(t, r"\A[+-]([0-9]*)", 1)) * F.try_element_at(masses, F.regexp_extract(t, r"\A[+-][0-9]*(.*)\z", 1))
    delta = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + term(t))
    return F.when(ok, delta), F.when(ok, number(g(1))), F.when(ok, number(g(3)) * F.when(g(4) == "+", 1).otherwise(-1))


def ion_mz(neutral_mass: Column, adduct: Column) -> Column:
    """m/z of the adduct of a neutral mass, null for an unknown adduct."""
    delta, n, z = adduct_parts(adduct)
    return (n * neutral_mass + delta - z * F.lit(ELECTRON)) / F.abs(z)


#: Most atoms of an element per carbon, and the highest counts by mass window (upper edge in Da), both after the Golden Rules.
PER_CARBON = {"N": 4, "O": 3, "P": 2, "S": 3, "F": 6, "Cl": 2, "Br": 2, "I": 2, "Si": 1}
CAP_ELEMENTS = ("I", "Br", "K", "Cl", "S", "P", "Si", "Na", "F", "O", "N", "C", "H")
CAPS = {
    500.0: (4, 4, 4, 10, 10, 9, 8, 4, 16, 20, 20, 39, 72),
    1000.0: (8, 8, 4, 12, 14, 9, 14, 4, 34, 27, 20, 78, 126),
    2000.0: (10, 10, 4, 12, 14, 9, 15, 4, 48, 63, 20, 156, 236),
    float("inf"): (8, 8, 4, 11, 9, 6, 15, 4, 16, 78, 48, 162, 208),
}


def ratios_ok(n: dict[str, Column], mass: Column) -> Column:
    """Element ratios to carbon and element caps of the mass window."""
    ok = F.lit(True)
    for e, r in PER_CARBON.items():
        ok = ok & (n[e] <= r * n["C"])
    for k, e in enumerate(CAP_ELEMENTS):
        cap = F.lit(None).cast("int")
        for edge, row in reversed(CAPS.items()):
            cap = F.lit(row[k]) if edge == float("inf") else F.when(mass < edge, row[k]).otherwise(cap)
        ok = ok & (n[e] <= cap)
    return ok


def combinations_ok(n: dict[str, Column]) -> Column:
    """Heteroatom combinations that occur: each rule bounds its elements once all of them exceed a number."""
    ok = F.lit(True)
    for over, most in COMBINATIONS:
        applies = F.lit(True)
        for e, k in over.items():
            applies = applies & (n[e] > k)
        for e, k in most.items():
            ok = ok & (~applies | (n[e] <= k))
    return ok


def precursor_ok(n: dict[str, Column], mass: Column, even_electron: bool = False) -> Column:
    """A plausible organic precursor: H per C from 0.1 to 6, ratios, caps, combinations and double-bond equivalents."""
    d = dbe2(n)
    ok = (n["C"] > 0) & (10 * n["H"] >= n["C"]) & (n["H"] <= 6 * n["C"]) & ratios_ok(n, mass) & combinations_ok(n) & (d >= -1)
    return ok & (d % 2 != 0) if even_electron else ok


def most_hydrogens(n: dict[str, Column], extra: int) -> Column:
    """Hydrogens that a sum of saturated pieces can carry: two for C, O and S, three for N and P, four for Si, one for a monovalent atom, and ``extra``."""
    return 2 * (n["C"] + n["O"] + n["S"]) + 3 * (n["N"] + n["P"]) + n["F"] + n["Cl"] + n["Br"] + n["I"] + n["Na"] + n["K"] + 4 * n["Si"] + extra


def _small_inorganic(n: dict[str, Column], extra: int) -> Column:
    heavy = [n[e] for e in MASS if e != "H"]
    atoms, kinds = sum(heavy[1:], heavy[0]), sum([(x > 0).cast("int") for x in heavy[1:]], (heavy[0] > 0).cast("int"))
    return (atoms >= 1) & (atoms <= 6) & (kinds <= 2) & (n["H"] <= most_hydrogens(n, extra))


def loss_ok(n: dict[str, Column], mass: Column) -> Column:
    """A neutral loss, perhaps of several molecules: hydrogens within the most, ratios and caps; without carbon H to H4 or a small inorganic."""
    heavy = [n[e] for e in MASS if e != "H"]
    bare = sum(heavy[1:], heavy[0]) == 0
    return F.when(n["C"] > 0, (n["H"] <= most_hydrogens(n, 2)) & ratios_ok(n, mass)).when(bare, n["H"].between(1, 4)).otherwise(_small_inorganic(n, 0))


def ion_ok(n: dict[str, Column], mass: Column) -> Column:
    """A fragment ion, odd or even in electrons: hydrogens, ratios, caps and combinations; without carbon only a small inorganic ion."""
    return F.when(n["C"] > 0, (n["H"] <= most_hydrogens(n, 2)) & ratios_ok(n, mass) & combinations_ok(n)).otherwise(_small_inorganic(n, 1))
