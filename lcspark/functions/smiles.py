"""Element counts of SMILES texts: a small parser of atoms, bonds, branches and rings, for an Arrow map."""

from __future__ import annotations

import re
from collections import Counter

# Usual valences of atoms written without brackets.
VALENCES = {"B": (3,), "C": (4,), "N": (3, 5), "O": (2,), "P": (3, 5), "S": (2, 4, 6), "F": (1,), "Cl": (1,), "Br": (1,), "I": (1,)}
_TOKEN = re.compile(r"\[\d*(?P<atom>[A-Z][a-z]?|[bcnops]|se|as)@*(?:H(?P<h>\d*))?(?P<charge>\++\d*|-+\d*)?(?::\d+)?\](?P<end>)|(?P<plain>Cl|Br|[BCNOPSFI]|[bcnops])|(?P<bond>[-=#:/\\])|(?P<ring>\d|%\d\d)|(?P<sign>[().])")
_ORDER = {"-": 1, "=": 2, "#": 3, ":": 1, "/": 1, "\\": 1}


def element_counts(smiles: str | None) -> dict[str, int] | None:
    """Atoms of a SMILES with its implied hydrogens; None for a text that is none. Aromatic atoms give one valence to their ring's system."""
    if not smiles:
        return None
    atoms: list[list] = []  # element, bonds used, hydrogens given (None: implied), aromatic
    stack, rings, last, order, at = [], {}, None, 1, 0
    while at < len(smiles):
        m = _TOKEN.match(smiles, at)
        if m is None:
            return None
        at = m.end()
        if name := m["atom"] or m["plain"]:
            given = None if m["plain"] else (int(m["h"] or 1) if m["h"] is not None else 0)
            atoms.append([name.capitalize(), 0, given, name.islower()])
            if last is not None:
                atoms[last][1] += order
                atoms[-1][1] += order
            last, order = len(atoms) - 1, 1
        elif m["bond"]:
            order = _ORDER[m["bond"]]
        elif m["ring"]:
            if last is None:
                return None
            if m["ring"] in rings:
                other, o = rings.pop(m["ring"])
                for k in (other, last):
                    atoms[k][1] += max(o, order)
            else:
                rings[m["ring"]] = (last, order)
            order = 1
        elif m["sign"] == "(":
            stack.append(last)
        elif m["sign"] == ")":
            if not stack:
                return None
            last = stack.pop()
        else:
            last = None
    if rings or stack or not atoms:
        return None
    out: Counter = Counter()
    for name, used, given, aromatic in atoms:
        out[name] += 1
        if given is not None:
            out["H"] += given
        elif aromatic:
            out["H"] += max(VALENCES[name][0] - used - 1, 0)
        else:
            out["H"] += next((v - used for v in VALENCES[name] if v >= used), 0)
    return {e: n for e, n in out.items() if n}


def hill_text(counts: dict[str, int]) -> str:
    """Carbon, hydrogen, then by symbol; all by symbol without carbon."""
    first = [e for e in ("C", "H") if e in counts] if "C" in counts else []
    return "".join(f"{e}{n if n > 1 else ''}" for e, n in [*((e, counts[e]) for e in first), *sorted((e, n) for e, n in counts.items() if e not in first)])
