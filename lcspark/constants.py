"""Fixed values of the mass-spectrometric rules."""

#: Monoisotopic masses, heavy to light with hydrogen last.
MASS = {
    "I": 126.904473, "Br": 78.9183371, "K": 38.96370668, "Cl": 34.96885268, "S": 31.97207100, "P": 30.97376163, "Si": 27.9769265325,
    "Na": 22.9897692809, "F": 18.99840322, "O": 15.99491461956, "N": 14.0030740048, "C": 12.0, "H": 1.00782503207,
}
#: Masses of the electron and the proton, and the step from 12C to 13C.
ELECTRON = 0.00054857990946
PROTON = 1.00727646688
C13 = 1.0033548378

#: The formulas of the neutral pieces that adduct names use.
ADDUCT_PIECES = {
    "H": "H", "Na": "Na", "K": "K", "NH4": "NH4", "NH3": "NH3", "H2O": "H2O", "Cl": "Cl", "Br": "Br", "HCOO": "CHO2", "HCOOH": "CH2O2", "FA": "CH2O2",
    "CH3COO": "C2H3O2", "CH3COOH": "C2H4O2", "Hac": "C2H4O2", "OAc": "C2H3O2", "ACN": "C2H3N", "CH3CN": "C2H3N", "CH3OH": "CH4O", "MeOH": "CH4O",
    "IsoProp": "C3H8O", "DMSO": "C2H6OS", "CO2": "CO2", "CO": "CO", "HF": "HF", "HCl": "HCl",
}

#: Heteroatom combinations that occur: the number that each element must exceed for a rule to hold, and its highest counts then.
COMBINATIONS = (
    ({"N": 0, "O": 0, "P": 0, "S": 0}, {"N": 9, "O": 19, "P": 3, "S": 2}),
    ({"N": 3, "O": 3, "P": 3}, {"N": 10, "O": 21, "P": 5}),
    ({"O": 1, "P": 1, "S": 1}, {"O": 13, "P": 2, "S": 2}),
    ({"P": 1, "S": 1, "N": 1}, {"P": 2, "S": 2, "N": 3}),
    ({"N": 6, "O": 6, "S": 6}, {"N": 18, "O": 13, "S": 7}),
)
