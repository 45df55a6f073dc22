import pytest
from pyspark.sql import functions as F

from lcspark.operators import halogen


def test_patterns_by_hand():
    assert halogen.pattern({"C": 1})[:2] == pytest.approx([0.9893, 0.0107])
    assert halogen.pattern({"Cl": 1})[2] == pytest.approx(0.2424) and halogen.pattern({"Br": 2})[2] == pytest.approx(2 * 0.4931 * 0.5069)
    p = halogen.pattern({"C": 8, "H": 10, "N": 4, "O": 2})
    assert p[1] / p[0] == pytest.approx(0.103, abs=0.004)


@pytest.mark.parametrize(
    ("composition", "mass", "call", "name"),
    [
        ({"C": 10, "H": 11, "O": 3, "Cl": 1}, 214.04, "yes", "Cl"), ({"C": 14, "H": 11, "N": 1, "O": 2, "Cl": 2}, 295.02, "yes", "Cl2"), ({"C": 12, "H": 7, "O": 2, "Cl": 3}, 287.95, "yes", "Cl3"),
        ({"C": 6, "H": 5, "O": 1, "Br": 1}, 171.95, "yes", "Br"), ({"C": 6, "H": 4, "O": 1, "Br": 1, "Cl": 1}, 205.91, "yes", "BrCl"), ({"C": 8, "H": 10, "N": 4, "O": 2}, 194.08, "no", "none"), ({"C": 10, "H": 17, "N": 3, "O": 6, "S": 1}, 307.08, "no", "S"),
    ],
)
def test_verdicts(composition, mass, call, name):
    p = halogen.pattern(composition)
    got = halogen.verdict(mass, (p[1:] / p[0]).tolist())
    assert got[0] == call and (call == "no" or got[1] == name)


def test_verdicts_of_spectra(spark):
    p = halogen.pattern({"C": 14, "H": 11, "N": 1, "O": 2, "Cl": 2})
    rows = [("r", 1, 295.02 + k * (0.99852 if k % 2 == 0 else 1.00335), 1e6 * float(x / p[0])) for k, x in enumerate(p) if x > 1e-3 or k == 0] + [("r", 1, 500.0, 1e5), ("r", 2, 100.0, 5.0)]
    d = spark.createDataFrame(rows, "run string, scan int, mz double, inten double")
    got = {round(x.mz, 2): (x.verdict, x.pattern) for x in halogen.halogens(d).collect()}
    assert got[295.02] == ("yes", "Cl2") and 500.0 not in got
    assert halogen.verdict(300.0, [None, None]) == ("no", "none") and halogen.halogens(d.filter(F.lit(False))).count() == 0
