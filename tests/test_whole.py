"""Queries that do the whole job where the SQL of an older one keeps less."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lcspark.operators.compounds import territories
from lcspark.operators.features import proven_pairs, shared_positions
from lcspark.operators import spectra as s
from lcspark.operators.stats import ion_pairs
from lcspark.operators.traces import run_key
from lcspark.plans import features, graphs, spectra, traces


@pytest.fixture
def ms2(spark, data, tmp_path):
    """The test tables with ``ms2_map`` spelled by run, in a folder of its own: what spellings must not change."""
    import os

    for p in os.listdir(data):
        os.symlink(f"{data}/{p}", tmp_path / p)
    os.remove(tmp_path / "ms2_map.parquet")
    spark.read.parquet(f"{data}/ms2_map.parquet").withColumn("file", run_key(F.col("file"))).coalesce(1).write.parquet(str(tmp_path / "ms2_map.parquet"))
    return str(tmp_path)


def _rows(df):
    return sorted(map(str, df.collect()))


def test_spellings_of_a_run_change_nothing(spark, data, ms2):
    assert spark.read.parquet(f"{data}/ms2_map.parquet").filter(F.col("file") != run_key(F.col("file"))).count()
    for f in (traces.q_asof_scan_whole, traces.q_precursor_ms1_whole, spectra.q_library_candidates_whole, graphs.q_warp_knots_whole, graphs.q_warp_apply_whole, features.q_spearman_whole, features.q_group_members):
        assert _rows(f(spark, data)) == _rows(f(spark, ms2)), f.__name__
    assert traces.q_asof_scan_whole(spark, data).filter("ms1_scan is not null").count() > traces.q_asof_scan(spark, data).filter("ms1_scan is not null").count()


def test_only_proven_isomers_chain(spark):
    f = spark.createDataFrame([("s", k, 400.0, 5.0 + 0.1 * k, 4.8 + 0.1 * k, 5.2 + 0.1 * k) for k in range(1, 5)], "study string, group_id bigint, mz double, rt double, rt_min double, rt_max double")
    at = {1: [5.1] * 5, 2: [5.2] * 5, 3: [5.3] * 2, 4: [5.0, 5.4, 5.0, 5.4, None]}
    cells = spark.createDataFrame([(k, f"r{n}", x) for k, t in at.items() for n, x in enumerate(t)], "group_id bigint, run string, rt double")
    p = proven_pairs(f, cells)
    (one,) = p.collect()
    # 3 shares two runs only, 4 changes sides
    assert (one.a, one.b, one.n_codetected, one.n_timed, one.share) == (1, 2, 5, 5, 1.0) and abs(one.gap - 0.1) < 1e-9
    got = {x.id: (x.lo, x.hi) for x in territories(p, shared_positions(p, cells)).collect()}
    assert set(got) == {1, 2} and got[1][0] is None is got[2][1] and abs(got[1][1] - 5.15) < 1e-9


def test_denoising_passes_what_it_does_not_apply_to(spark):
    p = [(114.0662, 5.0), (100.5, 5.0)]
    rows = [(1, "C4H9N3O2", "[M+H]+", p), (2, None, "[M+H]+", p), (3, "C4H9N3O2", "[M+2H]2+", p), (4, "C4H9N3O2", "odd", p), (5, "C4", "[M-H]-", p), (6, "C4H9N3O2", None, None)]
    d = spark.createDataFrame(rows, "library_index bigint, formula string, precursor_type string, peaks array<struct<mz:double,inten:float>>")
    got = {r.library_index: (r.applied, r.keep) for r in s.passed(d).collect()}
    assert got == {1: (1, [False, True])} | {k: (0, [True, True]) for k in (2, 3, 4, 5)} | {6: (0, [])}


def test_halide_exchange_products_are_kept(spark):
    # chlorobenzylamine: Cl leaves, OH comes
    mz = 142.0418 - s.MASS["Cl"] + s.MASS["O"] + s.MASS["H"]
    d = spark.createDataFrame([(k, f, "[M+H]+", [(mz, 5.0)]) for k, f in ((1, "C7H8ClN"), (2, "C7H8N2O"))], "library_index bigint, formula string, precursor_type string, peaks array<struct<mz:double,inten:float>>")
    assert {r.library_index: r.keep for r in s.passed(d).collect()} == {1: [True], 2: [False]}


def test_ion_pairs_equal_the_rules(spark):
    rng = np.random.default_rng(0)
    x = {b: {int(k): float(np.exp(rng.normal())) for k in rng.choice(20, n, replace=False)} for b, n in ((1, 14), (2, 12), (3, 6), (4, 2))}
    d = spark.createDataFrame([("r", b, k, i) for b, v in x.items() for k, i in v.items()], "run string, bin bigint, scan int, i double")
    got = {(r.bin_a, r.bin_b): r for r in ion_pairs(d).collect()}
    want = {(a, b) for a in x for b in x if a < b and len(x[a].keys() & x[b].keys()) >= 3}
    assert set(got) == want and want
    for (a, b), r in got.items():
        both, either = sorted(x[a].keys() & x[b].keys()), sorted(x[a].keys() | x[b].keys())
        assert r.n == len(both) and r.pearson == pytest.approx(np.corrcoef([x[a].get(k, 0) for k in either], [x[b].get(k, 0) for k in either])[0, 1])
        la, lb = (np.log10([x[c][k] for k in both]) for c in (a, b))
        assert r.stability == pytest.approx(np.mean(np.abs(la - lb - np.median(la - lb)) <= np.log10(2)))
        assert r.corr == pytest.approx(np.corrcoef(la, lb)[0, 1]) if r.n >= 6 else r.corr is None


def test_short_runs_have_ion_pairs(spark, data):
    assert graphs.q_int_corr(spark, data).count() == 0 < graphs.q_int_corr_whole(spark, data).count()
