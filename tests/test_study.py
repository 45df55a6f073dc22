"""Estimates, windows, annotations, SMILES, clusters and links on small cases and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lcspark.functions.smiles import element_counts, hill_text
from lcspark.operators import compounds, impute, ions, links, shape, study, traces


@pytest.mark.parametrize(
    ("smiles", "formula"),
    [("CCO", "C2H6O"), ("c1ccccc1", "C6H6"), ("c1ccncc1", "C5H5N"), ("c1cc[nH]c1", "C4H5N"), ("CC(=O)O", "C2H4O2"), ("CS(=O)(=O)C", "C2H6O2S"), ("C#N", "CHN"), ("[Na+].[Cl-]", "ClNa"), ("OC(=O)C(N)CS", "C3H7NO2S"), ("BrCCl", "CH2BrCl"),
     ("C1CC1", "C3H6"), ("C%12CC%12", "C3H6"), ("c1ccsc1", "C4H4S"), ("[13CH4]", "CH4"), ("C[N+](C)(C)C", "C4H12N"), ("O=P(O)(O)O", "H3O4P"), ("F/C=C/F", "C2H2F2")],
)
def test_smiles_give_their_formula(smiles, formula):
    assert hill_text(element_counts(smiles)) == formula


def test_broken_smiles_give_none():
    assert all(element_counts(x) is None for x in (None, "", "C(", "C)", "C1CC", "xyz", "1C", "C(C"))


def test_widths_are_better_than_the_mean(spark):
    rng = np.random.default_rng(0)
    compound = rng.normal(0, 0.03, 80)
    rows, hidden = [], {}
    for g in range(1200):
        c, rt = int(rng.integers(80)), float(rng.uniform(0, 12))
        w = float(abs(0.1 + compound[c] + 0.008 * rt + rng.normal(0, 0.005)))
        known = rng.random() > 0.2
        rows.append((g, "s", c, rt, rt - w if known else None, rt + w, float("nan") if g % 7 == 0 else w / 4))
        if not known:
            hidden[g] = rt - w
    d = spark.createDataFrame(rows, "group_id bigint, study string, compound_id bigint, rt double, rt_min double, rt_max double, rt_sd double").withColumn("minute", F.lit(1))
    got = {r.group_id: r for r in impute.fill_widths(d).collect()}
    assert len(got) == 1200 and all(got[g].rt_min_filled == (g in hidden) for g in got) and all(got[g].rt_sd_filled == (g % 7 == 0) for g in got) and not any(r.rt_max_filled for r in got.values())
    err = np.array([got[g].rt_min - x for g, x in hidden.items()])
    mean = np.mean([r[3] - r[4] for r in rows if r[4] is not None])
    plain = np.array([(rows[g][3] - mean) - x for g, x in hidden.items()])
    assert np.sqrt((err**2).mean()) < 0.5 * np.sqrt((plain**2).mean())
    assert impute.fill_widths(d.limit(0)).count() == 0
    none = impute.fill_widths(d.withColumn("rt_min", F.lit(None).cast("double"))).filter("rt_min is not null").count()
    assert none == 0


def test_quantile_equals_numpy(spark):
    rng = np.random.default_rng(2)
    x = {"a": np.exp(rng.normal(5, 3, 700)), "b": np.repeat([3.0, 7.0], [5, 4]), "c": np.array([2.0])}
    d = spark.createDataFrame([(k, float(v)) for k, y in x.items() for v in y], "k string, v double")
    for q in (0.01, 0.25, 0.5, 0.999, 1.0):
        got = {r.k: r.v for r in traces.ranked_value(d, ["k"], "v", q).collect()}
        assert got == {k: pytest.approx(np.quantile(y, q)) for k, y in x.items()}


def test_electronic_noise_starts_at_the_groups_first(spark):
    rows = [(1, [100.0, 100.05, 100.09, 100.1, 100.15, 300.0]), (2, [5.0, 5.001, 5.002]), (3, []), (4, [7.0] * 4 + [8.0])]
    d = spark.createDataFrame(rows, "id int, i array<double>")
    got = {r.id: r.m for r in d.select("id", study.electronic_mask(F.col("i")).alias("m")).collect()}
    # 100.15 is beyond the group that 100.0 starts
    assert got == {1: [True, True, True, True, False, False], 2: [False] * 3, 3: [], 4: [True] * 4 + [False]}


def test_annotations_and_their_retirement(spark):
    f = spark.createDataFrame([(k,) for k in range(5)], "group_id bigint")
    user = spark.createDataFrame([(0, "mine", 1), (0, "better", 2), (1, "gone", 1), (1, None, 2), (2, "", 1)], "group_id bigint, annotation string, at int")
    lib = spark.createDataFrame([(0, "lib", 0.9), (1, "lib", 0.8), (2, "lib", 0.9), (3, "low", 0.5)], "group_id bigint, name string, score double")
    got = {r.group_id: (r.annotation, r.source) for r in study.annotations(f, user, lib).collect()}
    assert got == {0: ("better", "user"), 1: ("lib", "library"), 2: ("", "user"), 3: ("", "none"), 4: ("", "none")}
    old = spark.createDataFrame([(1, "s", 300.0, 2.0), (2, "s", 400.0, 2.0)], "group_id bigint, study string, mz double, rt double")
    new = spark.createDataFrame([(11, "s", 300.001, 2.05), (12, "s", 300.001, 2.01), (13, "s", 400.0, 3.0)], "group_id bigint, study string, mz double, rt double")
    got = {(r.group_id, r.annotation, r.retired) for r in study.retired(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "group_id bigint, annotation string, at int"), old, new).collect()}
    assert got == {(12, "a", 0), (2, "b", 1)}


def _consistent(members, pairs, cut, margin=0.05, rounds=4):
    w = {i: x for i, _, x in members}
    cl = {i: c for i, c, _ in members}
    r = {}
    for a, b, v in pairs:
        r[a, b] = r[b, a] = v
    for k in range(rounds):
        new = {}
        for i in cl:
            def agree(c, i=i):
                rest = [j for j in cl if cl[j] == c and j != i]
                return sum(w[j] * r.get((i, j), 0.0) for j in rest) / sum(w[j] for j in rest) if rest else None
            mine = agree(cl[i])
            near = {cl[j] for j in cl if (i, j) in r and cl[j] != cl[i]}
            best = max(((agree(c), -c) for c in near), default=None)
            if best and best[0] >= cut and (mine is None or best[0] > mine + margin):
                new[i] = -best[1]
            elif mine is not None and mine < cut:
                new[i] = i + (k + 1) * (1 << 58)
        if not new:
            break
        cl |= new
    return {frozenset(j for j in cl if cl[j] == c) for c in cl.values()}


def test_consistent_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    for _ in range(3):
        m = [(i, int(rng.integers(0, 4)), float(np.round(rng.uniform(1, 9), 2))) for i in range(16)]
        p = [(a, b, float(np.round(rng.uniform(-0.2, 1), 3))) for a in range(16) for b in range(a + 1, 16) if rng.random() < 0.5]
        got: dict = {}
        for r in ions.consistent_clusters(spark.createDataFrame(m, "id bigint, cluster bigint, w double"), spark.createDataFrame(p, "a bigint, b bigint, r double"), 0.5).collect():
            got.setdefault(r.cluster, set()).add(r.id)
        assert {frozenset(x) for x in got.values()} == _consistent(m, p, 0.5)


def test_consistent_clusters_of_any_ids(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    two = 5 + (1 << 58)
    m = [(high, high, 2.0), (high - 1, high, 1.0), (low, two, 1.0), (two, two, 3.0), (5, 5, 9.0), (7, 5, 1.0), (8, None, 1.0)]
    p = [(high, high - 1, -0.5), (low, two, 0.9)]
    got = ions.consistent_clusters(spark.createDataFrame(m, "id bigint, cluster bigint, w double"), spark.createDataFrame(p, "a bigint, b bigint, r double"), 0.5)
    assert {tuple(r) for r in got.select("id", "cluster").collect()} == {(high, high), (high - 1, high - 1), (low, two), (two, two), (5, 5), (7, 7)}


def test_roles_of_both_polarities_and_isotopes(spark):
    table = {p: {n: (k, d, z) for n, k, d, z in compounds.ion_table(p)} for p in ("pos", "neg")}
    assert table["pos"]["[M+H]+"][1] == pytest.approx(1.00727646688, abs=1e-6) and table["neg"]["[M-H]-"][1] == pytest.approx(-1.00727646688, abs=1e-6) and table["neg"]["[2M-H]-"][0] == 2 and table["pos"]["[M+2H]2+"][2] == 2
    for pol, names in (("pos", ("[M+H]+", "[M+Na]+", "[2M+H]+", "[M+H-H2O]+")), ("neg", ("[M-H]-", "[M+Cl]-", "[M+HCOO]-", "[M-2H]2-"))):
        m = 300.123456
        rows = [(k, 0, (table[pol][n][0] * m + table[pol][n][1]) / table[pol][n][2], 10.0 - k) for k, n in enumerate(names)] + [(8, 0, 0.0, 1.0), (9, 0, 555.5, 0.5)]
        rows[4] = (8, 0, rows[0][2] + 1.00335, 1.0)
        d = spark.createDataFrame(rows, "id bigint, center bigint, mz double, weight double")
        iso = spark.createDataFrame([(8, 0, 1)], "id bigint, parent bigint, k int")
        got = {r.id: r.role for r in compounds.roles(d, polarity=pol, isotopes=iso).collect()}
        assert [got[k] for k in range(4)] == list(names) and got[8] == f"{names[0]} M+1" and got[9][0] in "+-"


def test_links_climb_to_one_apex(spark):
    pts = []
    for c, (mz, at) in enumerate(((300.0, 20), (300.0, 60), (400.0, 30))):
        pts += [("r", s, c, mz * (1 + 1e-6 * (s % 3)), float(1e5 * np.exp(-((s - at) ** 2) / 20))) for s in range(at - 12, at + 13)]
    d = spark.createDataFrame(pts, "run string, scan int, pos bigint, mz double, inten double")
    r = links.roots(links.links(d))
    b = {x.root: x for x in links.basins(d, r).collect()}
    assert r.count() == len(pts) and sorted(k // links.SCAN_STEP for k in b) == [20, 30, 60] and all(x.n_scans == 25 and x.height == 1e5 for x in b.values())
    assert links.roots(links.links(d.limit(0))).count() == 0


def test_a_peak_is_confirmed_and_a_slope_is_not(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g, y in ((1, lambda s: 1e5 * np.exp(-((s - 48) ** 2) / 30)), (2, lambda s: 1e3 * s), (3, lambda s: 0.0)):
        rows += [("s_r", g, s, s / 60, 300.0 + g, float(max(y(s) + rng.uniform(0, 200), 0))) for s in range(128)]
    t = spark.createDataFrame(rows, "run string, group_id bigint, scan int, minutes double, mz double, inten double")
    w = spark.createDataFrame([("s_r", g, 1, 40, 56) for g in (1, 2, 3)], "run string, group_id bigint, block bigint, scan_lo int, scan_hi int")
    p = shape.prominences(shape.smoothed_traces(t), w)
    got = {r.group_id: r for r in p.collect()}
    assert got[1].is_apex == 1 and abs(got[1].top_scan - 48) <= 1 and got[1].prominence > 5e4 and got[2].is_apex == 0
    ref = spark.createDataFrame([("s", g, 1e5, 100.0) for g in (1, 2, 3)], "study string, group_id bigint, height double, noise double")
    assert {r.group_id: r.confirmed for r in shape.confirmed(p, ref).collect()} == {1: 1, 2: 0, 3: 0}


def test_tiles_do_not_change_what_is_picked(spark, monkeypatch):
    from lcspark.operators import pick

    rng = np.random.default_rng(6)
    pts = []
    for k in range(40):
        mz, at, h = float(rng.uniform(200, 260)), int(rng.integers(30, 570)), float(np.exp(rng.uniform(9, 13)))
        pts += [("r", s, k, mz * (1 + rng.normal(0, 1e-6)), h * float(np.exp(-((s - at) ** 2) / 18))) for s in range(max(at - 10, 1), at + 11)]
    pts += [("r", int(rng.integers(1, 600)), 900 + k, float(rng.uniform(200, 260)), float(rng.uniform(50, 400))) for k in range(1500)]
    d = spark.createDataFrame([p for p in pts if p[4] > 100], "run string, scan int, pos bigint, mz double, inten double")
    times = spark.range(1, 620).select(F.lit("r").alias("run"), F.col("id").cast("int").alias("scan"), (F.col("id") / 60).alias("minutes"))
    rows = lambda: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in pick.pick(d, times).collect())
    whole = rows()
    monkeypatch.setattr(pick, "STRETCH", 64)
    monkeypatch.setattr(pick, "OVERLAP_SCANS", 40)
    monkeypatch.setattr(pick, "TILE", 0.002)
    assert rows() == whole and 30 <= len(whole) <= 60
