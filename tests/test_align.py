"""Alignment and scoring operators against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lcspark.operators import align, truth


def test_start_clusters_never_chain(spark):
    rng = np.random.default_rng(1)
    rows = [(g, i, float(x)) for g in ("a", "b") for i, x in enumerate(np.round(rng.uniform(0, 3, 120), 2))]
    got = {(r.g, r.i): (r.cluster, r.weight) for r in align.start_clusters(spark.createDataFrame(rows, "g string, i int, x double"), "g", "x", "i", 0.05).collect()}
    for g in ("a", "b"):
        s = sorted((x, i) for h, i, x in rows if h == g)
        start, first, of = None, 0, {}
        for k, (x, i) in enumerate(s, 1):
            if start is None or x - start > 0.05:
                start, first = x, k
            of[i] = first
        assert {i: c for (h, i), (c, _) in got.items() if h == g} == of
        assert all(got[g, i][1] == pytest.approx(1 / list(of.values()).count(c)) for i, c in of.items())


def test_isotonic_equals_pooling(spark):
    rng = np.random.default_rng(3)
    y, w = np.arange(15) * 0.3 + rng.normal(0, 1, 15), rng.integers(1, 5, 15).astype(float)
    blocks = []
    for v, k in zip(y, w):
        blocks.append([v, k, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    want = [v for v, _, n in blocks for _ in range(n)]
    d = spark.createDataFrame([("r", k, float(a), float(b)) for k, (a, b) in enumerate(zip(y, w))], "g string, k int, y double, w double")
    assert [r.fit for r in align.isotonic(d, "g", "k", "y", "w").orderBy("k").collect()] == pytest.approx(want)


def test_a_jump_is_one_step(spark):
    rows = [("r", k, k / 10, 0.1 if k < 30 else -21.8, 1 if k < 30 else 2) for k in range(80)] + [("r", 100, 0.55, -22.0, 2)]
    rows += [("mixed", k, k / 10, 0.0, 1 + k % 2) for k in range(60)]
    d = spark.createDataFrame(rows, "run string, anchor int, rt double, d_ppm double, mode int")
    (one,) = align.label_steps(d).collect()
    assert one.run == "r" and one.at == pytest.approx(2.95) and (one.before, one.after, one.wrong) == (0.1, -21.8, 1)


def test_modes_see_a_jumped_calibration(spark):
    rng = np.random.default_rng(0)
    d = [("r", float(x)) for x in np.concatenate([rng.normal(0.3, 0.5, 60), rng.normal(-22, 0.5, 30), rng.uniform(-30, 30, 20)])]
    p = spark.createDataFrame([(r, k, k, 1.0, 0.0, x) for k, (r, x) in enumerate(d)], "run string, anchor int, target int, rt double, d_rt double, d_ppm double")
    m = {r.mode: r for r in align.mz_modes(p).collect()}
    assert m[1].offset == pytest.approx(0.3, abs=0.3) and m[2].offset == pytest.approx(-22, abs=0.4) and m[1].support > m[2].support >= 25 and m[1].background < 10
    assert align.mz_modes(p.limit(0)).count() == 0 and align.coarse_shift(p.limit(0)).count() == 0


def test_two_factors_are_not_negative(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for g in range(30):
        a, b = rng.normal(size=12), rng.normal(size=12)
        y = rng.normal() * a + rng.normal() * b + rng.normal(0, 0.1, 12)
        grid = [(max(u, 0), max(v, 0)) for u, v in ((np.linalg.lstsq(np.stack([a, b], 1), y, rcond=None)[0]),)]
        cands = [(u, v) for u, v in [np.linalg.lstsq(np.stack([a, b], 1), y, rcond=None)[0]] if u >= 0 and v >= 0] or [(max((a @ y) / (a @ a), 0), 0.0), (0.0, max((b @ y) / (b @ b), 0))]
        want[g] = min(float(np.sqrt(np.mean((y - u * a - v * b) ** 2))) for u, v in cands)
        assert grid
        rows += [(g, float(p), float(q), float(r)) for p, q, r in zip(a, b, y)]
    got = {r.g: r for r in align.two_factor_nnls(spark.createDataFrame(rows, "g int, a double, b double, y double"), ["g"], "y", "a", "b").collect()}
    assert all(got[g].residual == pytest.approx(want[g]) and got[g].u >= 0 and got[g].v >= 0 for g in want)


def test_vial_medians_count_absent_runs(spark):
    design = spark.createDataFrame([(f"r{k}", "v" if k < 5 else "w") for k in range(9)], "run string, vial string")
    cells = spark.createDataFrame([(1, "r0", 4.0), (1, "r1", 6.0), (1, "r2", 8.0), (1, "r5", 3.0), (1, "r6", 5.0), (2, "r0", 9.0), (3, "r5", 1.0), (3, "r5", 2.0), (3, "r6", 4.0), (3, "r7", 6.0)], "g int, run string, h double")
    got = {(r.g, r.vial): (r.n_runs, r.h) for r in truth.vial_medians(cells, design, "g", "run", "vial", "h").collect()}
    assert got == {(1, "v"): (5, 4.0), (1, "w"): (4, 1.5), (2, "v"): (5, 0.0), (3, "w"): (4, 3.0)}


def test_peak_groups_and_names(spark):
    p = spark.createDataFrame([("c", 1, 1.0, 5.0, 300.0), ("c", 2, 1.05, 1.0, 301.00335), ("c", 3, 1.4, 9.0, 282.0), ("c", 4, 1.45, 1.0, 321.982)], "k string, id int, rt double, height double, mz double")
    got = {r.id: (r.chain, r.place) for r in truth.peak_groups(p, "k", 0.1).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (2, 1), 4: (2, 1)}
    named = {r.id: (r.name, r.kind) for r in truth.annotated(p.withColumn("height", F.when(F.col("id") == 1, 99.0).otherwise(F.col("height"))), "k", {"M+1": ("isotope", 1.00335), "Na": ("adduct", 21.9819)}).collect()}
    assert named == {1: (None, "base"), 2: ("M+1", "isotope"), 3: (None, "fragment"), 4: ("Na", "adduct")}


def test_complementary_groups_merge_without_chains(spark):
    from lcspark.operators import scans

    g = [(1, 300.0, 2.0, 9), (2, 300.0003, 2.03, 4), (3, 300.0002, 2.06, 3), (4, 300.0, 2.02, 2), (5, 400.0, 2.0, 5), (6, 300.0, 5.0, 3)]
    f = spark.createDataFrame([("s", i, mz, rt, rt - 0.05, rt + 0.05, n) for i, mz, rt, n in g], "study string, group_id bigint, mz double, rt double, rt_min double, rt_max double, n_detected int")
    runs = {1: "abc", 2: "de", 3: "ef", 4: "a", 5: "x", 6: "y"}
    seen = spark.createDataFrame([(i, r) for i, x in runs.items() for r in x], "group_id bigint, run string")
    # 1 takes 2 (nearest that shares no run); 3 then shares e with it; 4 shares a with 1, and 3 takes it
    assert {(r.id, r.target) for r in scans.merge_complementary(f, seen).collect()} == {(2, 1), (4, 3)}
    assert scans.merge_complementary(f.limit(0), seen).count() == 0


def test_a_jumped_scan_is_moved_back(spark):
    from lcspark.operators import scans

    rng = np.random.default_rng(4)
    ions = np.linspace(150, 900, 20)
    rows = [("r", g, s, s / 60, float(m * (1 + (rng.normal(0, 0.5) + (12 if s in (30, 50, 70, 90) else 0)) * 1e-6)), 1e5) for s in range(100) for g, m in enumerate(ions)]
    t = spark.createDataFrame(rows, "run string, group_id bigint, scan int, minutes double, mz double, inten double")
    sh = scans.scan_shifts(t).cache()
    assert {r.scan for r in sh.filter("jumped = 1").collect()} == {30, 50, 70, 90}
    back = scans.corrected_mz(t.select("run", "scan", "group_id", "mz"), sh).filter("moved = 1").collect()
    assert len(back) == 80 and max(abs(r.mz / ions[r.group_id] - 1) * 1e6 for r in back) < 4
