"""The dealt operators of the core on awkward rows."""

import math

import numpy as np
import pytest

from lcspark.operators import impute, regrid, rowparse, spikes

NINE = "n,100.5,[M+H]+,2,C6H6,K,S,1,10:1"


@pytest.mark.parametrize(
    ("row", "reason"),
    [
        (NINE, None), ("", "column_count"), (None, "column_count"), (NINE + ",x", "column_count"), ("," * 8, "skipped"), ('"n""a, b\nc",1,,2,,,,1,1:1', None), ('"""a""",1,,2,,,,1,1:1', None),
        ('"n"x,1,,2,,,,1,1:1', "quoting"), ('a"b' + "," * 8, "quoting"), ('n,1,,2,,,,1,"1:1', "quoting"), ('"a,b', "quoting"),
        ("n,0,,2,,,,1,1:1", "bad_value"), ("n,5000,,2,,,,1,1:1", "bad_value"), ("n,4999.9,,2,,,,1,1:1", None), ("n,4e3,,2,,,,1,1:1", None), ("n,1e9,,2,,,,1,1:1", "bad_value"), ("n,+5,,2,,,,1,1:1", "bad_value"), ("n,NaN,,2,,,,1,1:1", "bad_value"),
        ("n,1,,2,C0,,,1,1:1", "bad_value"), ("n,1,,2,C01,,,1,1:1", "bad_value"), ("n,1,,2,Br2Cl,,,1,1:1", None), ("n,1,,2,Xe,,,1,1:1", "bad_value"), ("n,x,,1,,,,0,", "bad_value"),
        ("n,1,,ms1,,,,1,1:1", "skipped"), ('n,1,,"1",,,,1,1:1', "skipped"), ("n,1,,2,,,,0,", "skipped"),
        ('"' + 'a""b,' * 50_000 + '",1,,2,,,,1,1:1', None), ("," * 100_000, "column_count"), ("n,1,,2," + "C2H" * 30_000 + ",,,1,1:1", None), ("n,1,,2," + "C2H" * 30_000 + "x,,,1,1:1", "bad_value"),
    ],
)
def test_row_reasons(spark, row, reason):
    d = spark.createDataFrame([(1, "l", row, "clash")], "line_id bigint, lib string, raw string, reason string")
    (r,) = rowparse.load_library_lines(d).collect()
    assert r.reason == reason and (r.fields is None) == (reason is not None)


def test_row_values_and_empty_table(spark):
    d = spark.createDataFrame([(1, "l", '"a ""b"", c",1.5,,2,"CH4",,,1,"5:1 6:2"')], "line_id bigint, lib string, raw string")
    (r,) = rowparse.load_library_lines(d).collect()
    assert (r.fields.name, r.fields.formula, r.fields.peaks) == ('a "b", c', "CH4", "5:1 6:2")
    assert rowparse.load_library_lines(d.limit(0)).count() == 0


def _trace(n=400, seed=1, ions=(200.0, 400.0, 700.0)):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(n):
        for k, m in enumerate(ions):
            y = math.log(50_000) + 0.8 * math.sin(s / 40 + k) + rng.normal(0, 0.1)
            rows.append(["r", s, k, m * (1 + rng.normal(0, 2e-6)), math.exp(y)])
        rows.append(["r", s, 9, float(rng.uniform(60, 1600)), float(rng.uniform(500, 3000))])
    return rows


def test_planted_faults_are_flagged(spark):
    rows = _trace()
    at = {(r[1], r[2]): r for r in rows}
    want = set()
    for s, k, f in ((50, 0, 9.0), (51, 0, 9.0), (120, 1, 0.08), (300, 2, 12.0), (0, 1, 15.0)):
        at[s, k][4] *= f
        want.add((s, k, "spike"))
    for s in range(200, 212):
        at[s, 0][4] = 60_000.0 * (1 + 1e-4 * (s % 3))
        want.add((s, 0, "stuck"))
    at[250, 1][3] *= 1 + 300e-6
    want.add((250, 1, "mz_jump"))
    at[10, 2][4], at[11, 2][4], at[12, 2][4], at[13, 2][3] = 0.0, math.nan, 1e13, 30.0
    want |= {(s, 2, "impossible") for s in (10, 11, 12, 13)}
    at[14, 2][4] = None
    d = spark.createDataFrame([tuple(r) + ("x",) for r in rows], "run string, scan int, pos bigint, mz double, inten float, kind string")
    got = {(r.scan, r.pos, r.kind) for r in spikes.flag_readings(d.union(d)).collect()}
    assert got == want


def test_stretches_agree_with_whole_traces(spark):
    rows = _trace(600)
    for s in range(0, 600, 37):
        rows[s * 4 + 1][4] *= 20
    d = spark.createDataFrame([tuple(r) for r in rows], "run string, scan int, pos bigint, mz double, inten float")
    whole = {tuple(r) for r in spikes.flag_readings(d).collect()}
    assert {tuple(r) for r in spikes.flag_readings(d, 160).collect()} == whole and len(whole) == 17


def test_readings_null_and_empty(spark):
    d = spark.createDataFrame([(None, 1, 1, 100.0, 5.0), ("r", None, 1, 100.0, 5.0), ("r", 1, 1, None, None), ("r", 1, 2, math.inf, 1.0)], "run string, scan int, pos bigint, mz double, inten float")
    assert [tuple(r) for r in spikes.flag_readings(d).collect()] == [("r", 1, 2, "impossible")]
    assert spikes.flag_readings(d.limit(0)).count() == 0


def test_fill(spark):
    mask = spark.createDataFrame(
        [(1, 1, 10, "a", 1), (2, 1, None, "b", 0), (3, 1, 0, "c", 1), (4, 2, -1, "a", 1), (5, None, None, "a", 1), (6, 3, 7, "a", 1), (7, 3, 8, "b", 1), (8, 3, None, "c", None)],
        "mask_id bigint, row_no bigint, group_id bigint, run string, filled tinyint",
    ).withColumn("_fill", __import__("pyspark").sql.functions.lit(1))
    b = {r.mask_id: (r.group_id, r.group_id_filled) for r in impute.fill_block_groups(mask).collect()}
    assert b == {1: (10, 0), 2: (10, 1), 3: (10, 1), 4: (None, 0), 5: (None, 0), 6: (7, 0), 7: (8, 0), 8: (7, 1)}
    feats = spark.createDataFrame([(10, "s", -999, "?", 1), (11, "s", None, "yes", 1), (12, "s", 3, "no", 1), (13, "s", 3, "no", 1), (14, "s", None, None, None), (7, "s", None, "", 5)], "group_id bigint, study string, n_filled int, possible_halogen string, compound_id bigint")
    f = {r.group_id: (r.n_filled, r.n_filled_filled, r.possible_halogen, r.possible_halogen_filled) for r in impute.fill_features(feats, impute.fill_block_groups(mask)).collect()}
    assert f[10] == (2, 1, "no", 1) and f[11] == (None, 0, "yes", 0) and f[12] == (3, 0, "no", 0) and f[14] == (None, 0, None, 0) and f[7][1:] == (1, None, 0)
    assert impute.fill_features(feats.limit(0), impute.fill_block_groups(mask.limit(0))).count() == 0


def test_mixed_effects_shrinks(spark):
    rng = np.random.default_rng(0)
    ge, te = rng.normal(0, 2, 30), rng.normal(0, 1, 20)
    rows = [(g, t, None if (g * 7 + t) % 5 == 0 else float(10 + ge[g] + te[t] + rng.normal(0, 0.3)), float(10 + ge[g] + te[t])) for g in range(30) for t in range(20)]
    d = impute.mixed_effects(spark.createDataFrame(rows, "g int, t int, y double, truth double"), "y", "g", "t")
    p = d.filter("y_filled = 1").toPandas()
    assert len(p) == sum(r[2] is None for r in rows) and np.abs(p.y_predicted - p.truth).mean() < 0.4
    assert np.abs(p.y_predicted - p.truth).mean() < np.abs(p.truth.mean() - p.truth).mean() / 3


def _brute_grid(times, values, cell, hold):
    order = np.argsort(times)
    t, y = np.array(times)[order], np.array(values)[order]
    out = {}
    for k in range(int(np.floor(t[0] / cell)), int(np.floor(t[-1] / cell)) + 1):
        lo, hi, w, s = k * cell, (k + 1) * cell, 0.0, 0.0
        for i in range(len(t)):
            end = min(t[i + 1] if i + 1 < len(t) else t[i], t[i] + hold)
            o = max(min(end, hi) - max(t[i], lo), 0)
            w, s = w + o, s + o * y[i]
        n = int(((t >= lo) & (t < hi)).sum())
        out[k] = (n, w / cell, s / w if w else None)
    return out


def test_grid_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(regrid, "BLOCK", 8)
    rng = np.random.default_rng(3)
    t = np.sort(rng.uniform(0, 40, 120))
    t = t[(t < 10) | (t > 17)]
    y = rng.uniform(1, 9, len(t))
    d = spark.createDataFrame([("s", float(a), float(b)) for a, b in zip(t, y)] + [("s", None, 1.0), (None, 1.0, 1.0), ("s", math.nan, 2.0)], "src string, t double, y double")
    got = {r.cell: r for r in regrid.regrid(d, "src", "t", "y", 0.5).collect()}
    want = _brute_grid(t, y, 0.5, 0.5)
    assert got.keys() == want.keys()
    for k, (n, c, v) in want.items():
        assert got[k].n_readings == n and got[k].coverage == pytest.approx(c, abs=1e-9)
        assert (got[k].status == "measured") == (n > 0)
        if v is not None:
            assert got[k].value == pytest.approx(v)
    assert regrid.regrid(d.limit(0), "src", "t", "y", 0.5).count() == 0


def test_scan_units_and_redelivery(spark):
    s = spark.createDataFrame(
        [("a", 1, 30.0, "second", 1.0), ("a", 2, 60.0, None, 1.0), ("a", 2, None, None, 2.0), ("b", 1, 250.0, None, 1.0), ("c", 1, 2.0, "minute", 1.0), ("c", 1, 2.0, None, 3.0)],
        "run string, scan int, rt double, rt_unit string, loaded_at double",
    )
    got = {(r.run, r.scan): r.minutes for r in regrid.scan_readings(s).collect()}
    assert got == {("a", 1): 0.5, ("a", 2): 1.0, ("b", 1): pytest.approx(250 / 60), ("c", 1): 2.0}
    g = regrid.gap_cells(spark.createDataFrame([("x", 0), ("x", 5), ("x", 9000), ("y", 3)], "s string, k bigint"), "s", "k")
    assert g.count() == 9000 - 2 and g.filter("s = 'y'").count() == 0
