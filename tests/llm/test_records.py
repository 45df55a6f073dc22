"""Survivors, nearest time, top hits and mixing on awkward rows."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lcspark.llm import mix, nearest, survivors, topn
from lcspark.llm.tokens import TOKENIZERS, _encoding, TokenCounter

MS2 = "map_id bigint, file string, scan string, tic double, precursor_purity double, representative int, loaded_at timestamp, _run string"


def test_copies_field_by_field(spark):
    from datetime import datetime as t

    nan = float("nan")
    rows = [
        (5, "raw/A_1.mzML", "scan=007", 10.0, nan, 1, t(2024, 1, 1), "x"),
        (6, " a-1 ", "7", -1.0, 0.5, None, t(2024, 1, 3), "x"),
        (7, "A_1", "controllerType=0 controllerNumber=1 scan=7", 12.0, 2.0, 9, t(2024, 1, 2), "x"),
        (8, "a_1", "scan=8", 1.0, 0.1, 1, t(2024, 1, 2), "x"),
        (9, None, "scan=7", 1.0, 0.1, 1, t(2024, 1, 2), "x"),
        (10, "a_1", "none", 1.0, 0.1, 1, t(2024, 1, 2), "x"),
        (20, "b", "1", 3.0, 0.2, 0, t(2024, 1, 1), "x"),
        (21, "b", "1", 3.0, 0.3, 0, t(2024, 1, 1), "x"),
        (22, "b", "1", 3.0, None, 0, None, "x"),
        (30, "c", "1", None, None, None, None, None),
        (31, "c", "1", 0.0, 1.5, 7, None, None),
    ]
    d = spark.createDataFrame(rows, MS2)
    got = {tuple(r) for r in survivors.spectrum_survivors(d).select("dup_id", "field", "map_id").collect()}
    assert got == {(5, "tic", 7), (5, "precursor_purity", 6), (5, "representative", 5), (20, "tic", 21), (20, "precursor_purity", 21), (20, "representative", 21)}
    assert survivors.spectrum_survivors(d.limit(0)).count() == 0


def test_hot_copy_set_equals_its_rule(spark):
    d = spark.range(4000).select(F.col("id").alias("map_id"), F.lit("a").alias("file"), F.lit("1").alias("scan"), (F.pmod("id", F.lit(13)) - 3).cast("double").alias("tic"), F.lit(None).cast("double").alias("precursor_purity"), F.lit(0).alias("representative"), F.timestamp_seconds(F.pmod(F.col("id") * 37, F.lit(500))).alias("loaded_at"))
    got = {r.field: r.map_id for r in survivors.spectrum_survivors(d).collect()}
    best = max((i * 37 % 500, i) for i in range(4000) if i % 13 > 3)
    assert got == {"tic": best[1], "representative": max((i * 37 % 500, i) for i in range(4000))[1]}


def test_consensus_votes_tokens():
    assert survivors.consensus(["12.5", "12.5"]) == 0
    assert survivors.consensus(["10", "99", "99", "99"]) == 0
    # with equal trust the others outvote the newest, token by token
    assert survivors.consensus(["10", "99", "99", "99"], [1.0] * 4) == 1
    assert survivors.consensus(["12.9", "12.5", "13.5"], [1.0] * 3) == 1
    assert survivors.consensus(["red car old", "blue car", "blue bus", "blue car new", "blue car"], [1.0] * 5) == 1
    assert survivors.consensus([""]) == 0 and survivors.consensus(["a" * 500, "b"]) == 0


def test_votes_beat_the_newest_copy(spark):
    from datetime import datetime as t

    rows = [(k, "a", "1", v, None, None, t(2024, 1, k)) for k, v in enumerate((410.25, 410.25, 418.25, 910.25), 1)]
    rows += [(10, "b", "1", 7.5, None, None, None), (11, "b", "1", 7.5, None, None, None), (12, "b", "1", 8.5, None, None, t(2024, 1, 1))]
    d = spark.createDataFrame(rows, "map_id bigint, file string, scan string, tic double, precursor_purity double, representative int, loaded_at timestamp").withColumn("w", F.when(F.col("map_id") == 12, 5).otherwise(1)).withColumn("value", F.lit(1))
    pick = lambda trust: {r.dup_id: (r.map_id, r.value) for r in survivors.spectrum_survivors(d, trust).collect()}
    assert pick("recent") == {1: (4, "910.25"), 10: (12, "8.5")}
    assert pick("equal") == {1: (2, "410.25"), 10: (11, "7.5")}
    assert pick(F.col("w")) == {1: (2, "410.25"), 10: (12, "8.5")}


def test_every_stage_of_survivors_counts(spark, monkeypatch):
    r = random.Random(4)
    rows = [(k, r.choice("aab"), str(r.randint(1, 9) if k % 2 else 1), r.choice((-1.0, 410.25, 418.25, 910.25)), r.choice((None, 0.5, float("nan"))), r.choice((None, 0, 1, 9)), r.choice((None, *range(40)))) for k in r.sample(range(3000), 900)]
    d = spark.createDataFrame(rows, "map_id bigint, file string, scan string, tic double, precursor_purity double, representative int, at int").withColumn("loaded_at", F.timestamp_seconds("at"))
    best, copies = {}, {}
    for k, file, scan, tic, purity, rep, at in rows:
        copies.setdefault((file, scan), []).append(k)
        for f, v in (("tic", tic if tic > 0 else None), ("precursor_purity", purity if purity == 0.5 else None), ("representative", rep if rep in (0, 1) else None)):
            if v is not None:
                best[file, scan, f] = max(best.get((file, scan, f), (-2, -1, None)), (-1 if at is None else at, k, str(v)))
    want = {(min(copies[file, scan]), f, *b[1:]) for (file, scan, f), b in best.items() if len(copies[file, scan]) > 1}
    rows_of = lambda trust: {tuple(x) for x in survivors.spectrum_survivors(d, trust).select("dup_id", "field", "map_id", "value").collect()}
    equal = rows_of("equal")
    # the vote decides where it is asked, and is not asked where the newest copy gives the value
    monkeypatch.setattr(survivors, "_winner", lambda values, weights: F.size(values) - 1)
    assert rows_of("equal") != equal
    monkeypatch.setattr(survivors, "_winner", None)
    assert rows_of("recent") == want and max(map(len, copies.values())) > 100


def test_a_group_of_many_values_is_voted_whole(spark, monkeypatch):
    r = random.Random(8)
    right = "1234567.25"
    wrong = lambda: "".join(r.choice("0123456789") if c.isdigit() and r.random() < 0.25 else c for c in right)
    values = [right] + [wrong() for _ in range(700)]
    rows = [(k, "a" if k % 9 else "b", "1", float(v)) for k, v in enumerate(values)] + [(k, "c", "1", 5.0) for k in (9000, 9001)]
    d = spark.createDataFrame(rows, "map_id bigint, file string, scan string, tic double").select("*", F.lit(None).cast("double").alias("precursor_purity"), F.lit(None).cast("int").alias("representative"), F.timestamp_seconds("map_id").alias("loaded_at"))
    monkeypatch.setattr(survivors, "CHUNK", 8)
    monkeypatch.setattr(survivors, "FAN", 3)
    got = {x.dup_id: x.value for x in survivors.spectrum_survivors(d, "equal").filter("field = 'tic'").collect()}
    assert set(got) == {0, 1, 9000} and sum(a != b for a, b in zip(f"{float(got[0]):.2f}", right)) <= 1, got
    near = sum(a != b for a, b in zip(f"{float(got[1]):.2f}", right))
    assert near <= 1


def _brute_nearest(spectra, features):
    out = {}
    for m, study, p, t in spectra:
        if p is None or t is None or p != p:
            continue
        c = [(abs(t - (lo + hi) / 2), g) for g, s, mz, lo, hi in features if s == study and None not in (s, mz, lo, hi) and abs(p - mz) <= p * 10 / 1e6 and lo - 0.05 <= t <= hi + 0.05]
        if c:
            out[m] = min(c)[1]
    return out


@pytest.mark.parametrize("bound", [0, 10**6])
def test_nearest_equals_brute_force(spark, monkeypatch, bound):
    import lcspark.session as session

    monkeypatch.setattr(nearest, "small", lambda d: session.small(d, bound))
    r = random.Random(4)
    features = [(g, "s" if r.random() < 0.8 else "t", 300 * (1 + r.randrange(12) * 4e-6), (a := r.uniform(0, 6)), a + r.choice([0.05, 0.3, 2.5])) for g in range(150)]
    features += [(900, "s", None, 1.0, 2.0), (901, "s", 300.0, None, 2.0), (902, "s", 300.0, 2.0, 2.0), (903, "s", 300.0, 2.0, 2.0), (904, None, 300.0, 1.0, 2.0)]
    spectra = [(i, r.choice("st"), 300 * (1 + r.uniform(-2e-5, 6e-5)), r.uniform(-1, 8)) for i in range(400)]
    spectra += [(1000, "s", 300.0, 2.0), (1000, "s", 300.0, 2.0), (1001, None, 300.0, 2.0), (1002, "s", float("nan"), 2.0), (1003, "s", 300.0, None)]
    a = spark.createDataFrame(spectra, "map_id bigint, study string, precursor_mz double, t double").withColumn("best", F.lit(1)).withColumn("_t", F.lit(1))
    b = spark.createDataFrame(features, "group_id bigint, study string, mz double, rt_min double, rt_max double").withColumn("t", F.lit(1)).withColumn("map_id", F.lit(1))
    got = nearest.nearest_feature(a, b).collect()
    assert {x.map_id: x.group_id for x in got} == _brute_nearest(spectra, features) and len(got) == len({x.map_id for x in got})
    assert nearest.nearest_feature(a.limit(0), b).count() == 0 and nearest.nearest_feature(a, b.limit(0)).count() == 0


def test_loser_tree_merges():
    r = random.Random(1)
    for runs in (0, 1, 2, 3, 7, 16):
        lists = [sorted(r.randrange(50) for _ in range(r.randrange(9))) for _ in range(runs)]
        at = [0] * runs
        tree = topn.LoserTree([x[0] if x else None for x in lists])
        out = []
        while (k := tree.keys[tree.top]) is not None:
            out.append(k)
            at[tree.top] += 1
            i = tree.top
            tree.replace(lists[i][at[i]] if at[i] < len(lists[i]) else None)
        assert out == sorted(x for y in lists for x in y)


def test_top_hits_equal_sql(spark):
    r = random.Random(2)
    rows = []
    for h in range(6000):
        hot = r.random() < 0.4
        rows.append((h, 7 if hot else r.choice([None, *range(40)]), r.choice(["a", "b", None]) if not hot else "a", r.choice([None, float("nan"), *[x / 10 for x in range(8)]]), r.choice([None, 1, 2, 3]), r.choice([None, *range(300)])))
    rows += rows[:50]
    rows += [(None, 3, "a", 0.7, 2, 5), (None, 3, "a", 0.9, None, 400), (7000, 3, "", 0.5, 1, 1), (7001, 3, None, float("inf"), 1, 1), (7002, 4, "a", float("-inf"), -5, None)]
    d = spark.createDataFrame(rows, "hit_id bigint, group_id bigint, spectrum string, score double, n_matched int, library_index bigint").withColumn("bucket", F.lit(1)).withColumn("run", F.lit("x"))
    t = pd.DataFrame(rows, columns=["hit_id", "group_id", "spectrum", "score", "n_matched", "library_index"]).astype({"hit_id": "Int64", "group_id": "Int64", "n_matched": "Int64", "library_index": "Int64"})  # noqa: F841
    t["ok"] = [x is not None and x == x for x in (r[3] for r in rows)]
    for n in (1, 3, 10):
        want = duckdb.sql(f"with d as (select * from t where ok and group_id is not null qualify row_number() over (partition by group_id, spectrum, library_index order by hit_id) = 1) select group_id, spectrum, row_number() over w as rank, hit_id from d window w as (partition by group_id, spectrum order by score desc, n_matched desc nulls last, library_index nulls last, hit_id) qualify row_number() over w <= {n}").fetchall()
        got = topn.top_hits(d, n).select("group_id", "spectrum", "rank", "hit_id").collect()
        key = lambda r: tuple((x is None, x) for x in r)
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert topn.top_hits(d.limit(0)).count() == 0


def test_counts_equal_encoding():
    path = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    count, enc = TokenCounter(path), _encoding(path)
    for t in ("", None, "Hello  world\n\n  x’s 1234 naïve 漢字 😀", "a" * 5000, "§1 Grundstück, 12 345 Kr.\t\n" * 50):
        assert count(t) == (len(enc.encode_ordinary(t)) if t else 0)


def test_mix_reaches_its_shares(spark):
    r = random.Random(5)
    rows = [(i, r.choice(["a word or two here "] * 3 + [""]) * r.randrange(0, 9), r.choice(["Big", "big ", "BIG"])) for i in range(3000)]
    rows += [(5000 + i, "some few words " * 4, r.choice(["Small_x", "small x", " SMALL X"])) for i in range(60)] + [(9000, "lost words", None), (9001, None, "big")]
    docs = mix.sized(spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("key", F.lit("z")).withColumn("h", F.lit(1)))
    targets = spark.createDataFrame([("big", 0.6, 1), ("small_x", 0.15, 4), ("empty", 0.2, 3), ("small_x2", 0.05, 1)], "source string, target_share double, max_repeats int").withColumn("available", F.lit(0))
    limits = mix.thresholds(docs, mix.budgets(docs, targets))
    mixed = mix.mix(docs, limits)
    tokens = {x.doc_id: x.n_tokens for x in docs.collect()}
    total = sum(tokens.values())
    by = {x.source: x for x in mix.report(limits, mixed).collect()}
    assert by["empty"].taken == 0 and by["empty"].short and not by["big"].short
    assert 0 <= 0.6 * total - by["big"].taken <= max(tokens.values())
    small = sum(n for i, n in tokens.items() if 5000 <= i < 6000)
    assert by["small_x"].available == small and by["small_x"].most_copies <= 4
    want = min(0.15 * total, 4 * small)
    assert 0 <= want - by["small_x"].taken <= max(tokens.values())
    assert sum(x.copies * x.n_tokens for x in mixed.collect()) == sum(x.taken for x in by.values())
    # a threshold is a hash: what lies below it is taken once more, and nothing else
    below = {x.source: (x.passes, x.below) for x in limits.collect()}
    copies = {x.doc_id: x.copies for x in mixed.collect() if x.doc_id is not None}
    for x in docs.filter("doc_id is not null and key in ('big', 'small_x')").collect():
        passes, edge = below[x.key]
        assert copies.get(x.doc_id, 0) == passes + (x.h < edge)
    lost = mix.sized(spark.createDataFrame([(None, f"text {k}", "a") for k in range(50)], "doc_id bigint, text string, source string"))
    assert lost.select("h").distinct().count() == 50
    none = mix.sized(spark.createDataFrame([], "doc_id bigint, text string, source string"))
    assert mix.budgets(none, targets).filter("reachable < wanted").count() == 0 and mix.mix(none, mix.thresholds(none, mix.budgets(none, targets))).count() == 0
