"""Text tables, split libraries, and runs that arrive in batches."""

import json

import pytest
from pyspark.sql import functions as F

from lcspark.operators.stats import spread_rank
from lcspark.sources import msp, tsv
from lcspark.streaming import events, ingest

MSP = """NAME: one
PRECURSORMZ: 200.5
Num Peaks: 2
50.1 10
60.2 20

NAME: ms1 record
SPECTRUMTYPE: MS1
Num Peaks: 1
50 1

Name: two
precursor m/z: 300.25
IONMODE: Negative
Num Peaks: 1
70.5 3

NAME: no peaks
Num Peaks: 0
"""


def test_split_libraries_count_what_they_leave_out(spark, tmp_path):
    (tmp_path / "a.msp").write_text(MSP)
    (tmp_path / "only.msp").write_text("NAME: x\nNum Peaks: 0\n\nNAME: y\nSPECTRUMTYPE: MS1\nNum Peaks: 1\n5 1\n")
    (tmp_path / "long.msp").write_text("\n\n".join(f"NAME: r{k}\nPRECURSORMZ: {100 + k}\nNum Peaks: 1\n{50 + k} 1" for k in range(400)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        d, counts = msp.read_msp_split(spark, str(tmp_path))
        got = {(r.lib, r.rec): (r.name, r.precursor_mz, r.mode, len(r.peaks)) for r in d.collect()}
        assert d.rdd.getNumPartitions() >= 1 and {r.lib: (r.n_loaded, r.n_skipped) for r in counts.collect()} == {"a": (2, 2), "only": (0, 2), "long": (400, 0)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got["a", 0] == ("one", 200.5, 0, 2) and got["a", 1] == ("two", 300.25, 2, 1)
    assert [got["long", k][0] for k in range(400)] == [f"r{k}" for k in range(400)]
    assert msp.read_library(spark, str(tmp_path / "a.msp")).count() == 2


def test_feature_text_comes_back(spark, tmp_path):
    d = spark.createDataFrame([(1, 300.1234567, 2.5, None, ["a", "b"]), (2, None, float("nan"), 7.0, [])], "group_id bigint, mz double, rt double, height double, files array<string>")
    tsv.write_features(d, str(tmp_path / "f"))
    back = tsv.read_features(spark, str(tmp_path / "f"), "group_id bigint, mz double, rt double, height double, files string").orderBy("group_id").collect()
    assert [tuple(r)[:4] for r in back] == [(1, 300.123457, 2.5, None), (2, None, None, 7.0)] and back[0].files == "a;b" and not back[1].files
    p = spark.createDataFrame([("r", 0.01, 3)], "run string, dt double, min_scans int")
    tsv.write_parameters(p, str(tmp_path / "p"))
    assert [tuple(r) for r in tsv.read_parameters(spark, str(tmp_path / "p"), "run string, dt double, min_scans int").collect()] == [("r", 0.01, 3)]
    (line,) = [x.value for x in spark.read.text(str(tmp_path / "p")).collect()]
    assert json.loads(line)["min_scans"] == 3


def test_other_pickers_tables(spark, tmp_path):
    (tmp_path / "run1.txt").write_text("ID\tM/Z\tRetention Time\tPeak height\n1\t300.5\t120\t9e4\n2\tbad\t10\t1\n3\t400\t600\t\n")
    (got, last) = tsv.import_features(spark, str(tmp_path / "run1.txt")).orderBy("mz").collect()
    assert (got.file, got.mz, got.rt, got.height, got.area) == ("run1", 300.5, 2.0, 9e4, None) and last.height is None
    assert tsv.import_features(spark, str(tmp_path / "run1.txt"), seconds=False).agg(F.max("rt")).first()[0] == 600
    (tmp_path / "none.txt").write_text("a\tb\n1\t2\n")
    with pytest.raises(ValueError):
        tsv.import_features(spark, str(tmp_path / "none.txt"))


def test_compound_list(spark):
    r = spark.createDataFrame([(1, 1, "[M+H]+", 299.1), (2, 1, "[M+Na]+", 299.1), (3, 3, "base", None)], "id bigint, center bigint, role string, neutral_mass double")
    f = spark.createDataFrame([(1, 300.1, 2.0), (2, 322.1, 2.02), (3, 500.0, 9.0)], "group_id bigint, mz double, rt double")
    got = {x.compound: x for x in tsv.compound_list(r, f).collect()}
    assert got[1].ions == "300.1000 [M+H]+;322.1000 [M+Na]+" and got[1].n_ions == 2 and got[1].base_mz == 300.1 and got[3].neutral_mass is None


def test_runs_arrive_once(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    schema = "run string, scan int, value double"
    for k in range(2):
        spark.createDataFrame([(f"r{k}", s, float(s)) for s in range(5)], schema).coalesce(1).write.mode("append").parquet(str(src))
        s = spark.readStream.schema(schema).parquet(str(src))
        ingest.ingest(s, lambda b: b.groupBy("run").agg(F.count("*").alias("n")), str(out), str(tmp_path / "cp")).awaitTermination()
    assert {(r.run, r.n) for r in spark.read.parquet(str(out)).collect()} == {("r0", 5), ("r1", 5)}


def test_stuck_readings_over_batches(spark, tmp_path):
    schema = "run string, channel string, scan int, value double"
    values = [5.0, 6.0] + [7.0] * 12 + [8.0] + [9.0] * 4 + [1.0]
    rows = [("r", "c", k, v) for k, v in enumerate(values)] + [("r", "d", k, float(k)) for k in range(20)]
    src = tmp_path / "in"
    for a, b in ((0, 9), (9, 30)):
        spark.createDataFrame([x for x in rows if a <= x[2] < b], schema).coalesce(1).write.mode("append").parquet(str(src))
        s = spark.readStream.schema(schema).parquet(str(src))
        name = f"stuck{a}"
        events.run_to_table(ingest.stuck_readings(s), name, checkpoint=str(tmp_path / "cp")) if a == 0 else None
        if a:
            q = ingest.stuck_readings(s).writeStream.foreachBatch(lambda d, n: d.write.mode("append").parquet(str(tmp_path / "found"))).outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
            q.awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "found")).collect()]
    assert got == [("r", "c", 2, 13, 12, 7.0)]


def test_ranks_of_steps_equal_plain_ranks(spark):
    import random

    from pyspark.sql import Window

    r = random.Random(1)
    rows = [(k, r.choice(["a", None]), r.choice([0.1, 0.12, 0.5, float("inf"), float("-inf"), -2.0, r.random()]), r.choice([1, 2, None])) for k in range(500)]
    d = spark.createDataFrame(rows, "id int, g string, s double, t int")
    want = {x.id: x.k for x in d.withColumn("k", F.row_number().over(Window.partitionBy("g").orderBy(F.col("s").desc(), F.col("t").asc_nulls_last(), "id"))).collect()}
    assert {x.id: x.rank for x in spread_rank(d, ["g"], "s", [F.col("t").asc_nulls_last(), F.col("id")], 0.05).collect()} == want
