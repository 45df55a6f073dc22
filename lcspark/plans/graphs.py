"""Queries on graphs of features, ion correlations and warps, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lcspark.operators import compounds as c
from lcspark.operators.features import coeluting, isomer_candidates, proven_pairs, shared_positions
from lcspark.operators.halogen import judged, patterns
from lcspark.operators.stats import ion_pairs
from lcspark.operators.traces import by_run, run_key, valid_points
from lcspark.plans.features import COELUTE, PAIRS, seen
from lcspark.plans.shape import DENSE, dense
from lcspark.session import materialise, small
from lcspark.sources.tables import read


def _features(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "aligned_feature_table")


def _stars(spark: SparkSession, d: str) -> DataFrame:
    f = _features(spark, d)
    return c.star_clusters(f.select(F.col("group_id").alias("id"), F.col("n_detected").alias("weight")), coeluting(f))


def q_stars(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of co-eluting features around the one detected most."""
    return _stars(spark, d).select(F.col("id").alias("group_id"), F.col("center").alias("center_id"))


def q_roles(spark: SparkSession, d: str) -> DataFrame:
    """Ions of the clusters under their neutral mass, by the polarity of the study's runs."""
    f = _features(spark, d).select(F.col("group_id").alias("id"), "study", "mz", F.col("n_detected").cast("double").alias("weight"))
    m = materialise(_stars(spark, d).join(f, "id").join(small(c.study_polarity(read(spark, d, "scans"))), "study", "left"))
    both = [c.roles(m.filter(F.coalesce("polarity", F.lit("pos")) == p).drop("study", "polarity"), polarity=p) for p in ("pos", "neg")]
    return both[0].unionByName(both[1]).select(F.col("id").alias("group_id"), F.col("center").alias("center_id"), "role", F.round("neutral_mass", 6).alias("neutral_mass"))


def q_components(spark: SparkSession, d: str) -> DataFrame:
    """Chains of isomer candidates."""
    return c.components(isomer_candidates(_features(spark, d)).select("a", "b")).select(F.col("id").alias("group_id"), "component")


def q_territories(spark: SparkSession, d: str) -> DataFrame:
    t = c.territories(isomer_candidates(_features(spark, d)).select("a", "b"), _features(spark, d).select(F.col("group_id").alias("id"), "rt"))
    return t.select(F.col("id").alias("group_id"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def _proven(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = seen(spark, d)
    return materialise(proven_pairs(_features(spark, d), s).select("a", "b")), s


def q_components_whole(spark: SparkSession, d: str) -> DataFrame:
    """Chains of proven pairs."""
    return c.components(_proven(spark, d)[0]).select(F.col("id").alias("group_id"), "component")


def q_territories_whole(spark: SparkSession, d: str) -> DataFrame:
    """Territories of proven pairs, from the positions in the runs that hold a partner too."""
    p, s = _proven(spark, d)
    return c.territories(p, shared_positions(p, s)).select(F.col("id").alias("group_id"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def q_int_corr(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of log intensities, and stability of the ratio, of each pair of a run's steady m/z bins over the scans they share."""
    p = valid_points(read(spark, d, "points")).select("run", "scan", F.floor(F.log("mz") / 1e-4).alias("bin"), "inten")
    e = p.groupBy("run", "bin", "scan").agg(F.max("inten").alias("i"))
    steady = e.groupBy("run", "bin").agg(F.count("*").alias("n")).filter("n >= 100").select("run", "bin")
    e = e.join(F.broadcast(steady) if steady.limit(100_001).count() <= 100_000 else steady, ["run", "bin"]).withColumn("i", F.log10("i"))
    b = e.select("run", "scan", F.col("bin").alias("bin_b"), F.col("i").alias("i_b"))
    j = e.withColumnRenamed("bin", "bin_a").join(b, ["run", "scan"]).filter("bin_a < bin_b").withColumn("r", F.col("i") - F.col("i_b"))
    g = j.groupBy("run", "bin_a", "bin_b").agg(F.count("*").alias("n"), F.try_divide(F.covar_pop("i", "i_b"), F.stddev_pop("i") * F.stddev_pop("i_b")).alias("corr"), F.stddev_pop("r").alias("sd_ratio"))
    return g.filter("n >= 6").select("run", "bin_a", "bin_b", "n", F.round("corr", 6).alias("corr"), F.round("sd_ratio", 6).alias("sd_ratio"))


def q_int_corr_whole(spark: SparkSession, d: str) -> DataFrame:
    """Zero-masked Pearson, correlation of logs and stability of the ratio of all pairs of a run's m/z bins that share three scans."""
    p = valid_points(read(spark, d, "points")).select("run", "scan", F.floor(F.log("mz") / 1e-4).alias("bin"), "inten")
    g = ion_pairs(materialise(p.groupBy("run", "bin", "scan").agg(F.max("inten").alias("i"))))
    return g.select("run", "bin_a", "bin_b", "n", *[F.round(x, 6).alias(x) for x in ("pearson", "corr", "stability")])


def _anchors(spark: SparkSession, d: str, run: Column) -> DataFrame:
    return read(spark, d, "ms2_map").select(run.alias("file"), F.col("map_id").alias("id"), F.col("rt_s").alias("native"), F.col("rt_aligned_s").alias("corr"))


def _knots(spark: SparkSession, d: str, run: Column) -> DataFrame:
    return c.warp_knots(_anchors(spark, d, run)).select("file", "knot", F.round("rt_native", 6).alias("rt_native"), F.round("rt_corr", 6).alias("rt_corr"))


def q_warp_knots(spark: SparkSession, d: str) -> DataFrame:
    """A warp for each file as it is written."""
    return _knots(spark, d, F.col("file"))


def q_warp_knots_whole(spark: SparkSession, d: str) -> DataFrame:
    """One warp for all spellings of a run."""
    return _knots(spark, d, run_key(F.col("file")))


def _warped(spark: SparkSession, d: str, run: Column) -> DataFrame:
    a = _anchors(spark, d, run)
    return c.warp_apply(a.select("file", "id", "native").filter("native is not null"), c.warp_knots(a)).select(F.col("id").alias("map_id"), F.round("corr", 6).alias("rt_corr"))


def q_warp_apply(spark: SparkSession, d: str) -> DataFrame:
    """Every spectrum's time under its file's warp, files as they are written."""
    return _warped(spark, d, F.col("file"))


def q_warp_apply_whole(spark: SparkSession, d: str) -> DataFrame:
    """Every spectrum's time under its run's warp."""
    return _warped(spark, d, run_key(F.col("file")))


def _patterns(spark: SparkSession, d: str) -> DataFrame:
    return patterns(dense(spark, d).select("run", "group_id", "scan", "mz", "inten"), valid_points(read(spark, d, "points")))


def q_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Isotope ratios of the ions that a run shows nearly throughout."""
    return _patterns(spark, d).select("run", "group_id", "n_scans", F.round("mz", 6).alias("mz"), *[F.round(f"r{k}", 6).alias(f"r{k}") for k in range(1, 5)])


def q_halogen(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts on those ions."""
    return judged(_patterns(spark, d), ["run", "group_id"]).select("run", "group_id", "verdict", "pattern", "n_ratios")


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}

CHAINS = PAIRS.replace("with p as", "with recursive p as") + ", e as (select a, b from p union select b, a from p), walk as (select a as id, a as seen from e union select w.id, e.b from walk w join e on w.seen = e.a), comp as (select id, min(seen) as component from walk group by id)"
KNOTS = """with a as (select file, rt_s, rt_aligned_s, cast(ntile(20) over (partition by file order by rt_s, map_id) as integer) as knot from ms2_map where file is not null and rt_s is not null and rt_aligned_s is not null),
g as (select file, knot, median(rt_s) as n, median(rt_aligned_s) as c from a group by file, knot), k as (select * from g window w as (partition by file order by knot rows between unbounded preceding and 1 preceding) qualify coalesce(n > max(n) over w and c > max(c) over w, true))"""
#: Greedy stars: nodes in order of weight; one with no earlier center beside it is a center, any other belongs to the first center beside it.
STARS = COELUTE.replace("with p as", "with recursive p as") + """, n as (select group_id as id, n_detected as w, row_number() over (order by n_detected desc nulls last, group_id) as k from aligned_feature_table), ed as (select a as x, b as y from p union select b, a from p),
nb as (select n.k, coalesce(list(m.k) filter (m.k < n.k), []) as l from n left join ed on ed.x = n.id left join n m on m.id = ed.y group by n.k),
st as (select 0::bigint as k, []::bigint[] as c union all select nb.k, case when list_has_any(st.c, nb.l) then st.c else list_append(st.c, nb.k) end from st join nb on nb.k = st.k + 1),
ce as (select unnest(c) as k from (select c from st order by k desc limit 1)), star as (select n.id, coalesce((select min(m.k) from ed join n m on m.id = ed.y join ce on ce.k = m.k where ed.x = n.id and m.k < n.k), n.k) as ck from n)"""
PATTERNS = DENSE + """, tp as (select run, group_id, max(inten) as h from dn where inten > 0 group by 1, 2), co as (select dn.run, dn.group_id, dn.scan, dn.mz, dn.inten from dn join tp on dn.run = tp.run and dn.group_id = tp.group_id where dn.inten >= 0.5 * tp.h),
ba as (select run, group_id, count(*) as n_scans, sum(inten) as s, sum(mz * inten) / sum(inten) as mz from co group by 1, 2),
hk as (select co.run, co.group_id, co.scan, k, max(v.inten) as i from co, unnest([1, 2, 3, 4]) t(k) join v on v.run = co.run and v.scan = co.scan and abs(v.mz - (co.mz + k * case when k % 2 = 0 then 1.0011::double else 1.0033548378::double end)) <= co.mz * 10 / 1e6 + case when k % 2 = 0 then k * 0.0023::double else 0 end group by 1, 2, 3, 4),
sk as (select run, group_id, sum(i) filter (k = 1) as s1, sum(i) filter (k = 2) as s2, sum(i) filter (k = 3) as s3, sum(i) filter (k = 4) as s4 from hk group by 1, 2)"""
ORACLES = {
    "q_stars": STARS + " select star.id as group_id, n.id as center_id from star join n on n.k = star.ck",
    "q_patterns": PATTERNS + " select ba.run, ba.group_id, n_scans, round(mz, 6) as mz, round(s1 / s, 6) as r1, round(s2 / s, 6) as r2, round(s3 / s, 6) as r3, round(s4 / s, 6) as r4 from ba left join sk on ba.run = sk.run and ba.group_id = sk.group_id",
    "q_components": CHAINS + " select id as group_id, component from comp",
    "q_territories": CHAINS + " select id as group_id, round((lag(rt) over w + rt) / 2, 6) as lo, round((lead(rt) over w + rt) / 2, 6) as hi from comp join aligned_feature_table f on comp.id = f.group_id window w as (partition by component order by rt, id)",
    "q_int_corr": """with v as (select run, scan, cast(floor(ln(mz) / 1e-4::double) as bigint) as bin, max(cast(inten as double)) as i from points where inten > 0 and isfinite(inten) and mz > 0 and isfinite(mz) group by 1, 2, 3),
s as (select run, bin from v group by 1, 2 having count(*) >= 100), e as (select v.run, v.scan, v.bin, log10(v.i) as i from v join s on v.run = s.run and v.bin = s.bin)
select a.run, a.bin as bin_a, b.bin as bin_b, count(*) as n, round(covar_pop(a.i, b.i) / nullif(stddev_pop(a.i) * stddev_pop(b.i), 0), 6) as corr, round(stddev_pop(a.i - b.i), 6) as sd_ratio from e a join e b on a.run = b.run and a.scan = b.scan and a.bin < b.bin group by 1, 2, 3 having count(*) >= 6""",
    "q_warp_knots": KNOTS + " select file, knot, round(n, 6) as rt_native, round(c, 6) as rt_corr from k",
    "q_warp_apply": KNOTS + """, s as (select file, n, c, lead(n) over w as n2, lead(c) over w as c2, first_value(n) over w as n0, first_value(c) over w as c0 from k window w as (partition by file order by n)),
f as (select file, any_value(n0) as n0, any_value(c0) as c0 from s group by file)
select m.map_id, round(case when s.n2 is not null then s.c + (m.rt_s - s.n) * (s.c2 - s.c) / (s.n2 - s.n) when s.n is not null then m.rt_s + s.c - s.n when f.n0 is not null then m.rt_s + f.c0 - f.n0 else m.rt_s end, 6) as rt_corr
from ms2_map m asof left join s on m.file = s.file and m.rt_s >= s.n left join f on m.file = f.file where m.rt_s is not null""",
}
ORACLES |= {f"{k}_whole": by_run(ORACLES[k]) for k in ("q_warp_knots", "q_warp_apply")}
