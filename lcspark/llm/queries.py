"""Queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lcspark.llm import mix as m
from lcspark.llm.leak import leaked
from lcspark.llm.pii import pseudonymised, redacted
from lcspark.llm.nearest import nearest_feature, unassigned_spectra
from lcspark.llm.survivors import spectrum_survivors
from lcspark.llm.topn import top_hits
from lcspark.sources.tables import read


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return spectrum_survivors(read(spark, d, "ms2_map")).select("dup_id", "field", "map_id")


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    """One record for each set of copies, built field by field."""
    s = spectrum_survivors(read(spark, d, "ms2_map"))
    value = lambda f: F.max(F.when(F.col("field") == f, F.col("value")))
    return s.groupBy("dup_id").agg(value("tic").cast("double").alias("tic"), value("precursor_purity").cast("double").alias("precursor_purity"), value("representative").cast("int").alias("representative"))


def p1_consensus(spark: SparkSession, d: str) -> DataFrame:
    """The values that most copies agree on, token by token, every copy counting one."""
    return spectrum_survivors(read(spark, d, "ms2_map"), "equal").select("dup_id", "field", "map_id", "value")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return nearest_feature(unassigned_spectra(read(spark, d, "ms2_map")), read(spark, d, "aligned_feature_table")).select("map_id", "group_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return top_hits(read(spark, d, "identifications")).select("group_id", "spectrum", "hit_id")


def p7_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The best ten hits of each spectrum copy with ``rank`` written anew."""
    return top_hits(read(spark, d, "identifications"), 10)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked(read(spark, d, "documents"), read(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """The leaked items: in how many documents they stand, and the closest of them."""
    return leaked(read(spark, d, "documents"), read(spark, d, "eval_items")).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("share").alias("best_share"))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = m.sized(read(spark, d, "documents"))
    limits = m.thresholds(docs, m.budgets(docs, read(spark, d, "mix_targets")))
    return limits, m.mix(docs, limits)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """The sources that the report of the finished mix calls short."""
    return m.report(*_mix(spark, d)).filter("short").select("source")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mix and how often each is taken."""
    return _mix(spark, d)[1]


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return m.report(*_mix(spark, d))


def _key(spark: SparkSession) -> str:
    """The secret of the surrogates, a setting of the session; without one (tests) a fixed word."""
    return spark.conf.get("spark.lcspark.pii.key", "unset")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pseudonymised(read(spark, d, "documents"), _key(spark)).select("doc_id", "kind", "start_pos").distinct()


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every text with typed placeholders in place of its personal data."""
    return redacted(read(spark, d, "documents"), _key(spark))


QUERIES = {f.__name__: f for f in (p1_found, p1_records, p1_consensus, p2_found, p7_found, p7_ranked, p8_found, p8_items, p9_found, p9_mix, p9_report, p10_found, p10_redacted)}

_COPIES = r"""
with k as (select map_id, loaded_at, tic, precursor_purity, representative,
  regexp_replace(regexp_replace(trim(regexp_replace(lower(trim(file)), '^.*[/\\]', '')), '\.mzml$', ''), '[-\s]+', '_', 'g') as run,
  cast(nullif(regexp_extract(scan, '([0-9]{1,18})\s*$', 1), '') as bigint) as n from ms2_map),
g as (select run, n, min(map_id) as dup_id from k where run is not null and n is not null group by run, n having count(*) > 1),
v as (select g.dup_id, f.field, k.map_id, k.loaded_at, f.value from k join g on k.run = g.run and k.n = g.n,
  lateral (select 'tic' as field, case when k.tic > 0 and isfinite(k.tic) then k.tic end as value
    union all select 'precursor_purity', case when k.precursor_purity between 0 and 1 and isfinite(k.precursor_purity) then k.precursor_purity end
    union all select 'representative', case when k.representative in (0, 1) then cast(k.representative as double) end) f where f.value is not null),
best as (select * from v qualify row_number() over (partition by dup_id, field order by loaded_at desc nulls last, map_id desc) = 1)
"""


def _top(n: int) -> str:
    return f"""
with d as (select * from identifications where group_id is not null and score is not null and not isnan(score)
  qualify row_number() over (partition by group_id, spectrum, library_index order by hit_id) = 1),
r as (select *, cast(row_number() over (partition by group_id, spectrum order by score desc, n_matched desc nulls last, library_index nulls last, hit_id) as integer) as place from d),
top as (select group_id, spectrum, place as rank, hit_id, score, n_matched, library_index from r where place <= {n})
"""


ORACLES = {
    "p1_found": _COPIES + "select dup_id, field, map_id from best",
    "p1_records": _COPIES + "select dup_id, max(value) filter (field = 'tic') as tic, max(value) filter (field = 'precursor_purity') as precursor_purity, cast(max(value) filter (field = 'representative') as integer) as representative from best group by dup_id",
    "p2_found": """
select map_id, group_id from (select m.map_id, f.group_id, row_number() over (partition by m.map_id order by abs(m.rt_s / 60 - (f.rt_min + f.rt_max) / 2), f.group_id) as k
  from ms2_map m join aligned_feature_table f on m.study = f.study and abs(m.precursor_mz - f.mz) <= m.precursor_mz * 10 / 1e6 and m.rt_s / 60 between f.rt_min - 0.05::double and f.rt_max + 0.05::double
  where m.group_id is null) where k = 1""",
    "p7_found": _top(3) + "select group_id, spectrum, hit_id from top",
    "p7_ranked": _top(10) + "select * from top",
}
