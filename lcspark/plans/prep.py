"""Queries of the data-preparation operators of the core, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lcspark.operators.impute import fill_block_groups, fill_features, fill_widths
from lcspark.operators.regrid import regrid, scan_readings
from lcspark.operators.rowparse import load_library_lines
from lcspark.operators.spikes import flag_readings, impossible
from lcspark.session import materialise
from lcspark.sources.tables import read

GRID_MINUTES = 0.05


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return load_library_lines(read(spark, d, "library_raw")).filter("reason is not null").select("line_id", "reason")


def p3_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The loadable records, typed."""
    p = load_library_lines(read(spark, d, "library_raw")).filter("reason is null")
    number = F.expr("try_cast(nullif(fields.precursor_mz, '') as double)")
    n_peaks = F.size(F.split(F.trim("fields.peaks"), " +")).cast("int")
    return p.select("line_id", "lib", "fields.name", number.alias("precursor_mz"), "fields.precursor_type", F.nullif(F.col("fields.formula"), F.lit("")).alias("formula"), "fields.inchikey", n_peaks.alias("n_peaks"))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """Records kept and left out of each library (``n_skipped``)."""
    p = load_library_lines(read(spark, d, "library_raw"))
    return p.groupBy("lib").agg(F.count_if(F.col("reason").isNull()).alias("n_loaded"), F.count_if(F.col("reason") == "skipped").alias("n_skipped"), F.count_if(F.col("reason").isNotNull() & (F.col("reason") != "skipped")).alias("n_failed"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return flag_readings(read(spark, d, "points"))


def _filled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    blocks = materialise(fill_block_groups(read(spark, d, "filled_mask")))
    return blocks, fill_features(read(spark, d, "aligned_feature_table"), blocks)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    blocks, features = _filled(spark, d)
    row = lambda src, key, field: [F.lit(src).alias("src"), F.col(key).alias("row_id"), F.lit(field).alias("field"), F.col("group_id")]
    fields = F.explode(F.array_compact(F.array(*[F.when(F.col(f"{f}_filled") == 1, F.lit(f)) for f in ("n_filled", "possible_halogen")])))
    out = features.filter("n_filled_filled = 1 or possible_halogen_filled = 1").select("group_id", fields.alias("f"))
    return blocks.filter("group_id_filled = 1").select(*row("filled_mask", "mask_id", "group_id")).unionByName(out.select(F.lit("aligned_feature_table").alias("src"), F.col("group_id").alias("row_id"), F.col("f").alias("field"), "group_id"))


def p5_features(spark: SparkSession, d: str) -> DataFrame:
    """The feature table filled, with its masks."""
    return _filled(spark, d)[1].select("group_id", "study", "n_filled", "n_filled_filled", "possible_halogen", "possible_halogen_filled")


def p5_widths(spark: SparkSession, d: str) -> DataFrame:
    """The feature table's bounds and spread in time filled, with their masks."""
    w = fill_widths(read(spark, d, "aligned_feature_table"))
    return w.select("group_id", *[x for c in ("rt_min", "rt_max", "rt_sd") for x in (F.round(c, 6).alias(c), F.col(f"{c}_filled"))])


def p6_grid(spark: SparkSession, d: str) -> DataFrame:
    """The regular series of each run: time-weighted summed intensity, coverage and status of each cell."""
    g = regrid(scan_readings(read(spark, d, "scans"), read(spark, d, "points")), "run", "minutes", "inten", GRID_MINUTES)
    return g.select("run", "cell", F.round("value", 3).alias("value"), F.round("coverage", 6).alias("coverage"), "n_readings", "status")


def p4_impossible(spark: SparkSession, d: str) -> DataFrame:
    """The readings that no source can give, whatever its usual behaviour."""
    return impossible(read(spark, d, "points")).select("run", "scan", "pos").distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_grid(spark, d).filter("status != 'measured'").select("run", "cell")


QUERIES = {f.__name__: f for f in (p3_found, p3_loaded, p3_counts, p4_found, p4_impossible, p5_found, p5_features, p5_widths, p6_found, p6_grid)}

_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
_NUMBER = r"([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?"
_FORMULA = "((Br|Cl|Si|Na|I|K|S|P|F|O|N|C|H)([1-9][0-9]*)?)+"
_PARSED = f"""
with a as (select line_id, lib, coalesce(raw, '') as raw, regexp_full_match(coalesce(raw, ''), '{_FIELD}(?:,{_FIELD})*', 's') as syntax from library_raw),
b as (select *, case when syntax then list_transform(regexp_extract_all(',' || raw, ',((?:"(?:[^"]|"")*"|[^",]*))', 1, 's'), lambda f:
  case when f[1] = '"' then replace(f[2:len(f) - 1], '""', '"') else f end) end as v from a),
parsed as (select *, case when not syntax then 'quoting' when len(v) <> 9 then 'column_count'
  when not ((v[2] = '' or (regexp_full_match(v[2], '{_NUMBER}') and coalesce(try_cast(v[2] as double), 0) > 0 and coalesce(try_cast(v[2] as double), 0) < 5000)) and (v[5] = '' or regexp_full_match(v[5], '{_FORMULA}'))) then 'bad_value'
  when lower(trim(v[4])) in ('1', 'ms1') or trim(v[9]) = '' or trim(v[8]) = '0' then 'skipped' end as reason from b)
"""
_SCANS = """
with units as (select run, max(case when lower(trim(rt_unit)) in ('second', 'minute') then lower(trim(rt_unit)) end) as u, max(rt) as most from scans where coalesce(isfinite(rt), true) group by run),
m as (select s.run, s.scan, s.rt, case when coalesce(u.u = 'second', u.most > 200) then s.rt / 60 else s.rt end as t from scans s join units u on s.run = u.run where s.rt is not null and isfinite(s.rt)),
c as (select distinct run, k + case when t < 0.05::double * k then -1 when t >= 0.05::double * (k + 1) then 1 else 0 end as cell from (select run, t, cast(floor(t / 0.05::double) as bigint) as k from m))
"""
_FILLED = """
with known as (select row_no, group_id, count(*) as n from filled_mask where group_id >= 1 and row_no is not null group by row_no, group_id),
best as (select row_no, group_id as g from known qualify row_number() over (partition by row_no order by n desc, group_id) = 1),
blocks as (select m.mask_id, coalesce(case when m.group_id >= 1 then m.group_id end, b.g) as group_id, m.filled, (m.group_id is null or m.group_id < 1) and b.g is not null as was_filled from filled_mask m left join best b on m.row_no = b.row_no),
counts as (select group_id, cast(count(*) filter (filled = 1) as integer) as n from blocks where group_id is not null group by group_id),
verdicts as (select compound_id, possible_halogen as h, count(*) as n from aligned_feature_table where possible_halogen in ('yes', 'maybe', 'no') and compound_id is not null group by 1, 2),
shares as (select h, sum(n) / sum(sum(n)) over () as p from verdicts group by h),
verdict as (select v.compound_id, v.h from verdicts v join shares s on v.h = s.h qualify row_number() over (partition by v.compound_id order by v.n + 0.01 * s.p desc, v.h) = 1),
features as (select f.group_id, f.study, case when f.n_filled >= 0 then f.n_filled else c.n end as n_filled, cast((f.n_filled is null or f.n_filled < 0) and c.n is not null as integer) as n_filled_filled,
  case when f.possible_halogen in ('yes', 'maybe', 'no') then f.possible_halogen else v.h end as possible_halogen, cast(coalesce(f.possible_halogen not in ('yes', 'maybe', 'no'), true) and v.h is not null as integer) as possible_halogen_filled
  from aligned_feature_table f left join counts c on f.group_id = c.group_id left join verdict v on f.compound_id = v.compound_id)
"""
#: One numeric of the mixed-effects model: mean, effects of compound and of minute with their shrinkage, and the prediction, not below 0.
_EFFECTS = """
{c}_a as (select sum(y) / count(y) as mu, greatest((sum(y * y) - sum(y) * sum(y) / count(y)) / (count(y) - 1), 0) as v from {c}_y),
{c}_t as (select minute, count(y) as n, avg(y) - (select mu from {c}_a) as d from {c}_y group by minute),
{c}_u as (select greatest(coalesce(var_samp(d) - avg((select v from {c}_a) / greatest(n, 1)), 0), 0) as tau from {c}_t),
{c}_te as (select minute, coalesce(case when tau > 0 then d * n / (n + (select v from {c}_a) / tau) else 0 end, 0) as e from {c}_t, {c}_u),
{c}_g as (select compound_id, count(y) as n, avg(y) - (select mu from {c}_a) as d, var_samp(y) as w from {c}_y group by compound_id),
{c}_n as (select coalesce(sum(w * (n - 1)) / sum(case when w is not null then n - 1 end), 0) as noise, coalesce(var_samp(d), 0) as spread from {c}_g),
{c}_ge as (select compound_id, coalesce(d * n / (n + noise / greatest(spread - noise / greatest(n, 1), 1e-9::double)), 0) as e from {c}_g, {c}_n),
{c}_p as (select y.group_id, greatest((select mu from {c}_a) + coalesce(g.e, 0) + coalesce(t.e, 0), 0) as p from {c}_y y left join {c}_ge g on y.compound_id = g.compound_id left join {c}_te t on y.minute = t.minute)"""
_WIDTHS = "with f as (select *, concat_ws('|', study, cast(cast(floor(rt) as bigint) as varchar)) as minute from aligned_feature_table), " + ", ".join(
    f"{c}_y as (select group_id, compound_id, minute, {e} as y from f)," + _EFFECTS.format(c=c) for c, e in (("l", "rt - rt_min"), ("r", "rt_max - rt"), ("s", "rt_sd"))
)
_GRID = """
with units as (select run, max(case when lower(trim(rt_unit)) in ('second', 'minute') then lower(trim(rt_unit)) end) as u, max(rt) filter (isfinite(rt)) as most from scans group by run),
o as (select run, scan, rt from scans where rt is not null and isfinite(rt) qualify row_number() over (partition by run, scan order by loaded_at desc nulls last, rt desc) = 1),
sums as (select run, scan, sum(cast(inten as double)) as y from points where inten > 0 and isfinite(inten) group by run, scan),
r as (select o.run, case when coalesce(u.u = 'second', u.most > 200) then o.rt / 60 else o.rt end as t, coalesce(s.y, 0) as y from o join units u on o.run = u.run left join sums s on o.run = s.run and o.scan = s.scan),
sp as (select run, t, y, least(coalesce(lead(t) over (partition by run order by t), t), t + 0.05::double) as e from r),
k as (select *, cast(floor(t / 0.05::double) as bigint) as k0, cast(floor(e / 0.05::double) as bigint) as k1 from sp),
w as (select *, k0 + case when t < k0 * 0.05::double then -1 when t >= (k0 + 1) * 0.05::double then 1 else 0 end as own, k1 + case when e < k1 * 0.05::double then -1 when e >= (k1 + 1) * 0.05::double then 1 else 0 end as last from k),
p as (select run, t, y, e, own, unnest(range(own, last + 1)) as cell from w),
q as (select *, greatest(least(e, (cell + 1) * 0.05::double) - greatest(t, cell * 0.05::double), 0) as h from p),
c as (select run, cell, coalesce(sum(y * h) / nullif(sum(h), 0), avg(y) filter (cell = own)) as value, least(sum(h) / 0.05::double, 1) as coverage, count(*) filter (cell = own) as n_readings from q group by run, cell),
ends as (select run, min(cell) as a, max(cell) as b from c where n_readings > 0 group by run), full_ as (select run, unnest(range(a, b + 1)) as cell from ends)
select f.run, f.cell, round(c.value, 3) as value, round(coalesce(c.coverage, 0), 6) as coverage, coalesce(c.n_readings, 0) as n_readings, case when c.n_readings > 0 then 'measured' when c.coverage > 0 then 'held' else 'missing' end as status
from full_ f left join c on f.run = c.run and f.cell = c.cell"""
ORACLES = {
    "p3_found": _PARSED + "select line_id, reason from parsed where reason is not null",
    "p3_loaded": _PARSED + """select line_id, lib, v[1] as name, try_cast(nullif(v[2], '') as double) as precursor_mz, v[3] as precursor_type, nullif(v[5], '') as formula, v[6] as inchikey,
  cast(len(regexp_split_to_array(trim(v[9]), ' +')) as integer) as n_peaks from parsed where reason is null""",
    "p3_counts": _PARSED + "select lib, count(*) filter (reason is null) as n_loaded, count(*) filter (reason = 'skipped') as n_skipped, count(*) filter (reason is not null and reason <> 'skipped') as n_failed from parsed group by lib",
    "p5_found": _FILLED + """select 'filled_mask' as src, mask_id as row_id, 'group_id' as field, group_id from blocks where was_filled
  union all select 'aligned_feature_table', group_id, 'n_filled', group_id from features where n_filled_filled = 1
  union all select 'aligned_feature_table', group_id, 'possible_halogen', group_id from features where possible_halogen_filled = 1""",
    "p5_features": _FILLED + "select group_id, study, n_filled, n_filled_filled, possible_halogen, possible_halogen_filled from features",
    "p4_impossible": "select distinct run, scan, pos from points where coalesce(cast(inten as varchar) = 'nan' or inten <= 0 or inten > 1e12, false) or coalesce(cast(mz as varchar) = 'nan' or mz < 50 or mz > 1700, false)",
    "p5_widths": _WIDTHS + """ select f.group_id, round(coalesce(f.rt_min, f.rt - l_p.p), 6) as rt_min, cast(f.rt_min is null and f.rt is not null as integer) as rt_min_filled, round(coalesce(f.rt_max, f.rt + r_p.p), 6) as rt_max,
  cast(f.rt_max is null and f.rt is not null as integer) as rt_max_filled, round(coalesce(f.rt_sd, s_p.p), 6) as rt_sd, cast(f.rt_sd is null and s_p.p is not null as integer) as rt_sd_filled
  from f join l_p on f.group_id = l_p.group_id join r_p on f.group_id = r_p.group_id join s_p on f.group_id = s_p.group_id""",
    "p6_grid": _GRID,
    "p6_found": _SCANS + ", r as (select run, min(cell) as a, max(cell) as b from c group by run) select run, unnest(range(a, b + 1)) as cell from r except select run, cell from c",
}
