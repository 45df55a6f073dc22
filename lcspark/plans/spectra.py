"""Queries on MS2 spectra, library records and hits, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lcspark.constants import ADDUCT_PIECES, ELECTRON, MASS
from lcspark.functions import chem
from lcspark.functions.spectra import METHODS
from lcspark.operators import spectra as s
from lcspark.operators.stats import confusion, spread_rank
from lcspark.operators.traces import by_run, run_key
from lcspark.session import once, small
from lcspark.sources.tables import read


def _library(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "library")


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "identifications").filter("group_id is not null and spectrum is not null and score is not null and not isnan(score)")


def q_assign(spark: SparkSession, d: str) -> DataFrame:
    return s.assign(read(spark, d, "ms2_map"), read(spark, d, "aligned_feature_table"))


def q_representative(spark: SparkSession, d: str) -> DataFrame:
    """The spectrum of the largest ion current of each feature."""
    m = read(spark, d, "ms2_map").filter("group_id is not null and tic > 0 and not isnan(tic)")
    return s.first_of(m.select("group_id", "map_id", "tic"), ["group_id"], [F.col("tic").desc(), F.col("map_id")]).select("group_id", "map_id")



def _order() -> list:
    return [F.col("score").desc(), F.col("n_matched").desc_nulls_last(), F.col("library_index").asc_nulls_last(), F.col("hit_id")]


def q_rank_hits(spark: SparkSession, d: str) -> DataFrame:
    """Every hit with its rank in its feature's spectrum copy."""
    h = _hits(spark, d).select("hit_id", "group_id", "spectrum", "score", "n_matched", "library_index")
    return spread_rank(h, ["group_id", "spectrum"], "score", _order()[1:], 0.02).select("hit_id", "rank")


def q_default_hits(spark: SparkSession, d: str) -> DataFrame:
    """The best hit of each feature over all its spectrum copies."""
    h = _hits(spark, d).select("group_id", "spectrum", "hit_id", "score", "n_matched", "library_index", "name")
    return s.first_of(h, ["group_id"], _order()).select("group_id", "spectrum", "hit_id", "name", "score")


def q_listing(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of feature and record that any copy lists, with the copies that agree."""
    h = _hits(spark, d).groupBy("group_id", "library_index").agg(F.max("score").alias("best"), F.bool_or((F.col("score") > 0.1) & (F.col("n_matched") > 0)).alias("_listed"), F.countDistinct("spectrum").alias("n_copies"))
    return h.filter("_listed").select("group_id", "library_index", "best", "n_copies")


def q_annotation(spark: SparkSession, d: str) -> DataFrame:
    """The annotation in force of every feature: the library's best hit if it scores enough, else none."""
    f = read(spark, d, "aligned_feature_table").select("group_id")
    h = q_default_hits(spark, d).filter("score >= 0.7")
    return f.join(h, "group_id", "left").select("group_id", F.coalesce("name", F.lit("")).alias("annotation"), F.when(F.col("name").isNotNull(), "library").otherwise("none").alias("source"))


def _library_candidates(spark: SparkSession, d: str, run: Column) -> DataFrame:
    mode = read(spark, d, "scans").groupBy(F.col("run").alias("file")).agg(F.max(F.when(F.lower(F.trim("polarity")).startswith("pos"), 1).when(F.lower(F.trim("polarity")).startswith("neg"), 2).otherwise(0)).alias("q_mode"))
    q = read(spark, d, "ms2_map").filter("precursor_mz > 0").select("map_id", run.alias("file"), F.col("precursor_mz").alias("q_mz")).join(mode, "file")
    return s.candidates(q, _library(spark, d), 200.0).select("map_id", "library_index")


def q_library_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Records that may explain each MS2 spectrum: precursor within 200 ppm and a compatible mode (positive by the run's polarity). Runs as ``file`` is written."""
    return _library_candidates(spark, d, F.col("file"))


def q_library_candidates_whole(spark: SparkSession, d: str) -> DataFrame:
    """q_library_candidates with every spelling of ``file`` as its run."""
    return _library_candidates(spark, d, run_key(F.col("file")))


def q_library_index(spark: SparkSession, d: str) -> DataFrame:
    """Several libraries as one: a global index from each library's offset and record number."""
    n = _library(spark, d).groupBy("lib").agg((F.max("rec") + 1).cast("bigint").alias("n"))
    n = n.withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy("lib").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return _library(spark, d).join(small(n), "lib").select("lib", "rec", (F.col("first") + F.col("rec")).alias("global_index"))


def q_formula(spark: SparkSession, d: str) -> DataFrame:
    """Mass, Hill text and double-bond equivalents of every formula."""
    x, n = chem.with_counts(_library(spark, d), "formula")
    return x.select("library_index", F.round(chem.mass_of(n), 6).alias("mass"), chem.hill(n).alias("hill"), chem.dbe2(n).alias("dbe2"))


def q_adduct(spark: SparkSession, d: str) -> DataFrame:
    """The m/z that formula and adduct imply, and how far the record's precursor lies from it."""
    x, n = chem.with_counts(_library(spark, d).filter("precursor_mz is not null"), "formula")
    x = once(x, t=chem.ion_mz(chem.mass_of(n), F.col("precursor_type"))).filter("t is not null")
    return x.select("library_index", F.round("t", 6).alias("theoretical_mz"), F.round((F.col("precursor_mz") - F.col("t")) / F.col("t") * 1e6, 3).alias("ppm_error"))


def q_rules(spark: SparkSession, d: str) -> DataFrame:
    x, n = chem.with_counts(_library(spark, d), "formula")
    x = once(x, m=chem.mass_of(n))
    m = F.col("m")
    return x.select("library_index", chem.ratios_ok(n, m).cast("int").alias("ratios"), chem.combinations_ok(n).cast("int").alias("combinations"), chem.precursor_ok(n, m).cast("int").alias("precursor"))


def q_peak_stats(spark: SparkSession, d: str) -> DataFrame:
    """Base peak, kept peaks and spectral entropy of every record after the cut below the precursor and at 1 %; arrays stay arrays."""
    x = _library(spark, d).select("library_index", F.filter("peaks", lambda p: (p["inten"] > 0) & (F.col("precursor_mz").isNull() | (p["mz"] < F.col("precursor_mz") - 1.6))).alias("p"))
    x = once(x, top=F.array_max(F.transform("p", lambda p: p["inten"].cast("double"))))
    x = once(x, k=F.transform(F.filter("p", lambda p: p["inten"].cast("double") >= F.col("top") * 0.01), lambda p: p["inten"].cast("double")))
    x = once(x, total=F.aggregate("k", F.lit(0.0), lambda a, v: a + v))
    e = F.aggregate("k", F.lit(0.0), lambda a, v: a - v / F.col("total") * F.log(v / F.col("total")))
    return x.filter("total > 0").select("library_index", F.size("k").alias("n_kept"), "top", F.round(e, 6).alias("entropy"))


def q_confusion(spark: SparkSession, d: str) -> DataFrame:
    """How a score cut calls hits whose library precursor agrees with the ppm error, per spectrum copy."""
    c = confusion(_hits(spark, d), ["spectrum"], F.abs("ppm_error") <= 10, F.col("score") >= 0.5)
    return c.select("spectrum", "tp", "fn", "fp", "tn", *[F.round(x, 6).alias(x) for x in ("recall", "precision", "fpr")])


def q_unique_keys(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (feature, ion formula) keys of the denoising search, and the hits that share each."""
    h = read(spark, d, "identifications").filter("denoise_ion is not null and group_id is not null")
    return h.groupBy("group_id", "denoise_ion").agg(F.count("*").alias("n_hits"), F.min("denoise_key").alias("first_key"))


def q_library_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits and distinct features of each record of the library, records without hits included."""
    h = _hits(spark, d).groupBy("library_index").agg(F.count("*").alias("n_hits"), F.countDistinct("group_id").alias("n_features"))
    return _library(spark, d).select("library_index").join(h, "library_index", "left").select("library_index", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.coalesce("n_features", F.lit(0)).alias("n_features"))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return _library(spark, d).select(F.col("library_index").alias("query_id"), "precursor_mz", "mode", "peaks")


#: Width of the searches below: analogues, not only equal precursors, so that a library finds more than itself.
OPEN_PPM = 5000.0


def q_scores(spark: SparkSession, d: str) -> DataFrame:
    """All five scores of every pair of records of near precursors and one mode."""
    q = _queries(spark, d).select("query_id", F.col("precursor_mz").alias("q_mz"), F.col("mode").alias("q_mode"))
    pairs = s.candidates(q, _library(spark, d), OPEN_PPM).filter("query_id < library_index")
    c = s.clean_spectra(_library(spark, d), "library_index")
    return s.score_pairs(pairs, c.withColumnRenamed("library_index", "query_id"), c).select("query_id", "library_index", "n_matched", *[F.round(m, 6).alias(m) for m in METHODS])


def q_identify(spark: SparkSession, d: str) -> DataFrame:
    """Every record searched in the whole library for analogues, itself left out; hits of a score above 0.02 are listed."""
    hits = s.identify(_queries(spark, d), _library(spark, d), OPEN_PPM, least=0.02).filter("query_id != library_index")
    return hits.select("query_id", "library_index", F.round("score", 6).alias("score"), "n_matched")


def q_consensus_spectra(spark: SparkSession, d: str) -> DataFrame:
    """One voted spectrum for all records of a formula and adduct."""
    x = _library(spark, d).filter("formula is not null and precursor_type is not null")
    w = F.aggregate("peaks", F.lit(0.0), lambda a, p: a + p["inten"].cast("double"))
    x = x.select("formula", "precursor_type", F.col("library_index").alias("id"), w.alias("weight"), "precursor_mz", F.transform("peaks", lambda p: F.struct(p["mz"].alias("mz"), p["inten"].cast("double").alias("inten"))).alias("peaks"))
    return s.consensus_spectra(x, ["formula", "precursor_type"]).select("formula", "precursor_type", "n_used", "n_peaks")


def q_denoise(spark: SparkSession, d: str) -> DataFrame:
    """Every record, those that the rule doesn't apply to whole."""
    return s.passed(_library(spark, d)).select("library_index", "n_peaks", "n_kept", "applied")


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}

#: Cleaned spectra and their scores. Crowded peaks are merged as islands, which equals the rule where none holds more than its strongest peak reaches.
CLEAN = """with raw as (select library_index, precursor_mz, unnest(peaks, recursive := true) from library),
f as (select library_index, mz, inten::double as i from raw where isfinite(mz) and isfinite(inten) and inten > 0 and not coalesce(precursor_mz > 0 and mz >= precursor_mz - 1.6, false)),
g as (select *, case when mz - lag(mz) over (partition by library_index order by mz) <= 0.05::double then 0 else 1 end as new from f),
h as (select *, sum(new) over (partition by library_index order by mz) as isl from g),
m as (select library_index, sum(mz * i) / sum(i) as mz, sum(i) as i from h group by library_index, isl),
k as (select *, max(i) over (partition by library_index) as top from m), c as (select library_index, mz, i / sum(i) over (partition by library_index) as p from k where i >= 0.01::double * top),
s as (select *, -sum(p * ln(p)) over (partition by library_index) as ent, p ** 0.6::double * mz ** 3 as d from c),
t as (select *, case when ent < 3 then p ** (0.25 + 0.25 * ent) else p end as u from s),
v as (select *, u / sum(u) over (partition by library_index) as w, sum(p * p) over (partition by library_index) as pp, sum(d * d) over (partition by library_index) as dd from t),
cand as (select a.library_index as q, b.library_index as l from library a join library b on a.library_index <> b.library_index and abs(b.precursor_mz - a.precursor_mz) <= a.precursor_mz * (5000.0::double / 1e6) and (a.mode = b.mode or a.mode = 0 or b.mode = 0)),
x as (select cand.q, cand.l, a.p as pa, b.p as pb, a.w as wa, b.w as wb, a.d as da, b.d as db, a.pp as ppa, b.pp as ppb, a.dd as dda, b.dd as ddb, sum(a.p) over y as sm, sum(a.p * ln(a.p)) over y as tm
  from cand join v a on a.library_index = cand.q join v b on b.library_index = cand.l and abs(a.mz - b.mz) <= 0.02::double window y as (partition by cand.q, cand.l)),
z as (select *, case when ln(sm) - tm / sm < 3 then (pa / sm) ** (0.25 + 0.25 * (ln(sm) - tm / sm)) else pa / sm end as r from x), z2 as (select *, r / sum(r) over (partition by q, l) as rw from z),
scored as (select q, l, count(*) as n, greatest(least(sum(0.5 * ((pa + pb) * log2(pa + pb) - pa * log2(pa) - pb * log2(pb))), 1), 0) as entropy,
  greatest(least(sum(0.5 * ((wa + wb) * log2(wa + wb) - wa * log2(wa) - wb * log2(wb))), 1), 0) as weighted_entropy, least(sum(pa * pb) / sqrt(max(ppa) * max(ppb)), 1) as dot, least(sum(da * db) / sqrt(max(dda) * max(ddb)), 1) as weighted_dot,
  greatest(least(sum(0.5 * ((rw + wb) * log2(rw + wb) - rw * log2(rw) - wb * log2(wb))), 1), 0) as reverse_entropy from z2 group by q, l)
"""
HITS = "with h as (select * from identifications where group_id is not null and spectrum is not null and score is not null and isfinite(score))"
_ATOMS = "masses as (select * from (values " + ", ".join(f"('{e}', {m!r}::double)" for e, m in MASS.items()) + ") t(e, m))"
_ORDER_E = ["C", "H", *sorted(e for e in MASS if e not in ("C", "H"))]
FORMULAS = f"""with {_ATOMS}, f as (select library_index, precursor_mz, precursor_type, unnest(regexp_extract_all(formula, '[A-Z][a-z]?[0-9]*')) as tok from library where regexp_full_match(formula, '((Br|Cl|Si|Na|I|K|S|P|F|O|N|C|H)[0-9]*)+')),
a as (select library_index, precursor_mz, precursor_type, regexp_extract(tok, '[A-Za-z]+') as e, coalesce(try_cast(nullif(regexp_extract(tok, '[0-9]+'), '') as integer), 1) as n from f),
w as (select library_index, any_value(precursor_mz) as precursor_mz, any_value(precursor_type) as precursor_type, sum(n * m) as mass, {", ".join(f"coalesce(sum(n) filter (a.e = '{e}'), 0)::integer as {e}_" for e in MASS)} from a join masses on a.e = masses.e group by library_index)"""
_DBE = "2 * (C_ + Si_) + 2 + N_ + P_ - H_ - F_ - Cl_ - Br_ - I_ - Na_ - K_"
_CAP = lambda row: " and ".join(f"{e}_ <= {c}" for e, c in zip(chem.CAP_ELEMENTS, row))
_RATIOS = " and ".join(f"{e}_ <= {r} * C_" for e, r in chem.PER_CARBON.items()) + " and case " + " ".join(f"when mass < {edge} then {_CAP(row)}" for edge, row in chem.CAPS.items() if edge != float("inf")) + f" else {_CAP(chem.CAPS[float('inf')])} end"
_COMBOS = "not (N_ > 0 and O_ > 0 and P_ > 0 and S_ > 0 and (N_ >= 10 or O_ >= 20 or P_ >= 4 or S_ >= 3)) and not (N_ > 3 and O_ > 3 and P_ > 3 and (N_ >= 11 or O_ >= 22 or P_ >= 6)) and not (O_ > 1 and P_ > 1 and S_ > 1 and (O_ >= 14 or P_ >= 3 or S_ >= 3)) and not (P_ > 1 and S_ > 1 and N_ > 1 and (P_ >= 3 or S_ >= 3 or N_ >= 4)) and not (N_ > 6 and O_ > 6 and S_ > 6 and (N_ >= 19 or O_ >= 14 or S_ >= 8))"
_PIECES = "pieces as (select * from (values " + ", ".join(f"('{p}', {chem.piece_mass(f)!r}::double)" for p, f in ADDUCT_PIECES.items()) + ") t(p, pm))"
DEFAULT = HITS + ", b as (select group_id, spectrum, hit_id, name, score from h qualify row_number() over (partition by group_id order by score desc, n_matched desc nulls last, library_index nulls last, hit_id) = 1)"
ORACLES = {
    "q_assign": """select m.map_id, f.group_id from ms2_map m join aligned_feature_table f on m.study = f.study and abs(f.mz - m.precursor_mz) <= m.precursor_mz * (10.0::double / 1e6) and m.rt_s / 60 between f.rt_min and f.rt_max where m.precursor_mz > 0
qualify row_number() over (partition by m.map_id order by f.n_detected desc, abs(m.rt_s / 60 - f.rt), f.group_id) = 1""",
    "q_representative": "select group_id, map_id from ms2_map where group_id is not null and tic > 0 and isfinite(tic) qualify row_number() over (partition by group_id order by tic desc, map_id) = 1",
    "q_rank_hits": HITS + " select hit_id, cast(row_number() over (partition by group_id, spectrum order by score desc, n_matched desc nulls last, library_index nulls last, hit_id) as integer) as rank from h",
    "q_default_hits": DEFAULT + " select * from b",
    "q_listing": HITS + " select group_id, library_index, max(score) as best, count(distinct spectrum) as n_copies from h group by 1, 2 having bool_or(score > 0.1 and n_matched > 0)",
    "q_annotation": DEFAULT + " select f.group_id, coalesce(b.name, '') as annotation, case when b.name is not null then 'library' else 'none' end as source from aligned_feature_table f left join b on f.group_id = b.group_id and b.score >= 0.7",
    "q_library_candidates": """with r as (select run, max(case when lower(trim(polarity)) like 'pos%' then 1 when lower(trim(polarity)) like 'neg%' then 2 else 0 end) as q from scans group by run)
select m.map_id, l.library_index from ms2_map m join r on m.file = r.run join library l on abs(l.precursor_mz - m.precursor_mz) <= m.precursor_mz * (200.0::double / 1e6) and (l.mode = r.q or l.mode = 0 or r.q = 0) where m.precursor_mz > 0""",
    "q_library_index": "with n as (select lib, max(rec) + 1 as n from library group by lib), o as (select lib, coalesce(sum(n) over (order by lib rows between unbounded preceding and 1 preceding), 0) as first from n) select l.lib, l.rec, cast(o.first + l.rec as bigint) as global_index from library l join o on l.lib = o.lib",
    "q_formula": FORMULAS + " select library_index, round(mass, 6) as mass, " + " || ".join(f"case when {e}_ > 1 then '{e}' || {e}_ when {e}_ = 1 then '{e}' else '' end" for e in _ORDER_E) + f" as hill, cast({_DBE} as integer) as dbe2 from w",
    "q_adduct": FORMULAS + f""", {_PIECES}, ad as (select distinct precursor_type as t from library where regexp_full_match(precursor_type, '\\[[0-9]*M([+-][A-Za-z0-9]+)*\\][0-9]*[+-]')),
term as (select t, unnest(regexp_extract_all(regexp_extract(t, 'M(.*)\\]', 1), '[+-][0-9]*[A-Za-z][A-Za-z0-9]*')) as x from ad),
sums as (select t, sum(case when x[1] = '-' then -1 else 1 end * coalesce(try_cast(nullif(regexp_extract(x, '^[+-]([0-9]*)', 1), '') as integer), 1) * pm) as delta, bool_and(pm is not null) as known from term left join pieces on p = regexp_extract(x, '^[+-][0-9]*(.*)$', 1) group by t),
z as (select ad.t, coalesce(sums.delta, 0) as delta, coalesce(try_cast(nullif(regexp_extract(ad.t, '^\\[([0-9]*)', 1), '') as integer), 1) as n, coalesce(try_cast(nullif(regexp_extract(ad.t, '\\]([0-9]*)', 1), '') as integer), 1) * case when ad.t like '%+' then 1 else -1 end as z from ad left join sums on ad.t = sums.t where coalesce(sums.known, true)),
q as (select library_index, precursor_mz, (n * mass + delta - z * {ELECTRON!r}::double) / abs(z) as t from w join z on w.precursor_type = z.t where precursor_mz is not null)
select library_index, round(t, 6) as theoretical_mz, round((precursor_mz - t) / t * 1e6, 3) as ppm_error from q""",
    "q_rules": FORMULAS + f" select library_index, cast({_RATIOS} as integer) as ratios, cast({_COMBOS} as integer) as combinations, cast(C_ > 0 and 10 * H_ >= C_ and H_ <= 6 * C_ and ({_RATIOS}) and ({_COMBOS}) and {_DBE} >= -1 as integer) as precursor from w",
    "q_peak_stats": """with p as (select library_index, precursor_mz, unnest(peaks, recursive := true) from library), k as (select library_index, inten::double as i, max(inten::double) over (partition by library_index) as top from p where inten > 0 and (precursor_mz is null or mz < precursor_mz - 1.6)),
c as (select library_index, i, top, sum(i) over (partition by library_index) as t from k where i >= top * 0.01::double) select library_index, cast(count(*) as integer) as n_kept, max(top) as top, round(-sum(i / t * ln(i / t)), 6) as entropy from c group by library_index""",
    "q_confusion": HITS + """, c as (select spectrum, count(*) filter (t and p) as tp, count(*) filter (t and not p) as fn, count(*) filter (not t and p) as fp, count(*) filter (not t and not p) as tn from (select spectrum, coalesce(abs(ppm_error) <= 10, false) as t, score >= 0.5 as p from h) group by spectrum)
select *, round(tp / nullif(tp + fn, 0), 6) as recall, round(tp / nullif(tp + fp, 0), 6) as precision, round(fp / nullif(fp + tn, 0), 6) as fpr from c""",
    "q_unique_keys": "select group_id, denoise_ion, count(*) as n_hits, min(denoise_key) as first_key from identifications where denoise_ion is not null and group_id is not null group by 1, 2",
    "q_scores": CLEAN + " select cand.q as query_id, cand.l as library_index, cast(coalesce(n, 0) as integer) as n_matched, " + ", ".join(f"round(coalesce({m}, 0), 6) as {m}" for m in METHODS) + " from cand left join scored on cand.q = scored.q and cand.l = scored.l where cand.q < cand.l",
    "q_identify": CLEAN + " select q as query_id, l as library_index, round(weighted_entropy, 6) as score, cast(n as integer) as n_matched from scored where weighted_entropy > 0.02",
    "q_library_hits": HITS + " select l.library_index, count(h.hit_id) as n_hits, count(distinct h.group_id) as n_features from library l left join h on l.library_index = h.library_index group by 1",
}
ORACLES["q_library_candidates_whole"] = by_run(ORACLES["q_library_candidates"])
