"""Graphs of features: components, star clusters and the roles of ions in a compound; and retention-time warps.

Graph rules run as rounds of joins whose state is written to the shared folder after each; no component is gathered in a task or the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lcspark.band import band_join
from lcspark.constants import ADDUCT_PIECES, ELECTRON
from lcspark.functions.chem import piece_mass
from lcspark.operators.traces import study_of
from lcspark.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` of ``edges(a, b)``: the smallest id that a path leads to. Rounds of neighbour minima with shortcuts; their number is
    about the logarithm of the longest path."""
    both = edges.select("a", "b").union(edges.select("b", "a")).filter("a is not null and b is not null").distinct()
    both = materialise(both)
    state = both.select(F.col("a").alias("id")).distinct().withColumn("component", F.col("id"))
    while True:
        near = both.join(state.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("_n"))
        low = state.join(near, "id").select("id", "component", F.least("component", "_n").alias("_l"))
        # shortcut: a label's own label
        jump = low.select(F.col("id").alias("_l"), F.col("_l").alias("_j"))
        new = materialise(low.join(jump, "_l", "left").select("id", F.coalesce("_j", "_l").alias("_c"), "component"))
        state = new.select("id", F.col("_c").alias("component"))
        if new.filter(F.col("_c") != F.col("component")).isEmpty():
            return state


def star_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, center)`` of ``nodes(id, weight)`` and ``edges(a, b)``: strongest first, a free node claims its free neighbours; stars don't chain.

    Equal weights go to the smaller id. The rounds give the sequential result: a node is decided as soon as the strongest of its stronger
    neighbours that may still be a center is one, or none is left. Edges to unknown nodes and null weights (as the weakest) are harmless.
    """
    n = nodes.select("id", F.coalesce(F.col("weight").cast("double"), F.lit(float("-inf"))).alias("w")).dropDuplicates(["id"])
    e = edges.select("a", "b").union(edges.select("b", "a")).filter("a != b").distinct()
    e = e.join(n.select(F.col("id").alias("a"), F.col("w").alias("wa")), "a").join(n.select(F.col("id").alias("b"), F.col("w").alias("wb")), "b")
    up = materialise(e.filter("wb > wa or (wb = wa and b < a)").select(F.col("a").alias("id"), "b", "wb"))
    state = materialise(n.select("id", F.lit(None).cast(n.schema["id"].dataType).alias("center")))
    while not state.filter("center is null").isEmpty():
        open_ = state.filter("center is null").select("id")
        rivals = up.join(open_, "id", "left_semi").join(state.select(F.col("id").alias("b"), F.col("center").alias("_c")), "b").filter("_c is null or _c = b")
        first = rivals.groupBy("id").agg(F.min(F.struct((-F.col("wb")).alias("w"), "b", "_c")).alias("_f"))
        d = state.join(first, "id", "left")
        center = F.when(F.col("center").isNotNull(), F.col("center")).when(F.col("_f").isNull(), F.col("id")).when(F.col("_f._c").isNotNull(), F.col("_f.b"))
        state = materialise(d.select("id", center.alias("center")))
    return state


#: The ions that runs of a polarity show; the first is the primary one.
IONS = {
    "pos": """[M+H]+ [M+NH4]+ [M+Na]+ [M+K]+ [M+H-H2O]+ [M+H-2H2O]+ [M+H-NH3]+ [M+H-HCOOH]+ [M+2Na-H]+ [M+CH3OH+H]+ [M+ACN+H]+ [M+ACN+Na]+
        [M+2H]2+ [M+H+Na]2+ [2M+H]+ [2M+NH4]+ [2M+Na]+""".split(),
    "neg": "[M-H]- [M+Cl]- [M+HCOO]- [M+CH3COO]- [M-H-H2O]- [M-H-CO2]- [M+Na-2H]- [M+K-2H]- [M+Br]- [M-2H]2- [2M-H]- [2M+HCOO]-".split(),
}


def ion_table(polarity: str) -> list[tuple[str, int, float, int]]:
    """Name, molecules, mass added to them and charge of each ion of a polarity."""
    out = []
    for name in IONS[polarity]:
        n, pieces, z, sign = re.fullmatch(r"\[(\d*)M(.*)\](\d*)([+-])", name).groups()
        charge = int(z or 1) * (1 if sign == "+" else -1)
        delta = sum((-1 if s == "-" else 1) * int(k or 1) * piece_mass(ADDUCT_PIECES[p]) for s, k, p in re.findall(r"([+-])(\d*)([A-Za-z][A-Za-z0-9]*)", pieces))
        out.append((name, int(n or 1), delta - charge * ELECTRON, abs(charge)))
    return out


def study_polarity(scans: DataFrame) -> DataFrame:
    """``(study, polarity)``: ``neg`` where most of a study's scans with a known polarity are negative, else ``pos``; however it is spelled."""
    p = F.substring(F.lower(F.trim("polarity")), 1, 3)
    g = scans.select(study_of(F.col("run")).alias("study"), F.when(p == "neg", 1).when(p == "pos", -1).otherwise(0).alias("v")).groupBy("study").agg(F.sum("v").alias("v"))
    return g.select("study", F.when(F.col("v") > 0, "neg").otherwise("pos").alias("polarity"))


def roles(members: DataFrame, ppm: float = 5.0, least_mass: float = 50.0, polarity: str = "pos", isotopes: DataFrame | None = None) -> DataFrame:
    """``(id, center, role, neutral_mass)`` of ``members(id, center, mz, weight)``: the neutral mass that explains most members of a star names them.

    Every member proposes its mass under every ion of the polarity; hypotheses meet their star's other proposals in a tolerance join. Best is the
    mass of the most members, then one that holds the primary ion, then of the largest weight, then the smallest. Without two explained members, and
    for members the mass does not explain, the role is ``base`` for the center and the m/z difference to it for the others. ``isotopes(id, parent, k)``:
    isotope peaks take their parent's role and ``M+k``, and propose nothing.
    """
    table = ion_table(polarity)
    ions = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(float(n)).alias("n"), F.lit(float(d)).alias("d"), F.lit(float(z)).alias("z")) for k, n, d, z in table])
    whole = members
    if isotopes is not None:
        members = members.join(isotopes.select("id"), "id", "left_anti")
    p = members.select("id", "center", "mz", "weight", F.explode(ions).alias("i")).select("id", "center", "mz", "weight", F.col("i.name").alias("name"), ((F.col("mz") * F.col("i.z") - F.col("i.d")) / F.col("i.n")).alias("m")).filter(F.col("m") >= least_mass)
    p = materialise(p)
    other = p.select("center", F.col("id").alias("id2"), F.col("name").alias("name2"), F.col("weight").alias("weight2"), F.col("m").alias("m2"))
    met = band_join(p.select("center", "id", "name", "m"), other, "m", "m2", ppm, ["center"])
    each = met.groupBy("center", "id", "name", "m", "id2").agg(F.min(F.struct(F.abs(F.col("m2") - F.col("m")).alias("o"), F.col("name2").alias("n"))).alias("_b"), F.max("weight2").alias("w"))
    h = each.groupBy("center", "id", "name", "m").agg(F.count("*").alias("n"), F.max((F.col("_b.n") == table[0][0]).cast("int")).alias("primary"), F.sum("w").alias("w"))
    best = h.filter("n >= 2").groupBy("center").agg(F.min(F.struct((-F.col("n")).alias("n"), (-F.col("primary")).alias("p"), (-F.col("w")).alias("w"), "m", "id", "name")).alias("_h"))
    best = best.select("center", F.col("_h.id").alias("id"), F.col("_h.name").alias("name"), F.col("_h.m").alias("mass"))
    named = each.join(best, ["center", "id", "name"]).select("center", F.col("id2").alias("id"), F.col("_b.n").alias("role"), "mass")
    base = whole.select(F.col("id").alias("center"), F.col("mz").alias("_base"))
    d = members.join(base, "center").join(named, ["center", "id"], "left")
    rest = F.when(F.col("id") == F.col("center"), "base").otherwise(F.format_string("%+.4f", F.col("mz") - F.col("_base")))
    out = d.select("id", "center", F.coalesce("role", rest).alias("role"), F.col("mass").alias("neutral_mass"))
    if isotopes is None:
        return out
    of = out.select(F.col("id").alias("parent"), F.col("role").alias("_role"), F.col("neutral_mass").alias("_mass"))
    child = whole.join(isotopes, "id").join(base, "center", "left").join(of, "parent", "left")
    role = F.coalesce(F.concat("_role", F.lit(" M+"), F.col("k").cast("string")), F.format_string("%+.4f", F.col("mz") - F.col("_base")))
    return out.unionByName(child.select("id", "center", role.alias("role"), F.col("_mass").alias("neutral_mass")))


def territories(pairs: DataFrame, positions: DataFrame) -> DataFrame:
    """``(id, lo, hi)``: of the members of each chain of ``pairs(a, b)`` the range of time to the midpoints with its neighbours, null at the ends.
    ``positions(id, rt)``."""
    c = components(pairs).join(positions, "id")
    w = Window.partitionBy("component").orderBy("rt", "id")
    return c.select("id", ((F.lag("rt").over(w) + F.col("rt")) / 2).alias("lo"), ((F.lead("rt").over(w) + F.col("rt")) / 2).alias("hi"))


def warp_knots(anchors: DataFrame, knots: int = 20) -> DataFrame:
    """``(file, knot, rt_native, rt_corr)`` of ``anchors(file, id, native, corr)``: medians of equal-count bins, made strictly increasing."""
    d = anchors.dropna().withColumn("knot", F.ntile(knots).over(Window.partitionBy("file").orderBy("native", "id")))
    k = d.groupBy("file", "knot").agg(F.median("native").alias("rt_native"), F.median("corr").alias("rt_corr"))
    w = Window.partitionBy("file").orderBy("knot").rowsBetween(Window.unboundedPreceding, -1)
    return k.withColumn("_n", F.max("rt_native").over(w)).withColumn("_c", F.max("rt_corr").over(w)).filter("_n is null or (rt_native > _n and rt_corr > _c)").drop("_n", "_c")


def warp_apply(times: DataFrame, knots: DataFrame) -> DataFrame:
    """``(id, corr)`` of ``times(file, id, native)``: linear between knots, the end knots' shift outside. An as-of join by union and last value;
    files without a knot keep their times."""
    w = Window.partitionBy("file").orderBy("rt_native")
    seg = knots.select("file", F.col("rt_native").alias("native"), F.struct("rt_native", "rt_corr", F.lead("rt_native").over(w).alias("n2"), F.lead("rt_corr").over(w).alias("c2")).alias("k"))
    ends = knots.groupBy("file").agg(F.min(F.struct("rt_native", "rt_corr")).alias("_first"))
    u = times.select("file", "native", "id", F.lit(None).cast(seg.schema["k"].dataType).alias("k"), F.lit(1).alias("side")).unionByName(seg.withColumn("id", F.lit(None).cast(times.schema["id"].dataType)).withColumn("side", F.lit(0)))
    u = u.withColumn("k", F.last("k", ignorenulls=True).over(Window.partitionBy("file").orderBy("native", "side").rowsBetween(Window.unboundedPreceding, 0))).filter("side = 1").join(ends, "file", "left")
    inside = F.col("k.rt_corr") + (F.col("native") - F.col("k.rt_native")) * (F.col("k.c2") - F.col("k.rt_corr")) / (F.col("k.n2") - F.col("k.rt_native"))
    after = F.col("native") + F.col("k.rt_corr") - F.col("k.rt_native")
    before = F.col("native") + F.col("_first.rt_corr") - F.col("_first.rt_native")
    return u.select("id", F.coalesce(F.when(F.col("k.n2").isNotNull(), inside).when(F.col("k").isNotNull(), after), before, F.col("native")).alias("corr"))
