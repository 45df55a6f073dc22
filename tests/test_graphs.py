import random

from lcspark.constants import MASS, PROTON
from lcspark.operators import compounds


def _sequential(weight, edges):
    near = {k: set() for k in weight}
    for a, b in edges:
        if a != b and a in near and b in near:
            near[a].add(b)
            near[b].add(a)
    center = {}
    for s in sorted(weight, key=lambda k: (-weight[k], k)):
        if s not in center:
            center[s] = s
            for j in near[s]:
                center.setdefault(j, s)
    return center


def test_stars_equal_the_sequential_rule(spark):
    for seed in range(3):
        r = random.Random(seed)
        weight = {i: float(r.randrange(8)) for i in range(60)}
        edges = [(r.randrange(62), r.randrange(60)) for _ in range(90)]
        n = spark.createDataFrame(list(weight.items()), "id bigint, weight double")
        got = {x.id: x.center for x in compounds.star_clusters(n, spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
        assert got == _sequential(weight, edges)


def test_stars_do_not_chain(spark):
    n = spark.createDataFrame([(0, 3.0), (1, 2.0), (2, 1.0), (3, None)], "id bigint, weight double")
    e = spark.createDataFrame([(0, 1), (1, 2)], "a bigint, b bigint")
    assert {x.id: x.center for x in compounds.star_clusters(n, e).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}
    assert compounds.star_clusters(n.limit(0), e).count() == 0


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + r.randrange(30), 100 + r.randrange(30)) for _ in range(20)] + [(7, 7), (None, 5)]
    parent: dict = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
    got = {x.id: x.component for x in compounds.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: top(k) for k in parent}


def test_roles(spark):
    m = 299.0927 - PROTON
    na = m + MASS["Na"] - 0.00054857990946
    d = spark.createDataFrame([(1, 1, 299.0927, 9.0), (2, 1, na, 5.0), (3, 1, 310.0, 1.0), (4, 4, 500.0, 1.0)], "id bigint, center bigint, mz double, weight double")
    got = {x.id: x.role for x in compounds.roles(d).collect()}
    assert got == {1: "[M+H]+", 2: "[M+Na]+", 3: "+10.9073", 4: "base"}


def test_warps(spark):
    a = spark.createDataFrame([("f", k, float(k), float(k) * 1.1 + 0.5) for k in range(100)], "file string, id bigint, native double, corr double")
    k = compounds.warp_knots(a, 10)
    t = spark.createDataFrame([("f", 1, 50.0), ("f", 2, -5.0), ("f", 3, 200.0), ("g", 4, 3.0)], "file string, id bigint, native double")
    got = {x.id: x.corr for x in compounds.warp_apply(t, k).collect()}
    first, last = 4.5 * 0.1 + 0.5, 94.5 * 0.1 + 0.5
    assert abs(got[1] - 55.5) < 1e-9 and abs(got[2] - (-5 + first)) < 1e-9 and abs(got[3] - (200 + last)) < 1e-9 and got[4] == 3.0
