"""Integers of several words, and where three triangles meet, against Python's integers."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from facetflow.functions.wide import Wide
from facetflow.operators.surfaces import TRIPLE_TESTS, triple_points

NAMES = [f"p{p}{n}" for p in range(9) for n in "xyz"]


def test_wide_integers(spark):
    rng = random.Random(3)
    rows = [(0, 0, 0, 0), (None, 1, 1, 1), (-1, 1, -1, 1), (-(2**63), 2**63 - 1, -(2**63), -(2**63)), (2**28, -(2**28), 2**56, -(2**56)), (1, 1, 1, 1)]
    rows += [tuple(rng.randint(-(2**63), 2**63 - 1) >> rng.randint(0, 62) for _ in range(4)) for _ in range(100)]
    a, b, c, d = (Wide.of(F.col(n)) for n in "abcd")
    made = {"p": a * b, "q": a.cross(b, c, d)}
    table = spark.createDataFrame(rows, "a long, b long, c long, d long").withColumns({n: w.words for n, w in made.items()})
    p, q = (w.named(n) for n, w in made.items())
    table = table.withColumn("r", (p * q).words)
    r = (p * q).named("r")
    shown = {"p": p, "q": q, "r": r, "plus": a + b, "minus": a - b, "negated": -a}
    for x in table.select("a", "b", "c", "d", *[w.to_text().alias(f"{n}_text") for n, w in shown.items()], r.sign().alias("sign"), a.compare(b).alias("order"), r.to_double().alias("double")).collect():
        if x.a is None:
            assert all(x[k] is None for k in ("p_text", "q_text", "r_text", "plus_text", "negated_text", "sign", "order", "double"))
            continue
        want = {"p": x.a * x.b, "q": x.a * x.d - x.b * x.c, "plus": x.a + x.b, "minus": x.a - x.b, "negated": -x.a}
        want["r"] = want["p"] * want["q"]
        assert {n: x[f"{n}_text"] for n in want} == {n: str(v) for n, v in want.items()}
        assert x.sign == (want["r"] > 0) - (want["r"] < 0) and x.order == (x.a > x.b) - (x.a < x.b)
        assert abs(x.double - want["r"]) <= abs(want["r"]) * 1e-15


def meeting(v):
    """Status and point of nine corners, by the planes' equations in fractions."""
    t = [[v[9 * k + 3 * c : 9 * k + 3 * c + 3] for c in range(3)] for k in range(3)]
    sub = lambda p, q: [x - y for x, y in zip(p, q, strict=True)]
    cross = lambda u, w: [u[1] * w[2] - u[2] * w[1], u[2] * w[0] - u[0] * w[2], u[0] * w[1] - u[1] * w[0]]
    dot = lambda u, w: sum(x * y for x, y in zip(u, w, strict=True))
    n = [cross(sub(b, a), sub(c, a)) for a, b, c in t]
    whole = dot(n[0], cross(n[1], n[2]))
    if not whole:
        return "degenerate", None
    right = [dot(n[k], t[k][0]) for k in range(3)]
    parts = [cross(n[1], n[2]), cross(n[2], n[0]), cross(n[0], n[1])]
    p = [Fraction(sum(right[k] * parts[k][i] for k in range(3)), whole) for i in range(3)]
    sides = [dot(n[k], cross(sub(t[k][(e + 1) % 3], t[k][e]), sub(p, t[k][e]))) for k in range(3) for e in range(3)]
    worst = min((s > 0) - (s < 0) for s in sides)
    return {1: "meets", 0: "degenerate", -1: "empty"}[worst], p


def triples():
    """At random; through one point of the grid, on or by a single step off a side; flat ones; all up to the largest coordinates."""
    rng = random.Random(5)
    rows = []
    for size in (3, 100, 2**29 // 3):
        for k in range(60):
            at = [rng.randint(-size, size) for _ in range(3)]
            row = []
            for t in range(3):
                u, v = ([rng.randint(-size, size) for _ in range(3)] for _ in range(2))
                if k % 4 == 0:  # the point is the middle of a side of the first triangle, moved by at most a step
                    w = [-x + (rng.choice((-1, 0, 1)) if t == 0 else 0) for x in u] if t == 0 else [-x - y for x, y in zip(u, v, strict=True)]
                elif k % 4 == 1:
                    w = [-x - y for x, y in zip(u, v, strict=True)]  # well inside
                elif k % 4 == 2:
                    w = [rng.randint(-size, size) for _ in range(3)]
                else:
                    w = [2 * x - y for x, y in zip(u, v, strict=True)] if t == 2 else [-x for x in v]  # a flat one
                row += [max(-(2**29), min(2**29, a + x)) for p in (u, v, w) for a, x in zip(at, p, strict=True)]
            rows.append(row)
    return rows


@pytest.fixture(scope="module")
def tested(spark):
    rows = [(k, *map(float, r)) for k, r in enumerate(triples())] + [(1000, None, *[1.0] * 26), (1001, *[1.0] * 26, None)]
    table = spark.createDataFrame(rows, ["id", *NAMES]).repartition(3)
    return {test: triple_points(table, NAMES, test) for test in TRIPLE_TESTS}


def test_triple_points_against_fractions(tested):
    want = [meeting(r) for r in triples()]
    assert {status for status, _ in want} == {"meets", "empty", "degenerate"}
    for test in ("exact", "combined"):
        got = {r.id: r for r in tested[test].collect()}
        assert len(got) == len(want) + 2 and all(got[k].status is None and got[k].x is None for k in (1000, 1001))
        for k, (status, p) in enumerate(want):
            assert got[k].status == status
            if status == "meets":
                size = max(map(abs, triples()[k]))
                assert all(abs(got[k][n] - x) <= 1e-14 * size for n, x in zip("xyz", p, strict=True))
            else:
                assert got[k].x is None
        if test == "combined":  # both stages decide some, the first most of those in general position
            assert {r.stage for r in got.values()} == {"filter", "exact", None}
        else:
            assert {r.stage for r in got.values()} == {"exact", None}


def test_the_filter_is_never_wrong(tested):
    want = [meeting(r)[0] for r in triples()]
    got = {r.id: r.status for r in tested["filter"].collect()}
    assert all(got[k] in ("maybe", w) for k, w in enumerate(want))
    sure = [k for k in range(len(want)) if got[k] != "maybe"]
    assert len(sure) > len(want) / 3 and all(got[k] == "maybe" for k, w in enumerate(want) if w == "degenerate")
    rough = {r.id: r.status for r in tested["inexact"].collect()}
    assert all(rough[k] == want[k] for k in sure) and rough[1000] is None


def test_no_python_worker(tested):
    plan = tested["combined"]._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan


def test_unknown_test(tested, spark):
    with pytest.raises(ValueError, match="none of"):
        triple_points(spark.range(1), NAMES, "other")


def test_triples_of_boxes_by_cells(spark):
    """Against all triples, with boxes of many sizes, of no extent and twice in one place; only boxes are shuffled, by cells."""
    import re
    from itertools import combinations

    from facetflow.operators.spatial import BOX, box_triples

    rng, boxes = random.Random(8), []
    for k in range(70):
        low, size = [rng.randint(-4, 4) for _ in range(3)], rng.choice([0, 1, 3, 5, 14])
        boxes.append(("ab"[k % 2], k, *map(float, low), *[float(c + rng.randint(0, size)) for c in low]))
    boxes.append(("a", 70, *boxes[0][2:]))
    meet = lambda p, q: p[0] == q[0] and all(p[2 + j] <= q[5 + j] and q[2 + j] <= p[5 + j] for j in range(3))
    want = sorted((p[0], p[1], q[1], r[1]) for p, q, r in combinations(boxes, 3) if meet(p, q) and meet(q, r) and meet(p, r))
    got = box_triples(spark.createDataFrame(boxes, ["mesh_id", "id", *BOX]), ["mesh_id"])
    assert sorted(map(tuple, got.collect())) == want and len(want) > 50
    dealt = re.findall(r"hashpartitioning\((.*?)\)", got._jdf.queryExecution().executedPlan().toString())
    assert dealt and all("cell_x" in keys for keys in dealt)


def test_triples_of_one_cell_by_many_tasks(spark, monkeypatch):
    """Boxes of one cell: first boxes are dealt, and no join compares pairs with all boxes."""
    import random

    from facetflow.operators import spatial

    monkeypatch.setattr(spatial, "CROWDED_TRIPLES", 1 << 16, raising=False)
    r = random.Random(5)
    low = [tuple(r.randrange(16) for _ in range(3)) for _ in range(90)]
    boxes = [("m", k, *map(float, p), *(float(c + 8 + k % 3) for c in p)) for k, p in enumerate(low)]
    boxes += [("m", 7, *boxes[8][2:]), ("n", 1, *boxes[1][2:]), ("n", 2, *boxes[2][2:])]  # a repeated id, another mesh
    meets = lambda p, q: p[0] == q[0] and all(p[2 + n] <= q[5 + n] and q[2 + n] <= p[5 + n] for n in range(3))
    by_id = sorted(boxes, key=lambda b: b[1])
    pairs = {(i, j) for i, p in enumerate(by_id) for j, q in enumerate(by_id) if p[1] < q[1] and meets(p, q)}
    want = sorted((by_id[i][0], by_id[i][1], by_id[j][1], by_id[k][1]) for i, j in pairs for k in range(len(by_id)) if (j, k) in pairs and (i, k) in pairs)
    got = spatial.box_triples(spark.createDataFrame(boxes, ["mesh_id", "id", *spatial.BOX]), ["mesh_id"])
    assert sorted(map(tuple, got.collect())) == want and len(want) > 1000
    assert len({x[0] for x in got.selectExpr("spark_partition_id()").distinct().collect()}) == 4
    assert "SortMergeJoin" not in got._jdf.queryExecution().toString()
