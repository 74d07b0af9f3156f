"""Goldens and properties of the mesh operators on small meshes made here."""

import math
import random
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from facetflow.functions import predicates as P
from facetflow.functions.ext import K1
from facetflow.functions.quantize import QuantizationError, Quantizer
from facetflow.functions.vec import V3, Triangle
from facetflow.operators import boolean, graph, loops, planes, repair, stats, topology
from facetflow.operators.spatial import self_intersections
from facetflow.operators.triangulate import MOST, TriangulationError, polygon_crossings, triangulate
from facetflow.sources import off
from facetflow.sources.derived import BOX_CORNERS, BOX_TRIANGLES, MeshFrame


def mesh(spark, parts):
    """``parts``: (mesh_id, vertices, triangles); ids run on over all meshes."""
    v, t = [], []
    for name, points, faces in parts:
        base = len(v)
        v += [(name, base + k, *map(float, p)) for k, p in enumerate(points)]
        t += [(name, len(t) + k, *(base + x for x in f)) for k, f in enumerate(faces)]
    return MeshFrame(spark.createDataFrame(v, "mesh_id string, vid long, x double, y double, z double"), spark.createDataFrame(t, "mesh_id string, tid long, a long, b long, c long"))


def box(low, high):
    return [tuple((high if s > 0 else low)[k] for k, s in enumerate(c)) for c in BOX_CORNERS], BOX_TRIANGLES


def volume(m):
    return {r.mesh_id: r.volume for r in stats.geometric_statistics(m, ("volume",)).collect()}


def test_exterior_algebra_goldens(spark):
    point = lambda *p: K1.point(V3.lit(*p))
    row = lambda *c: tuple(spark.range(1).select(*c).first())
    e = point(3, 4, 5).join(point(6, 7, 8))
    assert row(*e.columns("e")) == (-3, -6, -3, -3, -3, -3)
    assert row(*e.join(point(14, -10, 5)).columns("t")) == (-117, -75, -33, 42)
    assert row(point(3, 4, 5).inner(point(6, 7, 8))) == (87,)
    t = point(2, 2, 1).join(point(7, 4, 2)).join(point(4, 9, 3))
    assert row(*t.columns("t")) == (9, 31, 8, -3)
    met = point(2, 2, 3).join(point(6, 7, 0)).meet(t).to_point()
    assert row(*met.parts()) == pytest.approx((538 / 145, 120 / 29, 249 / 145))
    sizes = [point(*p).absolute() for p in ((2, 2, 3), (6, 7, 0), (2, 2, 1), (7, 4, 2), (4, 9, 3))]
    bound = sizes[0].join(sizes[1]).meet(sizes[2].join(sizes[3]).join(sizes[4])).to_point()
    assert row(*bound.parts()) == pytest.approx((5162 / 1255, 5818 / 1255, 519 / 251))


def test_quantizer_goldens(spark):
    q = Quantizer.of(1000, 0.1)
    assert tuple(spark.range(1).select(*q.to_grid(V3.lit(7, 4, 3)).parts()).first()) == (3670016, 2097152, 1572864)
    with pytest.raises(QuantizationError) as error:
        Quantizer.of(1e9, 1e-3)
    assert error.value.code == "EXCESSIVE_DYNAMIC_RANGE_FOR_QUANTIZATION"


def test_exact_signs_at_the_limits(spark):
    rng = random.Random(4)
    limit = (1 << 29) - 1
    pick = lambda small: rng.choice([-limit, limit, 0, rng.randint(-limit, limit)]) if not small else rng.randint(-2, 2)
    rows = [tuple(pick(k % 2) for _ in range(15)) for k in range(400)]
    names = [f"{c}{n}" for c in "pqabc" for n in "xyz"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names))
    got = P.with_piercing_signs(df, V3.of("p"), V3.of("q"), Triangle.of()).withColumn("direct", P.orient3d(V3.of("a"), V3.of("b"), V3.of("c"), V3.of("p"))).collect()

    def sign(a, b, c, d):
        u, v, w = ([x - y for x, y in zip(p, d, strict=True)] for p in (a, b, c))
        det = u[0] * (v[1] * w[2] - v[2] * w[1]) + u[1] * (v[2] * w[0] - v[0] * w[2]) + u[2] * (v[0] * w[1] - v[1] * w[0])
        return (det > 0) - (det < 0)

    for r in got:
        p, q, a, b, c = ([r[f"{k}{n}"] for n in "xyz"] for k in "pqabc")
        assert (r.sp, r.sq, r.s1, r.s2, r.s3) == (sign(a, b, c, p), sign(a, b, c, q), sign(p, q, a, b), sign(p, q, b, c), sign(p, q, c, a))
        assert r.direct == r.sp


def test_loops_of_an_edge_list():
    found = loops.walk_undirected([(1, 2), (2, 3), (3, 1), (4, 5), (5, 6), (6, 7), (7, 4), (4, 8), (8, 9), (9, 4)])
    assert found == [[1, 2, 3], [4, 5, 6, 7], [4, 8, 9]]
    assert loops.walk([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 3)]) == [[1, 2, 3], [3, 4, 5]]
    for edges, code in (([], "EMPTY_REGION"), ([(1, 2), (2, 3)], "NOT_CLOSED")):
        with pytest.raises(loops.BoundaryError) as error:
            loops.walk(edges)
        assert error.value.code == code
    assert loops.smooth([0, 1, 2, 3], [(0, 1, 2), (9, 8, 7)]) == [0, 2, 3]


def area2(points, t):
    (ax, ay), (bx, by), (cx, cy) = (points[k] for k in t)
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def test_triangulation():
    square = [(0, 0), (1, 0), (1, 1), (0, 1)]
    assert len(triangulate(square, [(0, 1), (1, 2), (2, 3), (3, 0)])) == 2
    decagon = [(math.cos(k * math.pi / 5), math.sin(k * math.pi / 5)) for k in range(10)]
    assert len(triangulate(decagon, [(k, (k + 1) % 10) for k in range(10)])) == 8
    for points, segments, code in (([(k, k * k) for k in range(MOST + 1)], [], "TOO_MANY_POINTS"), (square, [(0, 1)] * MOST, "TOO_MANY_SEGMENTS"), ([*square, (0, 0)], [], "POINTS_COINCIDE"), (square, [(0, 2), (1, 3)], "CROSSING_SEGMENTS")):
        with pytest.raises(TriangulationError) as error:
            triangulate(points, segments)
        assert error.value.code == code


def test_triangulation_of_more_points_than_usual():
    rng = random.Random(3)
    points = sorted({(rng.random(), rng.random()) for _ in range(MOST + 200)})
    found = triangulate(points, [], carve=False, most=None)
    sides = [frozenset(e) for a, b, c in found for e in ((a, b), (b, c), (c, a))]
    assert len({x for t in found for x in t}) == len(points)
    assert len(found) + 2 * len(set(sides)) - len(sides) == 2 * len(points) - 2


@settings(max_examples=150, deadline=None)
@given(st.sets(st.tuples(st.integers(-8, 8), st.integers(-8, 8)), min_size=3, max_size=14), st.randoms(use_true_random=False))
def test_triangulations_of_star_polygons(cells, rng):
    """A polygon around a point, its corners by angle: no point is lost or added, the area and all sides are kept."""
    by_angle = {}
    for x, y in cells:
        if (x, y) != (0, 0):
            by_angle.setdefault(math.atan2(y, x), (x, y))
    ring = [by_angle[a] for a in sorted(by_angle)]
    gaps = [b - a for a, b in zip(sorted(by_angle), [*sorted(by_angle)[1:], sorted(by_angle)[0] + 2 * math.pi] if by_angle else [], strict=True)]
    if len(ring) < 3 or max(gaps) >= math.pi - 1e-9:
        return
    n = len(ring)
    found = triangulate(ring, [(k, (k + 1) % n) for k in range(n)])
    whole = sum(ring[k][0] * ring[(k + 1) % n][1] - ring[k][1] * ring[(k + 1) % n][0] for k in range(n))
    assert sum(area2(ring, t) for t in found) == whole
    assert all(area2(ring, t) > 0 for t in found)
    assert len(found) == n - 2


def test_polygon_crossings():
    bow = [(0, 0), (2, 2), (2, 0), (0, 2)]
    assert polygon_crossings(bow) == [(0, 2)]
    assert polygon_crossings([(0, 0), (2, 0), (2, 2), (0, 2)]) == []
    # only the closing edge crosses
    hook = [(0, 0), (4, 0), (4, 4), (1, -2)]
    assert polygon_crossings(hook, closing=False) == [(0, 2)]


def test_booleans_against_known_volumes(spark):
    cases = {  # name: (a, b, volume of what both have)
        "overlap": (((0, 0, 0), (2, 2, 2)), ((1, 1, 1), (3, 3, 3)), 1.0),
        "nested": (((0, 0, 0), (4, 4, 4)), ((1, 1, 1), (2, 2, 2)), 1.0),
        "apart": (((0, 0, 0), (1, 1, 1)), ((5, 5, 5), (6, 6, 6)), 0.0),
        "through": (((0, 0, 0), (4, 4, 4)), ((1, 1, -1), (2, 2, 5)), 4.0),
        "face": (((0, 0, 0), (2, 2, 2)), ((2, 0, 0), (4, 2, 2)), 0.0),
        "same": (((0, 0, 0), (2, 2, 2)), ((0, 0, 0), (2, 2, 2)), 8.0),
    }
    left = mesh(spark, [(k, *box(*a)) for k, (a, _, _) in cases.items()])
    right = mesh(spark, [(k, *box(*b)) for k, (_, b, _) in cases.items()])
    cut = boolean.resolve(left, right)
    va, vb = volume(left), volume(right)
    got = {op: volume(boolean.select(cut, op)) for op in boolean.RULES}
    for name, (_, _, both) in cases.items():
        near = lambda x: pytest.approx(x, abs=2e-4)
        assert got["intersection"].get(name, 0) == near(both)
        assert got["union"].get(name, 0) == near(va[name] + vb[name] - both)
        assert got["difference"].get(name, 0) == near(va[name] - both)
        assert got["symmetric_difference"].get(name, 0) == near(va[name] + vb[name] - 2 * both)
    shape = stats.topological_statistics(boolean.select(cut, "union").triangles, bodies=True).toPandas().set_index("mesh_id")
    assert (shape.num_non_manifold == 0).all()
    assert shape.num_bodies[["overlap", "apart"]].tolist() == [1, 2]
    assert shape.euler["through"] == 2 and shape.euler["apart"] == 4
    hollow = stats.topological_statistics(boolean.select(cut, "difference").triangles).toPandas().set_index("mesh_id")
    assert hollow.euler["through"] == 0  # a hole right through


def test_each_pair_of_a_batch_by_itself(spark):
    """A huge, a tiny, a self-intersecting and a degenerate pair beside a good one: each gets what it gets alone."""
    bow = ([(0, 0, 0), (2, 0, 0), (0, 2, 0), (0.4, 0.4, 2), (0.5, 0.5, -1), (0.6, 0.9, 1)], [(0, 2, 1), (0, 1, 3), (0, 3, 2), (1, 2, 3), (4, 5, 0), (4, 0, 5)])
    cases = {
        "good": (box((0, 0, 0), (2, 2, 2)), box((1, 1, 1), (3, 3, 3))),
        "huge": (box((0, 0, 0), (4e9, 4e9, 4e9)), box((2e9, 2e9, 2e9), (6e9, 6e9, 6e9))),
        "tiny": (box((0, 0, 0), (2e-6, 2e-6, 2e-6)), box((1e-6, 1e-6, 1e-6), (3e-6, 3e-6, 3e-6))),
        "bow": (bow, box((5, 5, 5), (6, 6, 6))),
        "wide": (box((0, 0, 0), (1e-6, 1e-6, 1e-6)), box((0, 0, 0), (1e6, 1e6, 1e6))),
    }
    left, right = (mesh(spark, [(k, *v[side]) for k, v in cases.items()]) for side in (0, 1))
    cut = boolean.resolve(left, right)
    status = {r.mesh_id: r.status for r in cut.status.collect()}
    assert status == {"good": "OK", "huge": "OK", "tiny": "OK", "bow": "SELF_INTERSECTING_OPERAND", "wide": "EXCESSIVE_DYNAMIC_RANGE_FOR_QUANTIZATION"}
    got = volume(boolean.select(cut, "union"))
    assert got == {"good": pytest.approx(15, abs=1e-3), "huge": pytest.approx(15 * 8e27, rel=1e-4), "tiny": pytest.approx(15e-18, rel=1e-4)}
    volumes = {r.mesh_id: r["union"] for r in boolean.volumes(cut).collect()}
    assert volumes == {k: pytest.approx(v, rel=1e-9) for k, v in got.items()}
    # ids decide the moves: the same ids alone
    alone = boolean.resolve(left.where("good"), right.where("good"))
    assert volume(boolean.select(alone, "union")) == {"good": pytest.approx(got["good"], rel=1e-12)}


def test_budget_of_perturbations(spark, monkeypatch):
    """Coincident boxes that are not moved before the sixth attempt: one has bits for it, one has spent its own by then."""
    from facetflow.operators.spatial import on_grid

    asked = []

    def still(mesh, quantizer, seed, quanta):
        asked.append(seed)
        return on_grid(mesh, quantizer, seed, quanta if len(asked) > 5 else 0)

    monkeypatch.setattr(boolean, "on_grid", still)
    cases = {"thick": box((0, 0, 0), (2, 2, 2)), "thin": box((0, 0, 0), (3e5, 3e5, 1))}
    both = [mesh(spark, [(k, *v) for k, v in cases.items()]) for _ in range(2)]
    cut = boolean.resolve(*both)
    got = {r.mesh_id: (r.status, r.attempts, r.bits_left) for r in cut.status.collect()}
    assert got == {"thick": ("OK", 6, 5), "thin": ("DEGENERATE", 2, 0)} and asked == [1, 2, 3, 4, 5, 6]
    assert volume(boolean.select(cut, "union")) == {"thick": pytest.approx(8, abs=1e-3)}


def test_bits_of_a_budget(spark):
    from facetflow.functions.quantize import perturbation_budget

    rows = spark.range(10, 31).select("id", *[x.alias(n) for x, n in zip(perturbation_budget(F.col("id").cast("int"), 8), ("begin", "ranges"), strict=True)]).collect()
    for bits, begin, ranges in rows:
        assert begin == min(8, max(2, bits - 12)) and ranges >= 1
        assert begin + ranges - 1 == min(bits - 8, 18)  # the widest range leaves eight bits of the shortest edge


def test_booleans_of_a_box_and_a_tetrahedron(spark):
    tetra = ([(0, 0, 0), (3, 0, 0), (0, 3, 0), (0, 0, 3)], [(0, 2, 1), (0, 1, 3), (0, 3, 2), (1, 2, 3)])
    a, b = mesh(spark, [("m", *box((0, 0, 0), (2, 2, 2)))]), mesh(spark, [("m", *tetra)])
    cut = boolean.resolve(a, b)
    # the corner x + y + z <= 3 of the cube of side 2 about the origin
    both = 27 / 6 - 3 * 1 / 6
    assert volume(boolean.select(cut, "intersection"))["m"] == pytest.approx(both, abs=1e-4)
    assert volume(boolean.select(cut, "union"))["m"] == pytest.approx(8 + 4.5 - both, abs=1e-4)
    # classifiers of one's own: what a rule says, and only the part of one operand's surface within the other
    own = boolean.select(cut, lambda label, inside: F.when((label == 0) & (inside == 0), "keep").when((label == 1) & (inside == 1), "flip").otherwise("drop"))
    assert volume(own) == volume(boolean.select(cut, "difference"))
    part = boolean.select(cut, lambda label, inside: F.when((label == 1) & (inside == 1), "keep"))
    assert part.triangles.count() == cut.mesh.triangles.where("label = 1 AND inside = 1").count() > 0
    again = boolean.select(boolean.resolve(a, b), "union")
    assert volume(again) == volume(boolean.select(cut, "union"))


def test_self_intersections_and_repair(spark):
    n = 8
    grid = [(x, y, 0.05 * math.sin(x * y)) for y in range(n) for x in range(n)]
    faces = [t for y in range(n - 1) for x in range(n - 1) for i in [y * n + x] for t in ((i, i + 1, i + n), (i + 1, i + n + 1, i + n))]
    grid[3 * n + 3] = (4.6, 4.3, -0.9)  # pulled under its neighbours
    grid[4 * n + 4] = (3.9, 4.1, -2.0)
    m = mesh(spark, [("m", grid, faces)])
    before = self_intersections(m).count()
    assert before > 0
    fixed, counts = repair.remove_self_intersections(m)
    assert (counts.before, counts.after) == (before, self_intersections(fixed).count())
    assert counts.after == 0 and counts.resolved and (counts.abandoned, counts.failed) == (0, 0)
    e = topology.edge_incidence(fixed.triangles)
    assert e.where("n_inc > 2").count() == 0 and e.where("n_inc = 1").count() == 4 * (n - 1)
    regions = repair.self_intersecting_regions(m)
    assert regions.select("region").distinct().count() >= 1


def sheet(n=8):
    faces = [t for y in range(n - 1) for x in range(n - 1) for i in [y * n + x] for t in ((i, i + 1, i + n), (i + 1, i + n + 1, i + n))]
    return [(float(x), float(y), 0.05 * math.sin(x * y)) for y in range(n) for x in range(n)], faces


def test_non_manifold_edges_one_by_one(spark):
    """An edge inside is cut out and closed; at the boundary its hole cannot close, so its triangles stay and it is reported."""
    points, faces = sheet()
    tip = len(points)
    m = mesh(spark, [("inside", [*points, (3.5, 3.2, 9.0)], [*faces, (27, 28, tip)]), ("rim", [*points, (3.5, 0.2, 9.0)], [*faces, (3, 11, tip)]), ("sound", points, faces)])
    fixed, counts = repair.remove_non_manifold_edges(m)
    assert (counts.before, counts.after, counts.resolved, counts.abandoned, counts.failed) == (2, 1, 1, 1, 0)
    n = {r.mesh_id: (r.t, r.h) for r in topology.edge_incidence(fixed.triangles).groupBy("mesh_id").agg(F.count_if(F.col("n_inc") == 1).alias("h"), F.sum("n_inc").alias("t")).collect()}
    assert n == {"inside": (3 * (98 - 4), 28), "rim": (3 * 99, 30), "sound": (3 * 98, 28)}


def test_removals_are_judged_by_themselves(spark):
    points, faces = sheet()
    m = mesh(spark, [("m", points, faces)])
    tids = {r.tid: {r.a, r.b, r.c} for r in m.triangles.collect()}
    low = min(v for c in tids.values() for v in c)
    fan = lambda *of: [t for t, c in tids.items() if c & {low + v for v in of}]
    regions = {1: fan(27), 2: fan(18, 45), 3: fan(3), 4: list(tids), 5: fan(27, 28)}
    removals = spark.createDataFrame([("m", k, t) for k, of in regions.items() for t in of], "mesh_id string, region long, tid long")
    status, patches = repair.judge_removals(m, removals)
    assert {r.region: r.status for r in status.collect()} == {1: "ok", 2: "MANY_BOUNDARIES", 3: "NOT_CLOSED", 4: "NO_BOUNDARY", 5: "ok"}
    assert {r.region: r["count"] for r in patches.groupBy("region").count().collect()} == {1: 4, 5: 6}
    status, _ = repair.judge_removals(m, removals, one_boundary=False)
    assert {r.region: r.status for r in status.collect()}[2] == "ok"


def test_hopeless_regions_stay_whole(spark):
    """Two loose triangles that cross cannot be mended: they stay and are counted; another mesh is mended none the less."""
    points, faces = sheet()
    points[27], points[36] = (4.6, 4.3, -0.9), (3.9, 4.1, -2.0)
    loose = [(0, 0, 0), (2, 0, 0), (0, 2, 0), (0.5, 0.4, -1), (0.5, 0.4, 1), (0.6, 3, 0)]
    # a huge triangle beside them has a grid of its own
    m = mesh(spark, [("good", points, faces), ("loose", loose, [(0, 1, 2), (3, 4, 5)]), ("z", [(0, 0, 0), (1e12, 0, 0), (0, 1e12, 0)], [(0, 1, 2)])])
    fixed, counts = repair.remove_self_intersections(m, passes=1)
    left = self_intersections(fixed).collect()
    assert {r.mesh_id for r in left} == {"loose"} and counts.after == len(left) == counts.abandoned
    assert counts.resolved + counts.abandoned + counts.failed == counts.before > counts.after and counts.failed == 0
    e = topology.edge_incidence(fixed.triangles)
    assert e.where("n_inc > 2").count() == 0 and {r.mesh_id: r["count"] for r in e.where("n_inc = 1").groupBy("mesh_id").count().collect()} == {"good": 28, "loose": 6, "z": 3}


def test_regions_grow_until_they_hold_the_pierced_triangle(spark):
    """Against a plain loop over rings, merged by what they share; two loose triangles that cross never reach each other."""
    points, faces = sheet(14)
    points[31], points[46], points[150] = (4.6, 3.3, -0.9), (4.9, 3.1, -2.0), (12.6, 11.3, -0.9)
    points[165] = (11.9, 11.1, -2.0)
    loose = [(0, 0, 0), (2, 0, 0), (0, 2, 0), (0.5, 0.4, -1), (0.5, 0.4, 1), (0.6, 3, 0)]
    m = mesh(spark, [("sheet", points, faces), ("loose", loose, [(0, 1, 2), (3, 4, 5)]), ("z", [(0, 0, 0), (1e12, 0, 0), (0, 1e12, 0)], [(0, 1, 2)])])
    corners = {r.tid: {r.a, r.b, r.c} for r in m.triangles.collect()}

    def grown(tids, rings):
        for _ in range(rings):
            touched = set().union(*(corners[t] for t in tids))
            tids = {t for t, c in corners.items() if c & touched}
        return tids

    most, beyond, around, sets = 2, 1, 1, []
    for r in self_intersections(m).collect():
        edge = {t for t, c in corners.items() if {r.v0, r.v1} <= c}
        reach = next((k for k in range(1, most + 1) if r.tid in grown(edge, k)), None)
        sets.append(grown(edge, (most if reach is None else reach + beyond) + around))
        if reach is None:
            sets.append(grown({r.tid}, beyond))
    whole = []
    for one in sets:
        apart = [w for w in whole if not w & one]
        whole = [*apart, one.union(*(w for w in whole if w & one))]
    got = {}
    for r in repair.self_intersecting_regions(m, None, most, beyond, around).collect():
        got.setdefault(r.region, set()).add(r.tid)
    assert got == {min(w): w for w in whole} and len(whole) >= 3


def test_closing_holes(spark):
    points, faces = box((0, 0, 0), (2, 2, 2))
    opened = mesh(spark, [("one", points, faces[1:]), ("two", points, faces[2:])])
    assert {r.mesh_id: r.n for r in loops.boundary_loops(opened.triangles).groupBy("mesh_id").agg(F.count("*").alias("n")).collect()} == {"one": 3, "two": 4}
    closed, status = repair.close_holes(opened)
    assert {r.status for r in status.collect()} == {"ok"}
    assert volume(closed) == pytest.approx({"one": 8.0, "two": 8.0})
    assert topology.hole_edges(closed.triangles).count() == 0


def test_bodies_and_components(spark):
    points, faces = box((0, 0, 0), (1, 1, 1))
    touching = [(x + 1, y + 1, z + 1) for x, y, z in points]
    joined = [*points, *[p for p in touching if p != (1, 1, 1)]]
    where = {p: k for k, p in enumerate(joined)}
    m = mesh(spark, [("m", joined, [*faces, *[tuple(where[touching[k]] for k in f) for f in faces]])])
    assert graph.bodies(m.triangles).select("body").distinct().count() == 1
    assert graph.edge_components(m.triangles).select("component").distinct().count() == 2


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components_equal_union_find(spark, edges):
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: root(x) for x in parent}


def test_region_growing(spark):
    n = 6
    faces = [t for y in range(n - 1) for x in range(n - 1) for i in [y * n + x] for t in ((i, i + 1, i + n), (i + 1, i + n + 1, i + n))]
    m = mesh(spark, [("m", [(x, y, 0) for y in range(n) for x in range(n)], faces)])
    t = m.triangles
    barrier = topology.edges(t).where("v0 BETWEEN 12 AND 17 AND v1 BETWEEN 12 AND 17").select("mesh_id", "v0", "v1").distinct()
    seed = t.where("tid = 0")
    assert graph.region_grow(t, seed, barrier, 1000).count() == 20
    small = graph.region_grow(t, seed, barrier, 6).count()
    assert 1 <= small <= 6
    assert graph.region_grow(t, seed, barrier.where("1 = 0"), 1000).count() == len(faces)


def test_renumbering(spark):
    m = mesh(spark, [("a", *box((0, 0, 0), (1, 1, 1))), ("b", *box((0, 0, 0), (2, 2, 2)))])
    small, remap = topology.remove(m, m.triangles.where("tid IN (0, 1, 12)").select("mesh_id", "tid"))
    assert small.triangles.groupBy("mesh_id").agg(F.min("tid").alias("low"), F.max("tid").alias("high")).orderBy("mesh_id").collect() == [("a", 0, 9), ("b", 0, 10)]
    assert remap.groupBy("mesh_id").agg(F.max("new").alias("n")).orderBy("mesh_id").collect() == [("a", 7), ("b", 7)]
    unique = topology.unique_ids(small)
    assert unique.triangles.select("tid").distinct().count() == 21
    assert volume(unique) == volume(small)
    blocks = topology.dense_numbers(m.vertices.select("mesh_id", "vid"), "vid", per_block=3).orderBy("vid").collect()
    assert [r.new for r in blocks] == [*range(8), *range(8)]


def test_planes_and_polylines(spark):
    rows = [("p", k, float(x), float(y), 2.0 * x - y + (0.5 if k % 2 else -0.5)) for k, (x, y) in enumerate((x, y) for x in range(4) for y in range(4))]
    points = spark.createDataFrame(rows, "g string, pos int, x double, y double, z double")
    fit = planes.best_fit_planes(points, "g")
    r = fit.first()
    assert (r.cx, r.cy) == (1.5, 1.5) and r.n == 16
    assert r.rms_error == pytest.approx(r.rms * 4)
    total = planes.deviation_stats(planes.deviations(points, fit, "g"), "g").first()
    assert total.total == pytest.approx(0, abs=1e-9) and total.stddev == pytest.approx(r.rms)
    square = spark.createDataFrame([("s", k, *p) for k, p in enumerate([(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (1.0, 1.0, 0.0), (0.0, 1.0, 0.0)])], "g string, pos int, x double, y double, z double")
    assert planes.polyline_length(square, "g", "pos").first().length == 4 and planes.polyline_length(square, "g", "pos", closed=False).first().length == 3
    assert [r.run for r in loops.divide(points, "g", 3).orderBy("pos").collect()] == [k // 5 for k in range(15)]


GOOD = "OFF\n# a comment\n4 4 0\n\n0 0 0\n1 0 0 # corner\n0 1 0\n0 0 1\n3 0 2 1\n3 0 1 3\n3 0 3 2\n3 1 2 3"


@pytest.mark.parametrize(
    ("text", "code"),
    [
        (GOOD.replace("OFF", "PLY"), "OFF_ERROR_BAD_HEADER"),
        (GOOD.replace("4 4 0", "4 0"), "OFF_ERROR_READING_COUNTS"),
        (GOOD.replace("0 1 0", "0 1"), "OFF_ERROR_READING_VERTICES"),
        (GOOD.replace("0 1 0", "1 0 0"), "OFF_READ_DUPLICATE_VERTICES"),
        (GOOD.replace("3 0 1 3", "4 0 1 3 2"), "OFF_NON_TRIANGULAR_FACE"),
        (GOOD.replace("3 0 1 3", "3 0 1"), "OFF_ERROR_READING_FACES"),
        (GOOD.replace("3 0 1 3", "3 0 1 4"), "OFF_FACE_INDEX_OUT_OF_RANGE"),
    ],
)
def test_text_errors(text, code):
    with pytest.raises(off.OffError) as error:
        off.parse(text)
    assert error.value.code == code


def test_text_meshes(spark, tmp_path):
    vertices, faces = off.parse(GOOD)
    assert (len(vertices), len(faces)) == (4, 4)
    colour = GOOD.replace("OFF", "COFF").replace("0 0 0\n1 0 0 # corner\n0 1 0\n0 0 1", "0 0 0 1 2 3 4\n1 0 0 1 2 3 4\n0 1 0 1 2 3 4\n0 0 1 1 2 3 4")
    assert off.parse(colour) == (vertices, faces)
    text = off.render(vertices, faces)
    assert off.render(*off.parse(text)) == text
    (tmp_path / "good.off").write_text(GOOD)
    (tmp_path / "bad.off").write_text("nothing")
    found = off.read_off(spark, str(tmp_path / "*.off"), permissive=True)
    assert volume(found) == pytest.approx({"good": 1 / 6})
    assert [tuple(r) for r in off.read_errors(spark, str(tmp_path / "*.off")).collect()] == [("bad", "OFF_ERROR_BAD_HEADER")]
    off.write_off(found, str(tmp_path / "out"))
    assert volume(off.read_off(spark, str(tmp_path / "out/mesh_id=*/*.txt"))) == pytest.approx({"good": 1 / 6})
    off.register(spark)
    assert spark.read.format("off").load(str(tmp_path / "good.off")).count() == 8


@pytest.fixture
def small_splits(spark):
    """Splits of 2000 bytes, and tasks that are not put together again."""
    wanted = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in wanted}
    for k, n in wanted.items():
        spark.conf.set(k, n)
    yield
    for k, n in kept.items():
        spark.conf.set(k, n)


def test_text_meshes_by_pieces(spark, tmp_path, small_splits):
    """Files read and written by several tasks each are what they are whole, with the same first errors."""
    colour = GOOD.replace("OFF", "COFF").replace("0 0 0\n1 0 0 # corner\n0 1 0\n0 0 1", "0 0 0 1 2 3 4\n1 0 0 1 2 3 4\n0 1 0 1 2 3 4\n0 0 1 1 2 3 4")
    swap = GOOD.replace
    texts = {
        "good": GOOD, "a b+c%20": colour, "windows": swap("\n", "\r\n"), "empty": "", "note": "# only\n\n", "header": swap("OFF", "PLY"), "counts": swap("4 4 0", "4 0"), "number": swap("0 1 0", "0 x 0"), "infinite": swap("0 1 0", "0 1e999 0"),
        "vertex": swap("0 1 0", "0 1"), "twice": swap("0 1 0", "1 -0 0"), "square": swap("3 0 1 3", "4 0 1 3 2"), "face": swap("3 0 1 3", "3 0 1"), "range": swap("3 0 1 3", "3 0 1 4"), "both": swap("3 0 1 3", "3 0 1 4").replace("1 0 0", "1 0"),
        "few_faces": swap("4 4 0", "4 9 0"), "few": "OFF\n5 0 0\n0 0 0\n", "none": "OFF\n0 0 0\n",
    }
    for name, text in texts.items():
        text = text.replace("# corner", "").replace("\n", f" # {700 * 'x'}\n").replace("\r #", " #") if name != "windows" else text
        (tmp_path / f"{name}.off").write_bytes(text.encode())
    path = str(tmp_path / "*.off")
    rows = lambda m: (sorted(map(tuple, m.vertices.collect())), sorted(map(tuple, m.triangles.collect())))
    for dedup in (False, True):
        want, got = (off.read_off(spark, path, dedup, permissive=True, pieces=p) for p in (False, True))
        assert rows(got) == rows(want)
        want, got = (sorted(map(tuple, off.read_errors(spark, path, dedup, pieces=p).collect())) for p in (False, True))
        assert got == want
    with pytest.raises(off.OffError):
        off.read_off(spark, path, pieces=True)
    n = 12
    grid = MeshFrame(
        spark.range(n * n).selectExpr("'a b%' AS mesh_id", "id AS vid", f"(id % {n}) / 7 AS x", f"(id div {n}) * 1e-7 AS y", "id * 123456.7D AS z"),
        spark.range(n * n - n - 1).selectExpr("'a b%' AS mesh_id", "id AS tid", "id AS a", "id + 1 AS b", f"id + {n} AS c"),
    )
    for precision in (None, 4):
        out = tmp_path / f"out{precision}"
        off.write_off(grid, str(out), precision, pieces=True)
        files = sorted(out.glob("mesh_id=*/*.txt"))
        assert len(files) > 1
        whole = off.parse("".join(f.read_text() for f in files))
        back = off.read_off(spark, f"{out}/mesh_id=*/*.txt", pieces=True)
        assert rows(back) == ([("a b%", k, *p) for k, p in enumerate(whole[0])], [("a b%", k, *t) for k, t in enumerate(whole[1])])
        if precision is None:
            assert rows(back) == rows(grid)
        assert whole[1] == off.parse(off.render([r[2:] for r in rows(grid)[0]], [r[2:] for r in rows(grid)[1]], precision))[1]
        assert whole[0] == off.parse(off.render([r[2:] for r in rows(grid)[0]], [], precision))[0]


def loop_edges(seed: int) -> list[tuple]:
    """Closed ways through few vertices, of two meshes with the same ids."""
    rng, edges = random.Random(seed), []
    for mesh_id in "ab":
        seen = set()
        for _ in range(4):
            way = rng.sample(range(40), rng.randint(3, 9))
            steps = list(zip(way, way[1:] + way[:1], strict=True))
            if not any((p, q) in seen or (q, p) in seen for p, q in steps):
                seen |= set(steps)
                edges += [(mesh_id, p, q) for p, q in steps]
    return edges


def test_loops_by_pointer_jumping(spark):
    """Loops that meet in vertices, loops alone, ends that do not close, edges twice: as walked edge by edge."""
    edges = loop_edges(3) + [("a", 100, 101), ("a", 101, 102), ("b", 7, 7), *loop_edges(3)[:2]]
    edges += [("ring", k * 37 % 500, (k + 1) * 37 % 500) for k in range(500)]
    edges = spark.createDataFrame(edges, "mesh_id string, p long, q long")
    for undirected in (False, True):
        walked, ranked, some = (sorted(map(tuple, loops.assemble(edges, undirected, small).collect())) for small in (10**6, 0, 100))
        assert walked == ranked == some
        assert [r[4] for r in walked].count("NOT_CLOSED") == 1
        ring = [r[3] for r in walked if r[0] == "ring"]
        assert ring == [k * 37 % 500 for k in range(500)]
        assert not loops.assemble(edges.where("p > 1000"), undirected, 0).count()


def test_streaming(spark, tmp_path):
    from facetflow.streaming.drops import watch

    folder = tmp_path / "in"
    folder.mkdir()
    seen = {}

    def sink(rows, number):
        seen.update({r.mesh_id: r.num_triangles for r in rows.collect()})

    for name in ("one", "two"):
        (folder / f"{name}.off").write_text(GOOD)
        watch(spark, str(folder), sink, str(tmp_path / "checkpoint")).awaitTermination(120)
        assert seen == {"one": 4} if name == "one" else seen == {"one": 4, "two": 4}
        if name == "one":
            seen_before = dict(seen)
    assert seen_before == {"one": 4}


def test_batch(spark, tmp_path):
    from facetflow.plans import batch

    for name, shift in (("a", 0), ("b", 1)):
        points, faces = box((shift, shift, shift), (shift + 2, shift + 2, shift + 2))
        (tmp_path / f"{name}.off").write_text(off.render(points, faces))
    results, rows = batch.run(spark, str(tmp_path / "*.off"), ("union", "difference"), repair=True)
    assert {k: round(v, 3) for k, v in volume(results["union"]).items()} == {"a~b": 15.0, "b~a": 15.0}
    total = {r.operation: r.two_manifold for r in batch.rollup(rows).collect()}
    assert total == {None: 4, "union": 2, "difference": 2}
    for r in rows.collect():
        assert (r.status, r.left_vertices, r.right_vertices, r.left_triangles, r.right_triangles) == ("OK", 8, 8, 12, 12)
        assert r.attempts >= 1 and r.seconds > 0 and r.num_triangles > 12


def test_fraction_of_meet_is_exact():
    """The documented example in rational arithmetic."""
    assert Fraction(538, 145) == Fraction(2) + 4 * Fraction(62, 145)


def test_inside_with_one_large_solid(spark):
    """A box of 2^20 beside many small ones: its triangles are entered in few cells."""
    solids = [box((-(2**19),) * 3, (2**19,) * 3)] + [box((2**21 + 3 * k, 0, 0), (2**21 + 3 * k + 1, 1, 1)) for k in range(40)]
    vertices = [("m", 8 * k + i, *p) for k, (points, _) in enumerate(solids) for i, p in enumerate(points)]
    triangles = [("m", 12 * k + j, *(8 * k + v for v in t), 1) for k, (_, faces) in enumerate(solids) for j, t in enumerate(faces)]
    grid = MeshFrame(
        spark.createDataFrame([(m, v, *map(int, p)) for m, v, *p in vertices], "mesh_id string, vid long, x long, y long, z long"),
        spark.createDataFrame(triangles, "mesh_id string, tid long, a long, b long, c long, label int"),
    )
    spots = {1: (5.25, 7.5, 0.125), 2: (2.0**20 + 0.5, 0.25, 0.5), 3: (2.0**21 + 3.25, 0.5, 0.375), 4: (2.0**21 + 2.5, 0.5, 0.375)}
    rays = spark.createDataFrame([("m", 0, patch, *p) for patch, p in spots.items()], "mesh_id string, label int, patch long, x double, y double, z double")
    found = {r.patch: r.inside for r in boolean._inside(rays, grid).collect()}
    assert {patch: found.get(patch, 0) for patch in spots} == {1: 1, 2: 0, 3: 1, 4: 0}


def test_components_are_not_broadcast(spark):
    """A row a node: joined by shuffle, however small the files are."""
    edges = spark.createDataFrame([(k, k + 1) for k in range(40) if k % 8], "a long, b long")
    found = graph.components(edges)
    assert {r.node: r.component for r in found.collect()} == {k: max(1, (k - 1) // 8 * 8 + 1) for k in range(1, 41)}
    plan = spark.range(50).withColumnRenamed("id", "node").join(found, "node")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_edges_of_meshes_are_contracted_before_the_steps(spark, monkeypatch):
    """Paths of many meshes are stars before the first step; one that is dealt over several tasks is found by the steps."""
    edges = [(f"m{m}", 1000 * m + k, 1000 * m + k + 1) for m in range(9) for k in range(99)]
    edges = spark.createDataFrame(edges, "mesh_id string, a long, b long")
    want = {1000 * m + k: 1000 * m for m in range(9) for k in range(100)}
    steps, stars = [], graph._are_stars
    monkeypatch.setattr(graph, "_are_stars", lambda e: steps.append(1) or stars(e))
    assert dict(map(tuple, graph.components(edges, within=["mesh_id"]).collect())) == want and len(steps) == 1
    monkeypatch.setattr(graph, "CHUNK", 40)
    assert dict(map(tuple, graph.components(edges, within=["mesh_id"]).collect())) == want


def test_small_meshes_are_joined_without_cells(spark, monkeypatch):
    """Boxes of meshes of few pairs meet by their key alone; a large mesh beside them by cells, with the same pairs."""
    from facetflow.operators import spatial

    draw = random.Random(5)
    rows = [(m, k, *p, *(x + 1 for x in p)) for m, n in (("s", 20), ("t", 30), ("large", 100)) for k in range(n) for p in [[draw.uniform(0, 6) for _ in range(3)]]]
    frame = spark.createDataFrame(rows, "mesh_id string, id long, " + ", ".join(f"{c} double" for c in spatial.BOX))
    side = lambda p, of: of.select("mesh_id", F.col("id").alias(p + "id"), *[F.col(c).alias(p + c) for c in spatial.BOX])
    pairs = lambda of: sorted(map(tuple, spatial.box_join(side("l_", of), side("r_", of), ["mesh_id"]).select("mesh_id", "l_id", "r_id").collect()))
    want = sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and all(a[2 + k] <= b[5 + k] and b[2 + k] <= a[5 + k] for k in range(3)))
    assert pairs(frame) == want
    monkeypatch.setattr(spatial, "_cell_join", None)
    assert pairs(frame.where("mesh_id <> 'large'")) == [r for r in want if r[0] != "large"]
