"""Repair of regions beside their mesh, against known geometry; a mesh gets in company what it gets alone."""

import math
import random

import pytest
from pyspark.sql import functions as F

from facetflow.operators import loops, region_repair, repair, spatial, stats, surfaces, topology
from facetflow.operators.spatial import grids, self_intersections
from facetflow.operators.tables import write_table
from tests.test_operators import box, mesh, sheet

LOOSE = ([(0, 0, 0), (2, 0, 0), (0, 2, 0), (0.5, 0.4, -1), (0.5, 0.4, 1), (0.6, 3, 0)], [(0, 1, 2), (3, 4, 5)])
HUGE = ([(0, 0, 0), (1e12, 0, 0), (0, 1e12, 0)], [(0, 1, 2)])


def folded(n=14):
    """A sheet with two vertices pulled through it, in its middle."""
    points, faces = sheet(n)
    at = (n // 2) * n + n // 2
    x, y = points[at][:2]
    points[at], points[at + n + 1] = (x + 1.6, y + 1.3, -0.9), (x + 0.9, y + 1.1, -2.0)
    return points, faces


def by_mesh(rows, column):
    return {r.mesh_id: r[column] for r in rows.collect()}


def test_self_intersections_alone_and_in_company(spark):
    """A triangle of coordinates up to 10^12 doesn't coarsen the grid of the meshes beside it."""
    alone = mesh(spark, [("folded", *folded()), ("loose", *LOOSE)])
    beside = mesh(spark, [("folded", *folded()), ("loose", *LOOSE), ("z", *HUGE)])
    count = lambda m: by_mesh(self_intersections(m).groupBy("mesh_id").agg(F.count("*").alias("n")), "n")
    assert count(alone) == count(beside) and set(count(alone)) == {"folded", "loose"}
    places = {r.mesh_id for r in repair.distinct_self_intersections(beside).collect()}
    assert places == {"folded", "loose"}


def test_grid_of_each_mesh(spark):
    wide = ([(0, 0, 0), (1e6, 0, 0), (0, 1e-6, 0)], [(0, 1, 2)])
    m = mesh(spark, [("folded", *folded()), ("wide", *wide), ("z", *HUGE)])
    assert by_mesh(grids(m), "status") == {"folded": "OK", "wide": "EXCESSIVE_DYNAMIC_RANGE_FOR_QUANTIZATION", "z": "OK"}
    assert by_mesh(grids(m), "exponent") == {"folded": 5, "wide": 21, "z": 41}


def test_largest_surface_of_each_mesh(spark):
    points, faces = sheet(4)
    far = [(x + 9, y, z) for x, y, z in points[:3]]
    m = mesh(spark, [("sound", [*points, *far], [*faces, (16, 17, 18)]), ("bad", [*points, (0.5, 0.2, 9.0)], [*faces, (0, 1, 16), (0, 1, 5)])])
    found = surfaces.largest_surface(m.triangles).groupBy("mesh_id", "status").count().collect()
    assert {(r.mesh_id, r.status, r["count"]) for r in found} == {("sound", "ok", len(faces)), ("bad", "NON_MANIFOLD_EDGE", 1)}


@pytest.fixture(scope="module")
def gaps(spark):
    """Regions of a sheet: a ring, a disk, two rings that touch nothing, one along the rim, and many small ones left out of a large one."""
    n = 24
    points, faces = sheet(n)
    m = mesh(spark, [("m", points, faces)])
    low = m.vertices.agg(F.min("vid")).first()[0]
    tids = {r.tid: [(v - low) % n for v in (r.a, r.b, r.c)] + [(v - low) // n for v in (r.a, r.b, r.c)] for r in m.triangles.collect()}
    at = lambda t: (min(tids[t][:3]), min(tids[t][3:]))
    cells = lambda x0, y0, x1, y1: {t for t in tids if x0 <= at(t)[0] < x1 and y0 <= at(t)[1] < y1}
    regions = {
        1: cells(1, 1, 7, 7) - cells(3, 3, 5, 5),
        2: cells(10, 1, 13, 4),
        3: cells(1, 10, 12, 16) - cells(2, 11, 5, 15) - cells(7, 12, 9, 14),
        4: cells(14, 5, 23, 15) - cells(14, 5, 15, 6) - cells(15, 7, 16, 8) - cells(17, 7, 18, 8) - cells(19, 7, 20, 8) - cells(15, 10, 16, 11) - cells(17, 10, 18, 11) - cells(19, 10, 20, 11),
    }
    rows = spark.createDataFrame([("m", k, t) for k, of in regions.items() for t in of], "mesh_id string, region long, tid long")
    full = {1: cells(1, 1, 7, 7), 2: regions[2], 3: cells(1, 10, 12, 16), 4: regions[4]}
    return m, rows, regions, full


def test_gaps_of_regions_are_filled(gaps):
    m, rows, regions, full = gaps
    found, status = region_repair.scrub_regions(m, rows)
    got = {}
    for r in found.collect():
        got.setdefault(r.region, set()).add(r.tid)
    assert got == full
    told = {r.region: (r.boundaries, r.filled, r.status) for r in status.collect()}
    assert told == {1: (2, 8, "ok"), 2: (1, 0, "ok"), 3: (3, 32, "ok"), 4: (7, 0, "TOO_MANY_BOUNDARIES")}


def test_gaps_over_the_limit_stay(gaps):
    """Of region 3 the smaller gap alone passes a limit of 10; no set of boundaries but both keeps below it with the larger one."""
    m, rows, regions, full = gaps
    found, status = region_repair.scrub_regions(m, rows.where("region in (1, 3)"), most_filled=10)
    told = {r.region: (r.boundaries, r.filled, r.status) for r in status.collect()}
    assert told == {1: (2, 8, "ok"), 3: (3, 8, "ok")}
    assert found.where("region = 3").count() == len(regions[3]) + 8


def holed(n=14):
    """The folded sheet with a hole in a corner of it."""
    points, faces = folded(n)
    return points, [f for f in faces if not set(f) & {2 * n + 2}]


def test_open_surfaces_are_repaired(spark):
    points, faces = sheet(14)
    rim = [*points]
    rim[15], rim[30] = (2.6, 2.3, -0.9), (1.9, 2.1, -2.0)  # next to the rim: a ring around it takes the outside boundary with it
    m = mesh(spark, [("folded", *folded()), ("holed", *holed()), ("rim", rim, faces), ("sound", points, faces), ("closed", *box((0, 0, 0), (1, 1, 1))), ("z", *HUGE)])
    fixed, status = region_repair.repair_surfaces(m)
    told = {r.mesh_id: r for r in status.collect()}
    assert {k: r.status for k, r in told.items()} == {"folded": "ok", "holed": "ok", "rim": "OUTSIDE_BOUNDARY_BROKEN", "sound": "CLEAN", "closed": "CLEAN", "z": "CLEAN"}
    assert all(told[k].before > 0 and told[k].after == 0 and told[k].filled == told[k].holes > 0 for k in ("folded", "holed"))
    edge = lambda x: {(r.mesh_id, r.v0, r.v1) for r in topology.edge_incidence(x.triangles).where("n_inc = 1").collect()}
    assert edge(fixed) == edge(m)
    assert topology.edge_incidence(fixed.triangles).where("n_inc > 2 AND mesh_id <> 'rim'").count() == 0
    left = by_mesh(self_intersections(fixed).groupBy("mesh_id").agg(F.count("*").alias("n")), "n")
    assert set(left) == {"rim"}
    whole = by_mesh(stats.topological_statistics(topology.compact(fixed)[0].triangles), "euler")
    assert whole["folded"] == 1 and whole["holed"] == 0
    # each mesh gets what it gets alone
    _, alone = region_repair.repair_surfaces(mesh(spark, [("folded", *folded())]))
    assert tuple(alone.first()) == tuple(told["folded"])


def test_a_defect_on_its_patch(spark):
    m = mesh(spark, [("folded", *folded(20)), ("loose", *LOOSE)])
    found = repair.distinct_self_intersections(m)
    patches, status = region_repair.repair_on_patches(m, found, inner=3, outer=8)
    told = {r.mesh_id: r for r in status.collect()}
    assert told["folded"].status == "ok" and told["folded"].before > 0 == told["folded"].after and told["folded"].filled == told["folded"].holes == 1
    assert told["loose"].status == "NO_BOUNDARY"
    shape = stats.topological_statistics(topology.compact(patches)[0].triangles).collect()
    assert [(r.euler, r.num_non_manifold == r.num_hole_edges if hasattr(r, "num_hole_edges") else True) for r in shape] == [(1, True)]


def test_trials_leave_the_mesh(spark):
    """The region of a sheet's defect is repaired beside it; a huge triangle in its company changes nothing."""
    m = mesh(spark, [("folded", *folded(24)), ("z", *HUGE)])
    before = {tuple(r) for r in m.triangles.collect()}
    patches, status = region_repair.try_regions(m)
    assert {tuple(r) for r in m.triangles.collect()} == before
    rows = status.collect()
    assert [(r.mesh_id, r.status, r.after) for r in rows] == [("folded", "ok", 0)]
    assert rows[0].before == self_intersections(m).count() and math.isclose(rows[0].triangles, patches.triangles.count() + rows[0].removed + rows[0].loose, rel_tol=0.2)


def test_smoothing_all_loops_at_once(spark):
    """Ragged rims and holes of two meshes: what goes are triangles off the loop, and nothing is left to go."""
    rng = random.Random(4)
    points, faces = sheet(9)
    ragged = [f for f in faces if not set(f) & {0, 8, 40}]
    m = mesh(spark, [("ragged", points, ragged), ("chewed", points, [f for f in faces if min(f) > 12 or rng.random() < 0.7])])
    found = loops.boundary_loops(m.triangles).where("status = 'ok'")
    found, _ = write_table(found)
    rows = lambda of: {k: [v for _, v in sorted((r.pos, r.vid) for r in of if (r.mesh_id, r.loop_id) == k)] for k in {(r.mesh_id, r.loop_id) for r in of}}
    before, after = rows(found.collect()), rows(loops.smooth_loops(found, m.triangles).collect())
    tris = [(r.mesh_id, frozenset((r.a, r.b, r.c))) for r in m.triangles.collect()]
    assert before.keys() == after.keys() and any(len(before[k]) > len(after[k]) for k in before)
    for k, loop in after.items():
        old, kept = before[k], set(loop)
        assert loop == [v for v in old if v in kept] and len(loop) >= 3
        corners = [frozenset((loop[i - 1], loop[i], loop[(i + 1) % len(loop)])) for i in range(len(loop))]
        used = [t for name, t in tris if name == k[0]]
        # a corner may stay only where its triangle was cut off already or the loop is a triangle
        cut = len(old) - len(loop)
        assert len(loop) == 3 or sum(c in used for c in corners) <= cut
        # the same number goes as one after another
        assert len(loop) == len(loops.smooth(old, [tuple(t) for t in used]))
    assert loops.smooth_loops(found.limit(0), m.triangles).collect() == []


def crossing_boxes(spark, n=14):
    """Boxes each of which crosses all others: intersections grow with the square of their number."""
    rng = random.Random(5)
    bodies = [box([rng.uniform(-0.4, 0.4) for _ in range(3)], [rng.uniform(1, 1.4) for _ in range(3)]) for _ in range(n)]
    points = [p for own, _ in bodies for p in own]
    return mesh(spark, [("m", points, [tuple(8 * k + v for v in t) for k, (_, faces) in enumerate(bodies) for t in faces])])


def test_candidates_are_not_shuffled(spark, monkeypatch):
    """Boxes are dealt by cells, pairs stay where they are found; a crowded cell dealt over tasks gives the same pairs."""
    m = crossing_boxes(spark)
    whole = self_intersections(m)
    assert "REPARTITION" not in whole._jdf.queryExecution().executedPlan().toString()
    rows = sorted(map(tuple, whole.collect()))
    monkeypatch.setattr(spatial, "CROWDED", 50)
    assert sorted(map(tuple, self_intersections(m).collect())) == rows and len(rows) > 14 * 30


@pytest.mark.parametrize("operator", ["distinct_self_intersections", "self_intersecting_regions"])
def test_intersections_are_reduced_before_they_are_written(spark, monkeypatch, operator):
    """What is written first has a row an edge or a triangle, not one an intersection; the boxes are one place, and a region each."""
    m, sizes = crossing_boxes(spark), []
    write = repair.write_table
    monkeypatch.setattr(repair, "write_table", lambda df, **o: (out := write(df, **o), sizes.append(out[0].count()))[0])
    rows = getattr(repair, operator)(m).collect()
    assert sizes[0] <= 14 * 30 < self_intersections(m).count()
    assert len(rows) == (14 if operator.startswith("distinct") else 14 * 12)


def test_removals_of_equal_triangles_are_judged_once(spark, monkeypatch):
    """Edges that pierce share vertices: what is removed at a vertex is judged once, with what each patch's own trial says."""
    m = mesh(spark, [("a", *folded()), ("b", *folded(10))])
    judged, judge = [], repair.judge_removals
    monkeypatch.setattr(repair, "judge_removals", lambda *a, **k: judged.append((a[1], judge(*a, **k))) or judged[-1][1])
    fixed, counts = repair.remove_self_intersections(m)
    assert counts.after == 0 < counts.before
    removals, (status, _) = judged[0]
    regions = [tuple(sorted(r.tids)) for r in removals.groupBy("mesh_id", "region").agg(F.collect_list("tid").alias("tids")).collect()]
    assert len(regions) == len(set(regions)) < counts.before * repair.REMOVALS
    # each trial as a mesh of its own, all of its triangles against each other
    grid = repair.Quantizer(exponent=6)
    plain, patches = judge(m, removals)
    said = {r.region: r.status for r in judge(m, removals, quantizer=grid)[0].collect()}
    around = repair._around(repair.G.triangle_vertices(m.triangles), removals, 3)
    around = around.join(removals, ["mesh_id", "region", "tid"], "left_anti").join(m.triangles, ["mesh_id", "tid"]).select("region", "tid", "a", "b", "c")
    trial = around.union(patches.select("region", -1 - F.col("piece"), "a", "b", "c")).select(F.col("region").cast("string").alias("mesh_id"), F.col("tid").cast("long").alias("tid"), "a", "b", "c")
    trial, _ = write_table(trial)
    used = trial.select("mesh_id", F.explode(F.array("a", "b", "c")).alias("vid")).distinct().join(m.vertices.drop("mesh_id"), "vid").select("mesh_id", "vid", "x", "y", "z")
    crossed = {int(r.mesh_id) for r in self_intersections(type(m)(used, trial), grid).select("mesh_id").distinct().collect()}
    want = {r.region: "SELF_INTERSECTING_PATCH" if r.status == "ok" and r.region in crossed else r.status for r in plain.collect()}
    assert said == want and {"ok", "SELF_INTERSECTING_PATCH"} <= set(want.values())


def test_boxes_are_paired_on_their_own_levels(spark, monkeypatch):
    """One huge box among small ones: small ones don't meet each other again in its cells."""
    draw = random.Random(3)
    small = [[draw.uniform(0, 60) for _ in range(3)] for _ in range(1500)]
    rows = [(k, *p, *(x + 1 for x in p)) for k, p in enumerate(small)] + [(1500, 0.0, 0.0, 0.0, 64.0, 64.0, 64.0)]
    frame = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in spatial.BOX))
    side = lambda p: frame.select(F.lit("m").alias("mesh_id"), F.col("id").alias(p + "id"), *[F.col(c).alias(p + c) for c in spatial.BOX])
    seen, dealt = [], spatial._dealt
    monkeypatch.setattr(spatial, "_dealt", lambda left, right, same: seen.append((left, right, same)) or dealt(left, right, same))
    got = sorted((r.l_id, r.r_id) for r in spatial.box_join(side("l_"), side("r_"), ["mesh_id"]).collect())
    meets = lambda a, b: all(a[1 + k] <= b[4 + k] and b[1 + k] <= a[4 + k] for k in range(3))
    assert got == [(a[0], b[0]) for a in rows for b in rows if meets(a, b)]
    left, right, same = seen[0]
    assert left.select(*same).join(right.select(*same), same).count() < 200_000  # 1501 squared and more, if the huge box's cells pair all


def test_rings_read_only_fronts(spark, monkeypatch):
    """Rings as walked triangle by triangle; no round reads the rounds before it, nor the mesh."""
    m = mesh(spark, [("a", *sheet(12)), ("b", *sheet(5)), ("z", *HUGE)])
    of = {(r.mesh_id, r.tid): {r.a, r.b, r.c} for r in m.triangles.collect()}
    some = {k: sorted(t for mesh_id, t in of if mesh_id == k) for k in "abz"}
    seeds = [("a", 1, some["a"][100]), ("a", 1, some["a"][101]), ("a", 2, some["a"][0]), ("b", 1, some["b"][3]), ("b", 1, some["b"][3]), ("z", 3, some["z"][0])]
    leaves, write = [], region_repair.write_table
    monkeypatch.setattr(region_repair, "write_table", lambda df: leaves.append(df._jdf.queryExecution().optimizedPlan().collectLeaves().size()) or write(df))
    corners = region_repair.G.triangle_vertices(m.triangles)
    for layers in (0, 1, 7):
        got = sorted(map(tuple, region_repair.rings(corners, spark.createDataFrame(seeds, "mesh_id string, region long, tid long"), layers).collect()))
        want = {(k, region, t): 0 for k, region, t in seeds}
        for layer in range(1, layers + 1):
            near = {(k, region, v) for k, region, t in want for v in of[k, t]}
            want |= {(k, region, t): layer for k, region in {x[:2] for x in want} for t in some[k] if (k, region, t) not in want and any((k, region, v) in near for v in of[k, t])}
        assert got == sorted((*x, layer) for x, layer in want.items())
    assert max(leaves) <= 5


def test_meshes_of_some_hundred_triangles_need_no_cells(spark, monkeypatch):
    """They are joined by mesh; cells, and crowded cells dealt over tasks, give the same pairs."""
    for m in (mesh(spark, [("a", *folded()), ("b", *folded(12))]), crossing_boxes(spark)):
        entered, cells = [], spatial._cell_join
        with monkeypatch.context() as patch:
            patch.setattr(spatial, "_cell_join", lambda *a: entered.append(a) or cells(*a))
            rows = sorted(map(tuple, self_intersections(m).collect()))
            assert rows and not entered
            for few in (100_000, 0):  # the larger sheet by cells and the smaller by mesh, then both by cells
                patch.setattr(spatial, "FEW", few)
                assert sorted(map(tuple, self_intersections(m).collect())) == rows
            assert entered
            patch.setattr(spatial, "CROWDED", 50)
            assert sorted(map(tuple, self_intersections(m).collect())) == rows


def test_surfaces_to_repair_are_read_once(spark):
    """What vertices are made of is computed for their grid's exponent and for the table that all steps read, not in each step."""
    m = mesh(spark, [("folded", *folded())])
    read = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda z: (read.add(1), z)[1], "double")
    _, status = region_repair.repair_surfaces(type(m)(m.vertices.withColumn("z", seen("z")), m.triangles))
    assert status.first().status == "ok" and read.value <= 3 * m.vertices.count()


@pytest.mark.parametrize("operator", ["distinct_self_intersections"])
def test_edges_with_a_partner_are_not_compared_on(spark, monkeypatch, operator):
    """By blocks the rows are the same, and the last block is compared with the edges that met none before."""
    m, joined, join = crossing_boxes(spark), [], spatial.box_join
    whole = sorted(map(tuple, getattr(repair, operator)(m).collect()))
    first = {}
    for r in self_intersections(m).collect():
        first[r.v0, r.v1] = min(first.get((r.v0, r.v1), (1 << 60,)), (r.tid, r.edge_tid))
    monkeypatch.setattr(spatial, "BLOCK", 10, raising=False)
    monkeypatch.setattr(spatial, "box_join", lambda left, right, keys, finer=0: joined.append((keys, left.count(), right.count())) or join(left, right, keys, finer))
    assert sorted(map(tuple, getattr(repair, operator)(m).collect())) == whole
    sizes = [n for keys, *n in joined if keys == ["mesh_id"]]
    assert len(sizes) > 1 and sum(a * b for a, b in sizes) < sizes[0][0] * 14 * 12
    assert {(r.v0, r.v1): (r.tid, r.edge_tid) for r in spatial.first_intersections(m).collect()} == first
