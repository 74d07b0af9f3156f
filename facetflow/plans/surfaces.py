"""Queries of surfaces, boundaries, self-intersections, exact triple points and text output."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetflow.functions.quantize import Quantizer
from facetflow.functions.vec import V3, Triangle
from facetflow.operators import graph as G
from facetflow.operators import loops, planes, repair, spatial, surfaces
from facetflow.operators import topology as T
from facetflow.operators.tables import write_table
from facetflow.plans.relational import _POLY, _SQL_TWO, _polygons, _two
from facetflow.plans.scalar import SQL, SQL_VERDICT, _points, query, quoted, sql_signs
from facetflow.sources import off
from facetflow.sources.derived import SQL_BOXES, SQL_HEIGHT, MeshFrame, boxes, height_field, table
from facetflow.streaming.drops import event_windows as windows


@query(f"""WITH {SQL_BOXES} SELECT mesh_id, count(*) AS n_vertices, max(greatest(abs(x), abs(y), abs(z))) AS max_abs, min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z FROM bv GROUP BY mesh_id""")
def mesh_metrics(spark, sf_dir):
    return surfaces.mesh_metrics(boxes(spark, sf_dir))


@query(f"""WITH {SQL_HEIGHT}, g AS (SELECT vid, CAST(trunc(x * 262144) AS HUGEINT) AS x, CAST(trunc(y * 262144) AS HUGEINT) AS y, CAST(trunc(z * 262144) AS HUGEINT) AS z FROM hv)
SELECT v0, v1, CAST((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z) AS BIGINT) AS length2 FROM (SELECT DISTINCT v0, v1 FROM he) JOIN g AS p ON p.vid = v0 JOIN g AS q ON q.vid = v1""")
def quantized_edges(spark, sf_dir):
    rows = surfaces.quantized_edges(height_field(spark, sf_dir), Quantizer(exponent=12))
    return rows.select("v0", "v1", F.col("length2").cast("bigint").alias("length2"))


@query(f"""WITH {SQL_HEIGHT}, c AS (SELECT tid, unnest([a, b, c]) AS v FROM ht) SELECT p.tid, q.tid AS other, count(*) AS shared, min(v) AS first_vertex FROM c AS p JOIN c AS q USING (v) WHERE p.tid < q.tid GROUP BY p.tid, q.tid""")
def shared_vertices(spark, sf_dir):
    """Pairs of triangles that share vertices, how many, and the first."""
    c = G.triangle_vertices(height_field(spark, sf_dir).triangles)
    o = c.withColumnRenamed("tid", "other")
    return c.join(o, ["mesh_id", "vid"]).where("tid < other").groupBy("tid", "other").agg(F.count("*").alias("shared"), F.min("vid").alias("first_vertex"))


@query(f"WITH {SQL_HEIGHT} SELECT tid * 10 + 7 AS uid, tid, a, b, c FROM ht WHERE tid % 11 = 4")
def uid_lookup(spark, sf_dir):
    t = height_field(spark, sf_dir).triangles.withColumn("uid", F.col("tid") * 10 + 7)
    wanted = t.where("tid % 11 = 4").select("uid")
    return T.by_uid(t, wanted).select("uid", "tid", "a", "b", "c")


@query(f"""WITH {SQL_HEIGHT}, m AS (SELECT max(vid) AS top FROM hv) SELECT '0' AS loop_id, 0::BIGINT AS tid, 4::BIGINT AS holes, true AS outside, CAST(2 * 19 + 2 * (top // 20) AS BIGINT) AS n FROM m""")
def outside_boundary(spark, sf_dir):
    """A surface with four triangles taken out: its longest boundary, the triangle at its first edge, and how many holes there are."""
    mesh = height_field(spark, sf_dir)
    mesh = MeshFrame(mesh.vertices, mesh.triangles.where("tid NOT IN (88, 176, 264, 352)"))
    found, _ = write_table(loops.boundary_loops(mesh.triangles))
    length = surfaces.boundary_lengths(mesh, found)
    owner = surfaces.loop_owners(mesh, found).select("loop_id", "tid")
    holes = length.agg((F.count("*") - 1).alias("holes"))
    return length.where("outside").join(owner, "loop_id").select("loop_id", "tid", "outside", "n").join(F.broadcast(holes))


@query(f"WITH {SQL_BOXES} SELECT mesh_id, min(tid // 12) * 12 + j AS tid FROM bt JOIN (SELECT unnest(range(12)) AS j) ON true GROUP BY mesh_id, j")
def largest_surface(spark, sf_dir):
    """Of each mesh's boxes, which are equally large, the first."""
    return surfaces.largest_surface(boxes(spark, sf_dir).triangles).select("mesh_id", "tid")


@query(f"""WITH {SQL_HEIGHT}, m AS (SELECT tid // 10 - k AS set_id FROM ht, (VALUES (0), (1)) AS o(k) WHERE k = 0 OR tid % 10 < 5) SELECT DISTINCT set_id, set_id // 3 * 3 AS merged FROM m WHERE set_id >= 0 AND set_id % 3 <> 2""")
def merge_sets(spark, sf_dir):
    """Sets of triangles, each of which overlaps the next; every third is left out, so that two hang together each time."""
    t = height_field(spark, sf_dir).triangles
    both = F.when(F.col("tid") % 10 < 5, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    sets = t.select(F.expr("tid div 10").alias("set_id"), F.explode(both).alias("k"), F.col("tid").alias("member")).select((F.col("set_id") - F.col("k")).alias("set_id"), "member")
    return G.merge_sets(sets.where("set_id >= 0 AND set_id % 3 <> 2"))


@query(f"WITH {_POLY} SELECT label, pos, pos // (n // 4) AS run FROM q WHERE pos // (n // 4) < 4")
def divide_boundary(spark, sf_dir):
    return loops.divide(_polygons(spark, sf_dir).drop("n"), "label", 4).select("label", "pos", "run")


def _top_planes(mesh: MeshFrame):
    t = mesh.triangles.where("tid % 12 NOT IN (2, 3)")
    points = loops.with_coordinates(loops.boundary_loops(t), mesh.vertices).withColumn("body", F.expr("vid div 8"))
    fit = planes.best_fit_planes(points, "body")
    return fit.select("body", "n", *[F.round(f"{p}{n}", 6).alias(f"{p}{n}") for p in "cn" for n in "xyz"])


@query(f"""WITH {SQL_BOXES} SELECT vec_id AS body, 4::BIGINT AS n, round(c0, 6) AS cx, round(c1, 6) AS cy, round(c2 + half, 6) AS cz, 0.0::DOUBLE AS nx, 0.0::DOUBLE AS ny, 1.0::DOUBLE AS nz FROM be""")
def loop_planes(spark, sf_dir):
    """Centroids and best-fit planes of the boundaries of all boxes, without their tops."""
    return _top_planes(boxes(spark, sf_dir))


@query(f"""WITH {SQL_BOXES}, v AS (SELECT vid, mesh_id, CAST(x * 16 AS HUGEINT) AS x, CAST(y * 16 AS HUGEINT) AS y, CAST(z * 16 AS HUGEINT) + vid % 16 AS z FROM bv),
e AS (SELECT mesh_id, least(p, q) AS v0, greatest(p, q) AS v1, min(tid) AS edge_tid FROM (SELECT mesh_id, tid, a AS p, b AS q FROM bt UNION ALL SELECT mesh_id, tid, b, c FROM bt UNION ALL SELECT mesh_id, tid, c, a FROM bt) GROUP BY 1, 2, 3),
g AS (SELECT e.mesh_id, edge_tid, v0, v1, p.x AS px, p.y AS py, p.z AS pz, q.x AS qx, q.y AS qy, q.z AS qz FROM e JOIN v AS p ON p.vid = v0 JOIN v AS q ON q.vid = v1),
t AS (SELECT bt.mesh_id, tid, a.vid AS va, b.vid AS vb, c.vid AS vc, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS "by", b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz FROM bt JOIN v AS a ON a.vid = bt.a JOIN v AS b ON b.vid = bt.b JOIN v AS c ON c.vid = bt.c),
m AS (SELECT v0, v1, edge_tid, tid, {", ".join(f"{quoted(c + n)}" for c in "pqabc" for n in "xyz")} FROM g JOIN t ON g.mesh_id = t.mesh_id AND va NOT IN (v0, v1) AND vb NOT IN (v0, v1) AND vc NOT IN (v0, v1)
  {" ".join(f"AND least(p{n}, q{n}) <= greatest(a{n}, {quoted('b' + n)}, c{n}) AND least(a{n}, {quoted('b' + n)}, c{n}) <= greatest(p{n}, q{n})" for n in "xyz")}),
s AS (SELECT v0, v1, edge_tid, tid, {sql_signs('p', 'q', 'a', 'b', 'c')} FROM m), r AS (SELECT v0, v1, edge_tid, tid, {SQL_VERDICT} FROM s)
SELECT v0, v1, edge_tid, tid FROM r WHERE near AND NOT zero""")
def self_intersections(spark, sf_dir):
    """Edges of a mesh of many boxes that pierce its own triangles, by the grid join and the exact test."""
    mesh = boxes(spark, sf_dir)
    v = mesh.vertices.select("mesh_id", "vid", (F.col("x") * 16).alias("x"), (F.col("y") * 16).alias("y"), (F.col("z") * 16 + F.col("vid") % 16).alias("z"))
    return spatial.self_intersections(MeshFrame(v, mesh.triangles), Quantizer(exponent=30)).select("v0", "v1", "edge_tid", "tid")


@query(f"""WITH {_SQL_TWO}, s AS (SELECT pr.*, {sql_signs('p', 'q', 'a', 'b', 'c')} FROM pr), r AS (SELECT *, {SQL_VERDICT} FROM s),
n AS (SELECT v0, v1, tid, CAST(pz AS DOUBLE) AS p, CAST(qz AS DOUBLE) AS q,
  CAST((ax - px) * (("by" - ay) * (cz - az) - (bz - az) * (cy - ay)) + (ay - py) * ((bz - az) * (cx - ax) - (bx - ax) * (cz - az)) + (az - pz) * ((bx - ax) * (cy - ay) - ("by" - ay) * (cx - ax)) AS DOUBLE) AS sp,
  CAST((ax - qx) * (("by" - ay) * (cz - az) - (bz - az) * (cy - ay)) + (ay - qy) * ((bz - az) * (cx - ax) - (bx - ax) * (cz - az)) + (az - qz) * ((bx - ax) * (cy - ay) - ("by" - ay) * (cx - ax)) AS DOUBLE) AS sq FROM r WHERE near AND NOT zero)
SELECT v0, v1, tid, round(p + (q - p) * (sp / (sp - sq)), 3) AS z FROM n""")
def intersection_points(spark, sf_dir):
    pairs = spatial.edge_triangle_pairs(_two(spark, sf_dir), other=True).where("meets")
    spot = spatial.intersection_point(V3.of("p"), V3.of("q"), Triangle.of())
    return pairs.select("v0", "v1", "tid", F.round(spot.z, 3).alias("z"))


_T27 = [f"p{p}{n}" for p in range(9) for n in "xyz"]


def _sql_plane(k: int) -> str:
    a, b, c = (f"p{3 * k + j}" for j in range(3))
    n = [f"(({b}{y} - {a}{y}) * ({c}{z} - {a}{z}) - ({b}{z} - {a}{z}) * ({c}{y} - {a}{y}))" for _, y, z in ("xyz", "yzx", "zxy")]
    return ", ".join([*[f"{e} AS n{k}{d}" for e, d in zip(n, "xyz", strict=True)], f"{n[0]} * {a}x + {n[1]} * {a}y + {n[2]} * {a}z AS d{k}"])


def _sql_det(rows: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = rows
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


_ROWS3 = [[f"n{k}{d}" for d in "xyz"] for k in range(3)]


def _sql_sides() -> str:
    """For each triangle and side, on which side of it the point is, times the determinant squared's sign: products of integers."""
    out = []
    for k in range(3):
        for j in range(3):
            q, r = f"p{3 * k + j}", f"p{3 * k + (j + 1) % 3}"
            e = [f"({r}{d} - {q}{d})" for d in "xyz"]
            f = [f"(m{d} - {q}{d} * w)" for d in "xyz"]
            cross = [f"({e[y]} * {f[z]} - {e[z]} * {f[y]})" for y, z in ((1, 2), (2, 0), (0, 1))]
            out.append(f"CAST(sign(({' + '.join(f'n{k}{d} * {c}' for d, c in zip('xyz', cross, strict=True))}) * sign(w)) AS INTEGER) AS s{k}{j}")
    return ", ".join(out)


@query(f"""WITH p AS (SELECT vec_id, {", ".join(f"CAST(floor(CAST(embedding[{3 * p + k + 1}] AS DOUBLE) * 64) AS HUGEINT) AS p{p}{n}" for p in range(9) for k, n in enumerate("xyz"))} FROM embeddings),
n AS (SELECT *, {_sql_plane(0)}, {_sql_plane(1)}, {_sql_plane(2)} FROM p),
m AS (SELECT *, {_sql_det(_ROWS3)} AS w, {_sql_det([[f"d{k}", r[1], r[2]] for k, r in enumerate(_ROWS3)])} AS mx, {_sql_det([[r[0], f"d{k}", r[2]] for k, r in enumerate(_ROWS3)])} AS my,
  {_sql_det([[r[0], r[1], f"d{k}"] for k, r in enumerate(_ROWS3)])} AS mz FROM n),
s AS (SELECT vec_id, w, mx, {_sql_sides()} FROM m), r AS (SELECT *, least({", ".join(f"s{k}{j}" for k in range(3) for j in range(3))}) AS worst FROM s)
SELECT vec_id, CASE WHEN w = 0 OR worst = 0 THEN 'degenerate' WHEN worst > 0 THEN 'meets' ELSE 'empty' END AS status, CASE WHEN w <> 0 AND worst > 0 THEN round(CAST(mx AS DOUBLE) / CAST(w AS DOUBLE), 6) END AS x FROM r""")
def triple_points(spark, sf_dir):
    rows = surfaces.triple_points(_points(spark, sf_dir, 9, 64).drop("label"), _T27)
    return rows.select("vec_id", "status", F.round("x", 6).alias("x"))


@query(f"""WITH {SQL_HEIGHT}, i AS (SELECT v0, v1, count(*) AS n FROM he GROUP BY ALL)
SELECT true AS had_some, 0::BIGINT AS after, 0::BIGINT AS abandoned, 0::BIGINT AS failed, count(*) FILTER (n = 1) AS num_hole_edges, 0::BIGINT AS num_non_manifold,
  (SELECT count(DISTINCT v) FROM (SELECT unnest([v0, v1]) AS v FROM he)) - count(*) + (SELECT count(*) FROM ht) AS euler FROM i""")
def repair_self_intersections(spark, sf_dir):
    """A surface with two vertices pulled through it in every eighth row, repaired: nothing is left, the boundary and the Euler number are as before."""
    mesh = height_field(spark, sf_dir)
    last = mesh.vertices.agg(F.max("vid")).first()[0] or 0
    column, row, inside = F.col("vid") % 20, F.expr("vid div 20") % 8, F.col("vid") + 100 <= last
    pulled = lambda a, b: F.when((column == 7) & (row == 3) & inside, F.lit(a)).when((column == 8) & (row == 4) & inside, F.lit(b)).otherwise(F.lit(0.0))
    v = mesh.vertices.select("mesh_id", "vid", (F.col("x") + pulled(1.6, -0.1)).alias("x"), (F.col("y") + pulled(1.3, 0.1)).alias("y"), (F.col("z") / 8192 - pulled(0.9, 2.0)).alias("z"))
    fixed, counts = repair.remove_self_intersections(MeshFrame(v, mesh.triangles))
    e = T.edge_incidence(fixed.triangles).agg(F.count_if(F.col("n_inc") == 1).alias("num_hole_edges"), F.count_if(F.col("n_inc") > 2).alias("num_non_manifold"), F.count("*").alias("e"))
    found = e.crossJoin(fixed.triangles.agg(F.count("*").alias("f"))).crossJoin(fixed.vertices.agg(F.count("*").alias("v")))  # one row each
    left = [F.lit(getattr(counts, n)).cast("long").alias(n) for n in ("after", "abandoned", "failed")]
    return found.select(F.lit(counts.before > 0).alias("had_some"), *left, "num_hole_edges", "num_non_manifold", (F.col("v") - F.col("e") + F.col("f")).alias("euler"))


@query(f"WITH {_POLY} SELECT label, pos, CAST(CAST(x AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(y AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(z AS BIGINT) AS VARCHAR) AS line FROM q")
def polyline_text(spark, sf_dir):
    p = _polygons(spark, sf_dir).select("label", "pos", *[F.col(n).cast("bigint").alias(n) for n in "xyz"])
    return off.polyline_text(p, "label")


@query(f"WITH {SQL_HEIGHT} SELECT tid, '(' || a || ', ' || b || ', ' || c || ')' AS triangle, 'Edge' || ['AB', 'BC', 'CA'][CAST(tid % 3 AS INTEGER) + 1] AS edge FROM ht")
def debug_text(spark, sf_dir):
    t = height_field(spark, sf_dir).triangles
    return t.select("tid", off.tuple_text(*map(F.col, "abc")).alias("triangle"), off.slot_name(F.col("tid") % 3).alias("edge"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    """The windowed aggregate of the event stream, run over the table as one batch."""
    rows = windows(table(spark, sf_dir, "events"))
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(f"""SELECT 'b' || (box % 4) AS mesh_id, box * 12 AS region, 12::BIGINT AS triangles FROM (SELECT DISTINCT unnest([edge_tid // 12, tid // 12]) AS box FROM ({SQL["self_intersections"]}))""")
def self_intersecting_regions(spark, sf_dir):
    """Boxes that pierce others or are pierced: growth ends with the box, which is a region whole."""
    mesh = boxes(spark, sf_dir)
    v = mesh.vertices.select("mesh_id", "vid", (F.col("x") * 16).alias("x"), (F.col("y") * 16).alias("y"), (F.col("z") * 16 + F.col("vid") % 16).alias("z"))
    found = repair.self_intersecting_regions(MeshFrame(v, mesh.triangles), Quantizer(exponent=30))
    return found.groupBy("mesh_id", "region").agg(F.count("*").alias("triangles"))


@query(f"""WITH RECURSIVE {SQL_BOXES}, s AS ({SQL["self_intersections"]}),
n AS (SELECT DISTINCT v0, v1, bt.tid FROM s JOIN bt ON bt.tid // 12 = v0 // 8 AND (v0 IN (a, b, c) OR v1 IN (a, b, c))),
l AS (SELECT DISTINCT p.v0, p.v1, q.v0 AS w0, q.v1 AS w1 FROM n AS p JOIN n AS q USING (tid)),
r AS (SELECT * FROM l UNION SELECT r.v0, r.v1, l.w0, l.w1 FROM r JOIN l ON r.w0 = l.v0 AND r.w1 = l.v1)
SELECT v0, v1, min(edge_tid) AS edge_tid, min(tid) AS tid FROM s WHERE (v0, v1) IN (SELECT (v0, v1) FROM r GROUP BY v0, v1 HAVING min((w0, w1)) = (v0, v1)) GROUP BY v0, v1""")
def distinct_self_intersections(spark, sf_dir):
    """One self-intersection for each place of a mesh of many boxes."""
    mesh = boxes(spark, sf_dir)
    v = mesh.vertices.select("mesh_id", "vid", (F.col("x") * 16).alias("x"), (F.col("y") * 16).alias("y"), (F.col("z") * 16 + F.col("vid") % 16).alias("z"))
    return repair.distinct_self_intersections(MeshFrame(v, mesh.triangles), Quantizer(exponent=30)).select("v0", "v1", "edge_tid", "tid")
