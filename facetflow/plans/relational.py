"""Queries of joins, aggregates, graph operators, set operations and renumbering."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetflow.functions import predicates as P
from facetflow.functions.quantize import sql_perturbation
from facetflow.functions.vec import V2, V3, Triangle
from facetflow.operators import graph as G
from facetflow.operators import loops, planes, sets, spatial, stats, surfaces
from facetflow.operators import topology as T
from facetflow.plans.scalar import SQL_VERDICT, query, quoted, sql_signs
from facetflow.sources.derived import SQL_BOXES, SQL_HEIGHT, SQL_SOUP, MeshFrame, boxes, component, height_field, soup, table

_W = f"WITH {SQL_HEIGHT}"
_WS = f"WITH {SQL_SOUP}"
_WB = f"WITH {SQL_BOXES}"


@query(f"{_WS} SELECT v0, v1, count(*) AS n_inc, min(tid) AS tid, arg_min(slot, tid * 3 + slot) AS slot FROM se GROUP BY v0, v1")
def edge_incidence(spark, sf_dir):
    return T.edge_incidence(soup(spark, sf_dir)).drop("mesh_id")


@query(f"{_WS}, i AS (SELECT v0, v1, count(*) AS n FROM se GROUP BY v0, v1) SELECT v0, v1, n AS n_inc FROM i WHERE n <> 2")
def non_manifold_edges(spark, sf_dir):
    return T.non_manifold_edges(soup(spark, sf_dir)).select("v0", "v1", "n_inc")


@query(f"""{_W}, d AS (SELECT tid, 0 AS slot, a AS p, b AS q FROM ht UNION ALL SELECT tid, 1, b, c FROM ht UNION ALL SELECT tid, 2, c, a FROM ht),
i AS (SELECT v0, v1 FROM he GROUP BY v0, v1 HAVING count(*) = 1) SELECT tid, slot, p, q FROM d JOIN i ON v0 = least(p, q) AND v1 = greatest(p, q)""")
def hole_edges(spark, sf_dir):
    return T.hole_edges(height_field(spark, sf_dir).triangles).drop("mesh_id")


@query(f"{_W} SELECT f.tid, f.slot, s.tid AS other, s.slot AS other_slot FROM he AS f JOIN he AS s ON f.v0 = s.v0 AND f.v1 = s.v1 AND f.tid <> s.tid")
def tri_neighbors(spark, sf_dir):
    return T.edge_neighbours(height_field(spark, sf_dir).triangles).drop("mesh_id")


@query(f"{_WS}, c AS (SELECT tid, a AS vid FROM st UNION ALL SELECT tid, b FROM st UNION ALL SELECT tid, c FROM st) SELECT vid, count(*) AS n_triangles, min(tid) AS first_tid FROM c GROUP BY vid")
def vertex_star(spark, sf_dir):
    return T.vertex_stars(soup(spark, sf_dir)).drop("mesh_id")


@query(f"{_W} SELECT tid, a, b, c FROM ht WHERE tid % 7 = 3")
def tri_by_three_vertices(spark, sf_dir):
    t = height_field(spark, sf_dir).triangles
    wanted = t.where("tid % 7 = 3").select("mesh_id", F.col("c").alias("p"), F.col("a").alias("q"), F.col("b").alias("r"))
    return T.by_corners(t, wanted).drop("mesh_id")


#: The second surface on a doubled grid, so that it crosses the first one.
_SQL_TWO = f"""{SQL_HEIGHT},
uv AS (SELECT 0 AS label, vid * 2 AS vid, x * 2 AS x, y * 2 AS y, z FROM hv UNION ALL
  SELECT 1, vec_id * 2 + 1, CAST(vec_id % 20 AS DOUBLE) * 2 + 1, CAST(vec_id // 20 AS DOUBLE) * 2 + 1, floor(CAST(embedding[2] AS DOUBLE) * 1024) FROM embeddings),
gv AS (SELECT label, vid, CAST(x * 64 AS HUGEINT) + {sql_perturbation('vid', 0, 4, 8)} AS x, CAST(y * 64 AS HUGEINT) + {sql_perturbation('vid', 1, 4, 8)} AS y,
  CAST(z * 64 AS HUGEINT) + {sql_perturbation('vid', 2, 4, 8)} AS z FROM uv),
ut AS (SELECT k AS label, tid * 2 + k AS tid, a * 2 + k AS a, b * 2 + k AS b, c * 2 + k AS c FROM ht, (VALUES (0), (1)) AS o(k)),
ue AS (SELECT DISTINCT label, least(p, q) AS v0, greatest(p, q) AS v1 FROM (SELECT label, a AS p, b AS q FROM ut UNION ALL SELECT label, b, c FROM ut UNION ALL SELECT label, c, a FROM ut)),
eg AS (SELECT e.label, v0, v1, p.x AS px, p.y AS py, p.z AS pz, q.x AS qx, q.y AS qy, q.z AS qz FROM ue AS e JOIN gv AS p ON p.vid = v0 JOIN gv AS q ON q.vid = v1),
tx AS (SELECT t.label, tid, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS "by", b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz
  FROM ut AS t JOIN gv AS a ON a.vid = t.a JOIN gv AS b ON b.vid = t.b JOIN gv AS c ON c.vid = t.c),
pr AS (SELECT v0, v1, tid, {", ".join(f"{e}.{quoted(c + n)} AS {quoted(c + n)}" for e, cs in (("eg", "pq"), ("tx", "abc")) for c in cs for n in "xyz")} FROM eg JOIN tx ON eg.label <> tx.label
  {" ".join(f"AND least(p{n}, q{n}) <= greatest(a{n}, {quoted('b' + n)}, c{n}) AND least(a{n}, {quoted('b' + n)}, c{n}) <= greatest(p{n}, q{n})" for n in "xyz")})"""


def _two(spark, sf_dir) -> MeshFrame:
    from facetflow.functions.quantize import Quantizer

    left = height_field(spark, sf_dir, 0, 2)
    both = T.disjoint_union(left, height_field(spark, sf_dir, 1, 2, 1))
    return spatial.on_grid(both, Quantizer(exponent=24), seed=4, quanta=8)


@query(f"WITH {_SQL_TWO} SELECT v0, v1, tid FROM pr")
def range_join_edge_triangle(spark, sf_dir):
    return spatial.edge_triangle_pairs(_two(spark, sf_dir), other=True).select("v0", "v1", "tid")


@query(f"WITH {_SQL_TWO}, s AS (SELECT v0, v1, tid, {sql_signs('p', 'q', 'a', 'b', 'c')} FROM pr), r AS (SELECT v0, v1, tid, {SQL_VERDICT} FROM s) SELECT v0, v1, tid, zero AS degenerate FROM r WHERE near")
def exact_edge_triangle_join(spark, sf_dir):
    pairs = spatial.edge_triangle_pairs(_two(spark, sf_dir), other=True)
    return pairs.where("meets OR degenerate").select("v0", "v1", "tid", "degenerate")


@query(f"""{_WB}, bx AS (SELECT vec_id, mesh_id, c0 - half AS x0, c0 + half AS x1, c1 - half AS y0, c1 + half AS y1, c2 - half AS z0, c2 + half AS z1 FROM be)
SELECT p.vec_id AS a, q.vec_id AS b FROM bx AS p JOIN bx AS q ON p.mesh_id = q.mesh_id AND p.vec_id < q.vec_id AND p.x0 <= q.x1 AND q.x0 <= p.x1 AND p.y0 <= q.y1 AND q.y0 <= p.y1 AND p.z0 <= q.z1 AND q.z0 <= p.z1""")
def box_self_join(spark, sf_dir):
    return _meeting_boxes(spark, sf_dir).select("a", "b")


def _extents(spark, sf_dir):
    v = boxes(spark, sf_dir).vertices.withColumn("body", F.expr("vid div 8"))
    return v.groupBy("mesh_id", "body").agg(*[f(n).alias(f"{side}_{n}") for side, f in (("min", F.min), ("max", F.max)) for n in "xyz"])


def _meeting_boxes(spark, sf_dir):
    b = _extents(spark, sf_dir)
    left = b.select("mesh_id", F.col("body").alias("a"), *[F.col(c).alias(f"l_{c}") for c in spatial.BOX])
    right = b.select("mesh_id", F.col("body").alias("b"), *[F.col(c).alias(f"r_{c}") for c in spatial.BOX])
    return spatial.box_join(left, right, ["mesh_id"]).where("a < b").select("mesh_id", "a", "b")


@query(f"""{_WB}, bx AS (SELECT vec_id, mesh_id, c0 - half AS x0, c0 + half AS x1, c1 - half AS y0, c1 + half AS y1, c2 - half AS z0, c2 + half AS z1 FROM be),
p AS (SELECT vec_id, mesh_id, c0 + 0.25 AS x, c1 + 0.375 AS y, c2 + 0.125 AS z FROM be)
SELECT p.vec_id, CAST(count(bx.vec_id) AS BIGINT) AS winding FROM p LEFT JOIN bx ON bx.mesh_id = p.mesh_id AND p.x > x0 AND p.x < x1 AND p.y > y0 AND p.y < y1 AND p.z > z0 AND p.z < z1 GROUP BY p.vec_id""")
def ray_winding(spark, sf_dir):
    """How often the boxes of a mesh wind about the centre of each of them, slightly moved: rays along z, cells of the xy plane."""
    mesh = boxes(spark, sf_dir)
    rows = T.materialize(mesh)
    t = Triangle.of()
    box = t.box()
    rows = rows.withColumns({"lx": box.low.x, "hx": box.high.x, "ly": box.low.y, "hy": box.high.y})
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / 4), F.floor(F.col(b) / 4)))
    rows = rows.withColumn("gx", cells("lx", "hx")).withColumn("gy", cells("ly", "hy"))
    centre = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("b"), (F.col("vec_id") % 4).cast("string")).alias("mesh_id"), "vec_id", *[(component(k, 64) + m).alias(f"o{n}") for k, (n, m) in enumerate((("x", 0.25), ("y", 0.375), ("z", 0.125)))])
    centre = centre.withColumns({"gx": F.floor(F.col("ox") / 4), "gy": F.floor(F.col("oy") / 4)})
    met = centre.join(rows, ["mesh_id", "gx", "gy"], "left")
    o = V3.of("o")
    flat = lambda p, q: (p.x - o.x) * (q.y - o.y) - (p.y - o.y) * (q.x - o.x)
    ab, bc, ca = flat(t.a, t.b), flat(t.b, t.c), flat(t.c, t.a)
    hit = ((ab > 0) & (bc > 0) & (ca > 0)) | ((ab < 0) & (bc < 0) & (ca < 0))
    above = (t.a - o).dot(t.normal()) * F.signum(ab + bc + ca) > 0
    return met.groupBy("vec_id").agg(F.coalesce(F.sum(F.when(hit & above, F.signum(ab + bc + ca))), F.lit(0)).cast("long").alias("winding"))


@query(f"""{_WB}, m AS (SELECT mesh_id, count(*) AS n FROM bt GROUP BY mesh_id) SELECT a.mesh_id || '~' || b.mesh_id AS pair, a.n AS left_triangles, b.n AS right_triangles FROM m AS a, m AS b WHERE a.mesh_id <> b.mesh_id""")
def model_pairs(spark, sf_dir):
    """Every ordered pair of the four meshes of boxes, as operands of the batch driver."""
    from facetflow.plans import batch

    sides = batch.model_pairs(boxes(spark, sf_dir))
    counts = [m.triangles.groupBy(F.col("mesh_id").alias("pair")).agg(F.count("*").alias(f"{side}_triangles")) for side, m in zip(("left", "right"), sides, strict=True)]
    return counts[0].join(counts[1], "pair")


_POLY = """q AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, count(*) OVER (PARTITION BY label) AS n,
  floor(CAST(embedding[1] AS DOUBLE) * 1024) AS x, floor(CAST(embedding[2] AS DOUBLE) * 1024) AS y, floor(CAST(embedding[3] AS DOUBLE) * 1024) AS z FROM embeddings)"""


def _polygons(spark, sf_dir):
    w = W.partitionBy("label")
    e = table(spark, sf_dir, "embeddings")
    return e.select("label", "vec_id", (F.row_number().over(w.orderBy("vec_id")) - 1).cast("long").alias("pos"), F.count("*").over(w).alias("n"), *[component(k, 1024).alias(n) for k, n in enumerate("xyz")])


@query(f"""WITH {_POLY}, g AS (SELECT p.label, p.pos, p.n, p.x AS px, p.y AS py, r.x AS qx, r.y AS qy FROM q AS p JOIN q AS r ON r.label = p.label AND r.pos = (p.pos + 1) % p.n),
d AS (SELECT f.label, f.pos AS i, s.pos AS j, (f.px - s.px) * (s.qy - s.py) - (f.py - s.py) * (s.qx - s.px) AS d1, (f.qx - s.px) * (s.qy - s.py) - (f.qy - s.py) * (s.qx - s.px) AS d2,
  (s.px - f.px) * (f.qy - f.py) - (s.py - f.py) * (f.qx - f.px) AS d3, (s.qx - f.px) * (f.qy - f.py) - (s.qy - f.py) * (f.qx - f.px) AS d4
  FROM g AS f JOIN g AS s ON s.label = f.label AND s.pos >= f.pos + 2 AND s.pos < f.n - 1)
SELECT label, count(*) AS crossings FROM d WHERE ((d1 < 0 AND d2 > 0) OR (d1 > 0 AND d2 < 0)) AND ((d3 > 0 AND d4 < 0) OR (d3 < 0 AND d4 > 0)) GROUP BY label""")
def polygon_crossings(spark, sf_dir):
    """Crossings of each closed polygon's edges, its closing edge left out; candidates by boxes, not by all pairs."""
    p = _polygons(spark, sf_dir)
    after = p.select("label", F.pmod(F.col("pos") - 1, F.col("n")).alias("pos"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    e = p.join(after, ["label", "pos"]).select("label", "pos", "n", F.col("x").alias("px"), F.col("y").alias("py"), "qx", "qy")

    def boxed(prefix: str):
        box = [f(F.col(f"p{n}"), F.col(f"q{n}")) if n != "z" else F.lit(0.0) for f in (F.least, F.greatest) for n in "xyz"]
        return e.select("label", *[F.col(c).alias(f"{prefix}{c}") for c in ("pos", "n", "px", "py", "qx", "qy")], *[b.alias(f"{prefix}{n}") for b, n in zip(box, spatial.BOX, strict=True)])

    pairs = spatial.box_join(boxed("l_"), boxed("r_"), ["label"]).where("r_pos >= l_pos + 2 AND r_pos < l_n - 1")
    crossing = P.segments_cross(*(V2(F.col(f"{s}{c}x"), F.col(f"{s}{c}y")) for s in ("l_", "r_") for c in "pq"))
    return pairs.where(crossing).groupBy("label").agg(F.count("*").alias("crossings"))


@query(f"WITH {_POLY} SELECT label, pos, pos AS edge, x AS px, y AS py, coalesce(lead(x) OVER (PARTITION BY label ORDER BY pos), first(x) OVER (PARTITION BY label ORDER BY pos)) AS qx, x + 5 AS moved_x FROM q")
def closed_polygon_edges(spark, sf_dir):
    p = loops.translated(_polygons(spark, sf_dir).withColumn("from", F.col("x")), x=5)
    return loops.closed_edges(p.select("label", "pos", F.col("from").alias("x"), "y", F.col("x").alias("moved")), "label", ("x", "y", "moved")).select("label", F.col("edge").alias("pos"), "edge", "px", "py", "qx", F.col("pmoved").alias("moved_x"))


@query(f"""{_W} SELECT count(*) AS num_triangles, (SELECT count(*) FROM hv) AS num_vertices, round(sum(sqrt(pow((by_ - ay) * (cz - az) - (bz - az) * (cy - ay), 2) + pow((bz - az) * (cx - ax) - (bx - ax) * (cz - az), 2)
  + pow((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax), 2))) / 2, 3) AS area,
  round(sum(ax * (by_ * cz - bz * cy) + ay * (bz * cx - bx * cz) + az * (bx * cy - by_ * cx)) / 6, 3) AS volume,
  sqrt(min(least(pow(bx - ax, 2) + pow(by_ - ay, 2) + pow(bz - az, 2), pow(cx - bx, 2) + pow(cy - by_, 2) + pow(cz - bz, 2), pow(ax - cx, 2) + pow(ay - cy, 2) + pow(az - cz, 2)))) AS min_edge,
  sqrt(max(greatest(pow(bx - ax, 2) + pow(by_ - ay, 2) + pow(bz - az, 2), pow(cx - bx, 2) + pow(cy - by_, 2) + pow(cz - bz, 2), pow(ax - cx, 2) + pow(ay - cy, 2) + pow(az - cz, 2)))) AS max_edge,
  min(least(ax, bx, cx)) AS min_x, min(least(ay, by_, cy)) AS min_y, min(least(az, bz, cz)) AS min_z, max(greatest(ax, bx, cx)) AS max_x, max(greatest(ay, by_, cy)) AS max_y, max(greatest(az, bz, cz)) AS max_z,
  max(greatest(abs(ax), abs(ay), abs(az), abs(bx), abs(by_), abs(bz), abs(cx), abs(cy), abs(cz))) AS max_abs FROM tg""")
def geometric_stats(spark, sf_dir):
    rows = stats.geometric_statistics(height_field(spark, sf_dir)).drop("mesh_id")
    return rows.withColumns({"area": F.round("area", 3), "volume": F.round("volume", 3)})


@query(f"""{_WB} SELECT mesh_id, round(sum(8 * half * half * half), 3) AS volume FROM be GROUP BY mesh_id""")
def masked_stats(spark, sf_dir):
    """Only the property asked for is computed."""
    return stats.geometric_statistics(boxes(spark, sf_dir), ("volume",)).withColumn("volume", F.round("volume", 3))


@query(f"""{_W}, i AS (SELECT v0, v1, count(*) AS n FROM he GROUP BY v0, v1), v AS (SELECT a AS v FROM ht UNION SELECT b FROM ht UNION SELECT c FROM ht)
SELECT count(*) AS num_edges, CAST(count(*) FILTER (n <> 2) AS BIGINT) AS num_non_manifold, CAST(count(*) FILTER (n = 1) AS BIGINT) AS num_hole_edges, max(n) AS max_incidence,
  (SELECT count(*) FROM v) - count(*) + (SELECT count(*) FROM ht) AS euler, count(*) FILTER (n <> 2) = 0 AS two_manifold, 1::BIGINT AS num_bodies FROM i""")
def topological_stats(spark, sf_dir):
    return stats.topological_statistics(height_field(spark, sf_dir).triangles, bodies=True).drop("mesh_id")


@query(f"WITH {_POLY} SELECT label, count(*) AS n, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz, round(covar_pop(x, y) * count(*), 3) AS mxy, round(var_pop(z) * count(*), 3) AS mzz FROM q GROUP BY label")
def plane_moments(spark, sf_dir):
    return planes.moments(_polygons(spark, sf_dir), "label").select("label", "n", *[F.round(f"c{n}", 6).alias(f"c{n}") for n in "xyz"], F.round("mxy", 3).alias("mxy"), F.round("mzz", 3).alias("mzz"))


@query(None)
def best_fit_plane(spark, sf_dir):
    return planes.best_fit_planes(_polygons(spark, sf_dir), "label")


@query(f"""WITH {_POLY}, d AS (SELECT label, (x + 2 * y + 2 * z) / 3 AS deviation FROM q)
SELECT label, count(*) AS n, round(sum(deviation), 6) AS total, min(deviation) AS low, max(deviation) AS high, round(stddev_pop(deviation), 6) AS stddev FROM d GROUP BY label""")
def deviation_stats(spark, sf_dir):
    rows = _polygons(spark, sf_dir).select("label", ((F.col("x") + 2 * F.col("y") + 2 * F.col("z")) / 3).alias("deviation"))
    return planes.deviation_stats(rows, "label").withColumns({"total": F.round("total", 6), "stddev": F.round("stddev", 6)})


@query(f"""WITH {_POLY}, s AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(z) OVER w AS nz, first(x) OVER w AS fx, first(y) OVER w AS fy, first(z) OVER w AS fz FROM q WINDOW w AS (PARTITION BY label ORDER BY pos))
SELECT label, count(*) AS n, round(sum(sqrt(pow(coalesce(nx, fx) - x, 2) + pow(coalesce(ny, fy) - y, 2) + pow(coalesce(nz, fz) - z, 2))), 4) AS closed_length,
  round(sum(sqrt(pow(nx - x, 2) + pow(ny - y, 2) + pow(nz - z, 2))), 4) AS open_length FROM s GROUP BY label""")
def boundary_length(spark, sf_dir):
    p = _polygons(spark, sf_dir)
    closed = planes.polyline_length(p, "label", "pos").select("label", "n", F.round("length", 4).alias("closed_length"))
    return closed.join(planes.polyline_length(p, "label", "pos", closed=False).select("label", F.round("length", 4).alias("open_length")), "label")


@query(f"""{_WB}, t AS (SELECT bt.mesh_id, tid, tid // 12 AS body, 4 * half * half AS area2 FROM bt JOIN be ON vec_id = tid // 12) SELECT mesh_id, arg_max(tid, area2 * 1000000 - tid) AS tid, round(max(area2), 6) AS double_area FROM t GROUP BY mesh_id""")
def argmax_triangle(spark, sf_dir):
    return surfaces.representatives(boxes(spark, sf_dir)).withColumn("double_area", F.round("double_area", 6))


@query(f"{_W}, l AS (SELECT v0, v1, count(*) AS n_inc, min(tid // 200) <> max(tid // 200) AS intersects FROM he GROUP BY v0, v1) SELECT v0, v1, n_inc, intersects FROM l")
def edge_intersects_flag(spark, sf_dir):
    t = height_field(spark, sf_dir).triangles.withColumn("label", F.expr("tid div 200"))
    return T.label_mix(t).drop("mesh_id")


@query("""WITH e AS (SELECT DISTINCT l_partkey * 2 AS a, l_suppkey * 2 + 1 AS b FROM lineitem), n AS (SELECT a AS n FROM e UNION SELECT b FROM e),
r AS (WITH RECURSIVE reach(n, m) USING KEY (n) AS (SELECT n, n AS m FROM n UNION (
  SELECT x.n, min(x.m) FROM (SELECT e.b AS n, reach.m FROM reach JOIN e ON e.a = reach.n UNION ALL SELECT e.a, reach.m FROM reach JOIN e ON e.b = reach.n) AS x
  JOIN recurring.reach AS old ON old.n = x.n WHERE x.m < old.m GROUP BY x.n)) SELECT * FROM reach)
SELECT n AS node, m AS component FROM r""")
def graph_components(spark, sf_dir):
    """Components of the graph of parts and suppliers."""
    return G.components(table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 2).alias("a"), (F.col("l_suppkey") * 2 + 1).alias("b")))


@query(f"{_WB} SELECT tid, (tid // 12) * 8 AS body FROM bt")
def body_count(spark, sf_dir):
    return G.bodies(boxes(spark, sf_dir).triangles).select("tid", "body")


@query(f"{_WB} SELECT tid, (tid // 12) * 12 AS component FROM bt")
def edge_components(spark, sf_dir):
    return G.edge_components(boxes(spark, sf_dir).triangles).select("tid", "component")


@query(f"""{_W}, c AS (SELECT tid, unnest([a, b, c]) AS vid FROM ht),
r1 AS (SELECT DISTINCT o.tid FROM c JOIN c AS o USING (vid) WHERE c.tid = 300), r2 AS (SELECT DISTINCT o.tid FROM c JOIN c AS o USING (vid) WHERE c.tid IN (SELECT tid FROM r1)),
r3 AS (SELECT DISTINCT o.tid FROM c JOIN c AS o USING (vid) WHERE c.tid IN (SELECT tid FROM r2))
SELECT tid, CASE WHEN tid = 300 THEN 0 WHEN tid IN (SELECT tid FROM r1) THEN 1 WHEN tid IN (SELECT tid FROM r2) THEN 2 ELSE 3 END AS layer FROM r3""")
def ring_k(spark, sf_dir):
    t = height_field(spark, sf_dir).triangles
    return G.ring(t, t.where("tid = 300"), 3).select("tid", "layer")


@query(f"""{_W}, c AS (SELECT tid, unnest([a, b, c]) AS vid FROM ht),
r1 AS (SELECT DISTINCT o.tid FROM c JOIN c AS o USING (vid) WHERE c.tid % 640 = 300), r2 AS (SELECT DISTINCT o.tid FROM c JOIN c AS o USING (vid) WHERE c.tid IN (SELECT tid FROM r1)),
n AS (SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS new FROM (SELECT DISTINCT vid FROM c WHERE tid IN (SELECT tid FROM r2)))
SELECT row_number() OVER (ORDER BY tid) - 1 AS tid, p.new AS a, q.new AS b, r.new AS c FROM ht JOIN n AS p ON p.vid = a JOIN n AS q ON q.vid = b JOIN n AS r ON r.vid = c WHERE tid IN (SELECT tid FROM r2)""")
def extract_around(spark, sf_dir):
    """Two rings around a triangle of every sixteen rows, as a mesh of its own."""
    mesh = height_field(spark, sf_dir)
    part, _ = G.extract_around(mesh, mesh.triangles.where("tid % 640 = 300").select("mesh_id", "tid"), 2)
    return part.triangles.select("tid", "a", "b", "c")


@query(f"{_W} SELECT tid FROM ht WHERE a // 20 < 10")
def region_grow(spark, sf_dir):
    """All rows of cells below the line of vertices 200 to 219, whose edges are the barrier."""
    t = height_field(spark, sf_dir).triangles
    barrier = T.edges(t).where("v0 BETWEEN 200 AND 219 AND v1 BETWEEN 200 AND 219").select("mesh_id", "v0", "v1").distinct()
    return G.region_grow(t, t.where("tid = 100"), barrier, 1_000_000).select("tid")


@query(f"WITH {_SQL_TWO} SELECT tid, a, b, c, label FROM ut")
def disjoint_union(spark, sf_dir):
    return T.disjoint_union(height_field(spark, sf_dir, 0, 2), height_field(spark, sf_dir, 1, 2, 1)).triangles.drop("mesh_id")


@query(f"""{_W} SELECT tid, tid % 2 = 0 OR tid % 3 = 0 AS merged, tid % 2 = 0 AND tid % 3 <> 0 AS difference, tid % 6 = 0 AS both_sets, tid % 12 = 0 AS subset FROM ht WHERE tid % 2 = 0 OR tid % 3 = 0""")
def id_set_ops(spark, sf_dir):
    t = height_field(spark, sf_dir).triangles.select("tid")
    two, three, twelve = (t.where(f"tid % {k} = 0") for k in (2, 3, 12))
    flag = lambda rows, name: rows.withColumn(name, F.lit(True))
    rows = flag(sets.merged(two, three), "merged").join(flag(sets.difference(two, three), "difference"), "tid", "left").join(flag(sets.common(two, three), "both_sets"), "tid", "left").join(flag(sets.members(two, twelve, ["tid"]), "subset"), "tid", "left")
    return rows.select("tid", "merged", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("difference", "both_sets", "subset")])


def _bool_sql(stay: str, turned: str) -> str:
    return f"{_W}, l AS (SELECT *, tid % 2 AS label, tid // 100 % 2 AS inside FROM ht) SELECT tid, CASE WHEN {turned} THEN b ELSE a END AS a, CASE WHEN {turned} THEN a ELSE b END AS b, c FROM l WHERE {stay} OR {turned}"


def _bool_rule(operation: str):
    def run(spark, sf_dir):
        from facetflow.operators.boolean import RULES

        stay, turned = ([2 * a + b for a, b in rule] for rule in RULES[operation])
        code = (F.col("tid") % 2) * 2 + F.expr("tid div 100") % 2
        rows = height_field(spark, sf_dir).triangles.where(code.isin(stay + turned))
        return T.flip(rows, code.isin(turned) if turned else F.lit(False)).select("tid", "a", "b", "c")

    run.__name__ = f"bool_{operation}_labels"
    return run


for _name, _stay, _turned in (("union", "inside = 0", "false"), ("difference", "label = 0 AND inside = 0", "(label = 1 AND inside = 1)"), ("intersection", "inside = 1", "false"), ("symmetric_difference", "inside = 0", "(inside = 1)")):
    query(_bool_sql(_stay, _turned))(_bool_rule(_name))


@query(f"{_W} SELECT v0, v1, tid, row_number() OVER (PARTITION BY v0 ORDER BY v1, tid) AS pos, lead(v1) OVER (PARTITION BY v0 ORDER BY v1, tid) AS following FROM he")
def split_edge_order(spark, sf_dir):
    e = T.edges(height_field(spark, sf_dir).triangles).select("v0", "v1", "tid")
    return loops.along(e, ["v0"], ["v1", "tid"], "v1")


@query(f"""{_W}, m AS (SELECT tid // 40 AS g, tid % 2 = 0 AS l, tid % 6 = 0 OR tid // 40 % 3 = 0 AND tid % 20 = 3 AS r FROM ht WHERE tid // 40 % 7 <> 2 OR tid % 2 = 1)
SELECT g, bool_or(l AND r) AS overlaps, bool_and(l OR NOT r) AS contains FROM m WHERE l OR r GROUP BY g""")
def set_relations(spark, sf_dir):
    """Which sets of triangles, one of each kind for each row of cells, overlap or hold the other."""
    t = height_field(spark, sf_dir).triangles.select(F.expr("tid div 40").alias("g"), "tid").where("g % 7 <> 2 OR tid % 2 = 1")
    return sets.relations(t.where("tid % 2 = 0"), t.where("tid % 6 = 0 OR g % 3 = 0 AND tid % 20 = 3"), ["g"])


@query(f"WITH {_POLY}, l AS (SELECT label, count(*) AS n FROM q GROUP BY label) SELECT label, n, rank() OVER (ORDER BY n DESC) AS place FROM l")
def boundary_order(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return rows.withColumn("place", F.rank().over(W.orderBy(F.desc("n"))).cast("long"))


_SQL_KEPT = "k AS (SELECT * FROM ht WHERE tid % 5 <> 0 AND a > 45), u AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS new FROM (SELECT a AS v FROM k UNION SELECT b FROM k UNION SELECT c FROM k))"


@query(f"{_W}, {_SQL_KEPT} SELECT row_number() OVER (ORDER BY k.tid) - 1 AS tid, ua.new AS a, ub.new AS b, uc.new AS c FROM k JOIN u AS ua ON ua.v = k.a JOIN u AS ub ON ub.v = k.b JOIN u AS uc ON uc.v = k.c")
def delete_compact(spark, sf_dir):
    mesh = height_field(spark, sf_dir)
    return T.remove(mesh, mesh.triangles.where("tid % 5 = 0 OR a <= 45").select("mesh_id", "tid"))[0].triangles.select("tid", "a", "b", "c")


@query(f"{_W}, {_SQL_KEPT} SELECT v AS vid, new FROM u")
def extract_remap(spark, sf_dir):
    mesh = height_field(spark, sf_dir)
    return T.extract(mesh, mesh.triangles.where("tid % 5 <> 0 AND a > 45").select("mesh_id", "tid"))[1].select("vid", "new")


@query(f"""{_WB}, r AS (SELECT mesh_id, x, y, z, min(vid) AS vid FROM bv GROUP BY mesh_id, x, y, z), m AS (SELECT bv.vid, r.vid AS new FROM bv JOIN r USING (mesh_id, x, y, z))
SELECT tid, ma.new AS a, mb.new AS b, mc.new AS c FROM bt JOIN m AS ma ON ma.vid = a JOIN m AS mb ON mb.vid = b JOIN m AS mc ON mc.vid = c""")
def vertex_dedup(spark, sf_dir):
    return T.deduplicate_vertices(boxes(spark, sf_dir)).triangles.select("tid", "a", "b", "c")


@query(f"{_W} SELECT 'triangle' AS kind, tid AS id FROM ht WHERE a % 50 = 0 OR b % 50 = 0 OR c % 50 = 0 UNION ALL SELECT 'vertex', vid FROM hv WHERE vid % 50 = 1")
def valid_mesh(spark, sf_dir):
    mesh = height_field(spark, sf_dir)
    broken = mesh.vertices.where("vid % 50 <> 0").withColumn("z", F.when(F.col("vid") % 50 == 1, F.lit(float("nan"))).otherwise(F.col("z")))
    return T.invalid_rows(MeshFrame(broken, mesh.triangles)).select("kind", "id")


@query(f"{_W} SELECT tid, a, b, c FROM ht WHERE c IN (SELECT vid FROM hv WHERE z > 0)")
def membership(spark, sf_dir):
    """Gathers rows by sets of ids: a semi-join."""
    mesh = height_field(spark, sf_dir)
    high = mesh.vertices.where("z > 0").select("mesh_id", F.col("vid").alias("c"))
    return sets.members(mesh.triangles, high, ["mesh_id", "c"]).select("tid", "a", "b", "c")


@query(f"""{_WB}, bx AS (SELECT vec_id, mesh_id, c0 - half AS x0, c0 + half AS x1, c1 - half AS y0, c1 + half AS y1, c2 - half AS z0, c2 + half AS z1 FROM be),
g AS (SELECT p.mesh_id, p.vec_id AS a, q.vec_id AS b FROM bx AS p JOIN bx AS q ON p.mesh_id = q.mesh_id AND p.vec_id < q.vec_id AND p.x0 <= q.x1 AND q.x0 <= p.x1 AND p.y0 <= q.y1 AND q.y0 <= p.y1 AND p.z0 <= q.z1 AND q.z0 <= p.z1)
SELECT x.a AS t0, x.b AS t1, y.b AS t2 FROM g AS x JOIN g AS y ON y.mesh_id = x.mesh_id AND y.a = x.b JOIN g AS z ON z.mesh_id = x.mesh_id AND z.a = x.a AND z.b = y.b""")
def tri_triples(spark, sf_dir):
    """Boxes that meet pairwise, each triple once."""
    return spatial.box_triples(_extents(spark, sf_dir).withColumnRenamed("body", "id"), ["mesh_id"]).select("t0", "t1", "t2")


@query(f"""{_WB}, s AS (SELECT mesh_id, vec_id AS body, bt.* EXCLUDE (mesh_id) FROM bt JOIN be USING (mesh_id) WHERE tid // 12 = vec_id), c AS (SELECT tid, unnest([a, b, c]) AS v FROM s),
g AS (SELECT DISTINCT p.tid AS a, q.tid AS b FROM s AS p JOIN s AS q ON p.body = q.body AND p.tid < q.tid), h AS (SELECT DISTINCT p.tid AS a, q.tid AS b FROM c AS p JOIN c AS q USING (v) WHERE p.tid < q.tid),
n AS (SELECT * FROM g EXCEPT SELECT * FROM h)
SELECT x.a AS t0, x.b AS t1, y.b AS t2 FROM n AS x JOIN n AS y ON y.a = x.b JOIN n AS z ON z.a = x.a AND z.b = y.b""")
def triples_without_shared_vertices(spark, sf_dir):
    """Triples of a box's triangles none of which shares a vertex with another."""
    t = boxes(spark, sf_dir).triangles
    body = t.select("mesh_id", "tid", F.expr("tid div 12").alias("body"))
    pairs = body.withColumnRenamed("tid", "a").join(body.withColumnRenamed("tid", "b"), ["mesh_id", "body"]).where("a < b").drop("body")
    return spatial.meeting_triples(spatial.without_shared_vertices(pairs, t)).select("t0", "t1", "t2")


@query(f"""{_WB}, x AS (SELECT p.tid AS t0, q.tid AS t1, r.tid AS t2, p.a AS pa, p.b AS pb, p.c AS pc, [q.a, q.b, q.c] AS q, [r.a, r.b, r.c] AS r
  FROM bt AS p JOIN bt AS q ON p.tid // 12 = q.tid // 12 AND p.tid < q.tid JOIN bt AS r ON r.tid // 12 = q.tid // 12 AND q.tid < r.tid)
SELECT t0, t1, t2 FROM x WHERE NOT (list_contains(q, pa) AND list_contains(r, pa) OR list_contains(q, pb) AND list_contains(r, pb) OR list_contains(q, pc) AND list_contains(r, pc))""")
def triples_without_common_vertex(spark, sf_dir):
    """Triples of a box's triangles that have no vertex common to all three."""
    t = boxes(spark, sf_dir).triangles
    body = t.select("mesh_id", "tid", F.expr("tid div 12").alias("body"))
    pairs = body.withColumnRenamed("tid", "a").join(body.withColumnRenamed("tid", "b"), ["mesh_id", "body"]).where("a < b").drop("body")
    return spatial.without_common_vertex(spatial.meeting_triples(pairs), t).select("t0", "t1", "t2")


@query("""WITH r AS (SELECT o_orderpriority AS operation, o_orderstatus <> 'P' AS two_manifold, CASE WHEN o_orderstatus = 'F' THEN 'DEGENERATE' ELSE 'OK' END AS status, o_custkey AS num_triangles FROM orders)
SELECT operation, count(*) AS runs, CAST(count(*) FILTER (status = 'OK') AS BIGINT) AS successes, CAST(count(*) FILTER (status <> 'OK') AS BIGINT) AS failures,
  CAST(count(*) FILTER (two_manifold) AS BIGINT) AS two_manifold, CAST(sum(num_triangles) AS BIGINT) AS triangles FROM r GROUP BY ROLLUP (operation)""")
def run_rollup(spark, sf_dir):
    """The batch driver's totals, over rows of its form."""
    from facetflow.plans import batch

    o = F.col("o_orderstatus")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("operation"), (o != "P").alias("two_manifold"), F.when(o == "F", "DEGENERATE").otherwise("OK").alias("status"), F.col("o_custkey").alias("num_triangles"))
    return batch.rollup(rows)
