"""Queries of boolean operations, boundaries, triangulation, repair and text meshes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from facetflow.operators import boolean, loops, repair, stats
from facetflow.operators import topology as T
from facetflow.operators.tables import write_table
from facetflow.operators.triangulate import triangulate as triangulate_points
from facetflow.plans.scalar import SQL, query
from facetflow.sources import off
from facetflow.sources.derived import SQL_BOXES, SQL_HEIGHT, MeshFrame, boxes, height_field, table


def _operands(spark, sf_dir: str, pairs: int) -> tuple[MeshFrame, MeshFrame]:
    """Solid k: vector k's box, centred at the origin of its own space; the other operand is vector k + pairs' box, set off."""
    mesh = boxes(spark, sf_dir)

    def side(low: int, move: float) -> MeshFrame:
        body = lambda c, n: F.expr(f"{c} div {n}") - low
        v = mesh.vertices.where(f"vid div 8 >= {low} AND vid div 8 < {low + pairs}")
        centre = v.groupBy(F.expr("vid div 8").alias("body")).agg(*[((F.min(n) + F.max(n)) / 2).alias(f"c{n}") for n in "xyz"])
        v = v.withColumn("body", F.expr("vid div 8")).join(centre, "body")
        v = v.select(body("vid", 8).cast("string").alias("mesh_id"), (F.col("vid") - 8 * low).alias("vid"), *[(F.col(n) - F.col(f"c{n}") + move).alias(n) for n in "xyz"])
        t = mesh.triangles.where(f"tid div 12 >= {low} AND tid div 12 < {low + pairs}")
        return MeshFrame(v, t.select(body("tid", 12).cast("string").alias("mesh_id"), (F.col("tid") - 12 * low).alias("tid"), *[(F.col(n) - 8 * low).alias(n) for n in "abc"]))

    return side(0, 0.0), side(pairs, 1.25)


def _volumes(left: MeshFrame, right: MeshFrame):
    found = boolean.volumes(boolean.resolve(left, right))
    return found.select("mesh_id", *[F.round(operation, 3).alias(f"{name}_volume") for operation, name in (("union", "union"), ("difference", "difference"), ("intersection", "intersection"), ("symmetric_difference", "symmetric"))])


def _union_statistics(left: MeshFrame, right: MeshFrame):
    mesh = boolean.boolean(left, right, "union")
    triangles, _ = write_table(mesh.triangles)
    return stats.geometric_statistics(MeshFrame(mesh.vertices, triangles)).join(stats.topological_statistics(triangles, bodies=True), "mesh_id")


def _half(spark, sf_dir: str) -> int:
    """Half of the vectors, rounded down: vector k is paired with vector k + half, a last odd one with none."""
    return ((table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] or 0) + 1) // 2


@query("""WITH h AS (SELECT vec_id, 1.0::DOUBLE + label % 3 AS half FROM embeddings), m AS (SELECT (max(vec_id) + 1) // 2 AS pairs FROM embeddings),
p AS (SELECT a.vec_id AS k, a.half AS ha, b.half AS hb FROM m, h AS a JOIN h AS b ON b.vec_id = a.vec_id + m.pairs WHERE a.vec_id < m.pairs),
o AS (SELECT *, greatest(least(ha, 1.25 + hb) - greatest(-ha, 1.25 - hb), 0) AS w FROM p),
v AS (SELECT k, 8 * ha * ha * ha AS va, 8 * hb * hb * hb AS vb, w * w * w AS vi FROM o)
SELECT CAST(k AS VARCHAR) AS mesh_id, round(va + vb - vi, 3) AS union_volume, round(va - vi, 3) AS difference_volume, round(vi, 3) AS intersection_volume, round(va + vb - 2 * vi, 3) AS symmetric_volume FROM v""")
def bool_volumes(spark, sf_dir):
    """All vectors' boxes, in pairs, at once."""
    return _volumes(*_operands(spark, sf_dir, _half(spark, sf_dir)))


@query(None)
def bool_union_geometry(spark, sf_dir):
    """Statistics of the unions: closed, one body each."""
    return _union_statistics(*_operands(spark, sf_dir, _half(spark, sf_dir)))


@query(f"""WITH {SQL_HEIGHT}, n AS (SELECT max(vid) // 20 AS top FROM hv), b AS (SELECT vid, CASE WHEN vid < 20 THEN vid WHEN vid % 20 = 19 THEN 20 + vid // 20 - 1 WHEN vid // 20 = top THEN 19 + top + 19 - vid % 20
  ELSE 19 + top + 19 + top - vid // 20 END AS pos FROM hv, n WHERE vid < 20 OR vid % 20 IN (0, 19) OR vid // 20 = top)
SELECT '0' AS loop_id, CAST(pos AS INTEGER) AS pos, vid, 'ok' AS status FROM b""")
def boundary_loops(spark, sf_dir):
    return loops.boundary_loops(height_field(spark, sf_dir).triangles).drop("mesh_id")


_SQL_RING = """n AS (SELECT max(vid) // 20 AS top FROM hv), ring AS (SELECT vid, CASE WHEN vid < 20 THEN vid WHEN vid % 20 = 19 THEN 20 + vid // 20 - 1 WHEN vid // 20 = top THEN 19 + top + 19 - vid % 20
  ELSE 19 + top + 19 + top - vid // 20 END AS pos FROM hv, n WHERE vid < 20 OR vid % 20 IN (0, 19) OR vid // 20 = top)"""


@query(f"""WITH {SQL_HEIGHT}, {SQL_BOXES}, {_SQL_RING} SELECT 'h' AS mesh_id, '0' AS loop_id, CAST(pos AS INTEGER) AS pos, vid, 'ok' AS status FROM ring
UNION ALL SELECT mesh_id, CAST(vec_id * 8 + 4 AS VARCHAR), k, vec_id * 8 + 4 + k, 'ok' FROM be, (SELECT CAST(unnest(range(4)) AS INTEGER) AS k)""")
def undirected_loops(spark, sf_dir):
    """Edges without direction around the height field and around all boxes that lost their tops, numbered by pointer jumping; ids of meshes overlap."""
    field, open_boxes = height_field(spark, sf_dir).triangles, boxes(spark, sf_dir).triangles.where("tid % 12 NOT IN (2, 3)")
    edges = T.hole_edges(field).union(T.hole_edges(open_boxes)).select("mesh_id", F.when(F.col("p") % 3 == 0, F.col("q")).otherwise(F.col("p")).alias("p"), F.when(F.col("p") % 3 == 0, F.col("p")).otherwise(F.col("q")).alias("q"))
    return loops.assemble(edges, undirected=True, small=0)


def _reclosed(mesh: MeshFrame):
    body = lambda c, n: F.expr(f"{c} div {n}").cast("string").alias("mesh_id")
    v = mesh.vertices.select(body("vid", 8), "vid", "x", "y", "z")
    t = mesh.triangles.select(body("tid", 12), "tid", "a", "b", "c")
    face = F.expr("tid div 12") % 6 * 2
    opened = MeshFrame(v, t.where((F.col("tid") % 12 != face) & (F.col("tid") % 12 != face + 1)))
    closed, _ = repair.close_holes(opened)
    found = stats.geometric_statistics(closed, ("counts", "volume")).join(stats.topological_statistics(closed.triangles), "mesh_id")
    return found.select((F.col("mesh_id").cast("long") * 12).alias("first_tid"), "num_triangles", "num_edges", "num_hole_edges", F.round("volume", 6).alias("volume"))


@query(f"""WITH {SQL_BOXES} SELECT vec_id * 12 AS first_tid, 12::BIGINT AS num_triangles, 18::BIGINT AS num_edges, 0::BIGINT AS num_hole_edges, round(8 * half * half * half, 6) AS volume FROM be""")
def close_holes(spark, sf_dir):
    """All boxes that lost the two triangles of a face each, closed again."""
    return _reclosed(boxes(spark, sf_dir))


@query("""SELECT label, count(*) AS points, count(DISTINCT (embedding[1], embedding[2])) AS places, CASE WHEN count(DISTINCT (embedding[1], embedding[2])) < 3 THEN 0::BIGINT
  ELSE CAST(2 * count(DISTINCT (embedding[1], embedding[2])) - 2 AS BIGINT) END AS triangles_and_hull FROM embeddings WHERE embedding[1] IS NOT NULL AND embedding[2] IS NOT NULL GROUP BY label""")
def triangulate(spark, sf_dir):
    """Delaunay triangulations of all of each label's points, however many; points at one place are one corner."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", *[F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate("xy")])

    def found(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["x", "y"])
        places = list(part[["x", "y"]].drop_duplicates().itertuples(index=False, name=None))
        tris = triangulate_points(places, [], carve=False, most=None)
        sides = pd.Series([frozenset(s) for t in tris for s in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))], dtype=object)
        hull = int((sides.value_counts() == 1).sum())
        return pd.DataFrame({"label": [part["label"].iloc[0]], "points": [len(part)], "places": [len(places)], "triangles_and_hull": [len(tris) + hull]})

    return e.where("x IS NOT NULL AND y IS NOT NULL").groupBy("label").applyInPandas(found, "label int, points long, places long, triangles_and_hull long")


#: Vertices with a fin on the edge to the next vertex, every seventh row of the height field; all triangles around them are there.
_FINS = "vid % 20 = 9 AND {row} % 7 = 3 AND vid + 42 <= {last}"


@query(f"""WITH {SQL_HEIGHT}, f AS (SELECT count(*) AS n FROM hv WHERE {_FINS.format(row="vid // 20", last="(SELECT max(vid) FROM hv)")}), i AS (SELECT v0, v1, count(*) AS n FROM he GROUP BY ALL)
SELECT f.n AS before, 0::BIGINT AS after, f.n AS resolved, 0::BIGINT AS abandoned, 0::BIGINT AS failed, (SELECT count(*) FROM ht) - 4 * f.n AS num_triangles,
  (SELECT count(DISTINCT v) FROM (SELECT unnest([v0, v1]) AS v FROM he)) - 2 * f.n AS num_vertices, (SELECT count(*) FROM i WHERE n = 1) AS num_hole_edges, 0::BIGINT AS num_non_manifold FROM f""")
def repair_non_manifold(spark, sf_dir):
    """A surface with fins: each edge with three triangles goes with its two ends, ten triangles and the fin, and six close the hole."""
    mesh = height_field(spark, sf_dir)
    last = mesh.vertices.agg(F.max("vid")).first()[0] or 0
    at = mesh.vertices.where(_FINS.format(row="(vid div 20)", last=last))
    tips = at.select("mesh_id", (-1 - F.col("vid")).alias("vid"), (F.col("x") + 0.5).alias("x"), (F.col("y") + 0.2).alias("y"), F.lit(9e6).alias("z"))
    fins = at.select("mesh_id", (-1 - F.col("vid")).alias("tid"), F.col("vid").alias("a"), (F.col("vid") + 1).alias("b"), (-1 - F.col("vid")).alias("c"))
    flat = mesh.vertices.unionByName(tips).withColumn("z", F.col("z") / 8192)
    fixed, counts = repair.remove_non_manifold_edges(MeshFrame(flat, mesh.triangles.unionByName(fins)))
    e = T.edge_incidence(fixed.triangles).agg(F.count_if(F.col("n_inc") == 1).alias("num_hole_edges"), F.count_if(F.col("n_inc") > 2).alias("num_non_manifold"))
    found = e.crossJoin(fixed.triangles.agg(F.count("*").alias("num_triangles"))).crossJoin(fixed.vertices.agg(F.count("*").alias("num_vertices")))  # one row each
    return found.select("*", *[F.lit(getattr(counts, n)).cast("long").alias(n) for n in ("before", "after", "resolved", "abandoned", "failed")])


@query(f"""WITH {SQL_BOXES} SELECT mesh_id, count(*) AS num_triangles, round(sum(8 * half * half * half) / 12, 3) AS volume FROM bt JOIN be USING (mesh_id) WHERE tid // 12 = vec_id GROUP BY mesh_id""")
def off_round_trip(spark, sf_dir):
    """Meshes written as text and read again."""
    import uuid

    from facetflow.operators.tables import scratch

    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    mesh = T.compact(boxes(spark, sf_dir))[0]
    off.write_off(MeshFrame(mesh.vertices, mesh.triangles), path, None)
    back = off.read_off(spark, f"{path}/mesh_id=*/*.txt", dedup=True)
    found = stats.geometric_statistics(back, ("counts", "volume"))
    return found.select("mesh_id", "num_triangles", F.round("volume", 3).alias("volume"))


@query(SQL["off_round_trip"])
def off_pieces_round_trip(spark, sf_dir):
    """Meshes written and read by pieces: no file, and no mesh, is one task's."""
    import uuid

    from facetflow.operators.tables import scratch

    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    off.write_off(T.compact(boxes(spark, sf_dir))[0], path, None, pieces=True)
    back = off.read_off(spark, f"{path}/mesh_id=*/*.txt", dedup=True, pieces=True)
    found = stats.geometric_statistics(back, ("counts", "volume"))
    return found.select("mesh_id", "num_triangles", F.round("volume", 3).alias("volume"))
