"""Queries of repair beside the mesh: gaps of regions, open surfaces, patches, trials."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetflow.operators import loops, region_repair, repair
from facetflow.operators import topology as T
from facetflow.operators.tables import write_table
from facetflow.plans.scalar import query
from facetflow.sources.derived import SQL_HEIGHT, MeshFrame, height_field

#: Rows of the height field to a surface, and how often each surface has a defect: once, if it is whole.
ROWS = 16


def _bands(spark, sf_dir: str) -> MeshFrame:
    """The height field cut into open surfaces of 16 rows; in each whole one two vertices are pulled through the surface."""
    mesh = height_field(spark, sf_dir)
    last = mesh.vertices.agg(F.max("vid")).first()[0] or 0
    band, row, column = F.expr(f"vid div {20 * ROWS}"), F.expr("vid div 20") % ROWS, F.col("vid") % 20
    whole = (band + 1) * 20 * ROWS - 1 <= last
    pulled = lambda a, b: F.when(whole & (column == 9) & (row == 7), F.lit(a)).when(whole & (column == 10) & (row == 8), F.lit(b)).otherwise(F.lit(0.0))
    x, y, z = F.col("x") + pulled(1.6, -0.1), F.col("y") + pulled(1.3, 0.1), F.col("z") / 8192 - pulled(0.9, 2.0)
    vertices = mesh.vertices.select(band.cast("string").alias("mesh_id"), "vid", x.alias("x"), y.alias("y"), z.alias("z"))
    inside = mesh.triangles.where(F.expr("tid div 2 div 20") % ROWS < ROWS - 1)
    triangles = inside.select(F.expr(f"tid div 2 div {20 * ROWS}").cast("string").alias("mesh_id"), "tid", "a", "b", "c")
    triangles, _ = write_table(triangles)  # each step of a repair reads them
    return MeshFrame(write_table(vertices.join(T.used_vertices(triangles), ["mesh_id", "vid"], "left_semi"))[0], triangles)


_SQL_BANDS = f"""{SQL_HEIGHT}, last AS (SELECT max(vid) AS last FROM hv),
bt AS (SELECT tid // {40 * ROWS} AS band, tid, a, b, c FROM ht WHERE tid // 40 % {ROWS} < {ROWS - 1}),
bands AS (SELECT band, (band + 1) * {20 * ROWS} - 1 <= last AS whole, count(*) AS triangles FROM bt, last GROUP BY ALL)"""


@query(f"""WITH {_SQL_BANDS}, r AS (SELECT tid // 320 AS region, count(*) AS triangles FROM ht, last WHERE tid // 2 % 20 BETWEEN 3 AND 8 AND tid // 40 % 8 BETWEEN 1 AND 6 AND (tid // 320 + 1) * 160 - 1 <= last GROUP BY ALL)
SELECT region, 2::BIGINT AS boundaries, 8::BIGINT AS filled, 'ok' AS status, triangles FROM r""")
def scrub_regions(spark, sf_dir):
    """A ring of six by six cells in every eight rows of a surface: the four cells that it encloses come in."""
    mesh = height_field(spark, sf_dir)
    last = mesh.vertices.agg(F.max("vid")).first()[0] or 0
    column, row = F.expr("tid div 2 % 20"), F.expr("tid div 40 % 8")
    ring = column.between(3, 8) & row.between(1, 6) & ~(column.between(5, 6) & row.between(3, 4)) & F.expr(f"(tid div 320 + 1) * 160 - 1 <= {last}")
    found, status = region_repair.scrub_regions(mesh, mesh.triangles.where(ring).select("mesh_id", F.expr("tid div 320").alias("region"), "tid"))
    sizes = found.groupBy("region").agg(F.count("*").alias("triangles"))
    return status.join(sizes, "region").select("region", "boundaries", "filled", "status", "triangles")


@query(f"""WITH {_SQL_BANDS}, e AS (SELECT band, v0, v1, count(*) AS n FROM he JOIN bt USING (tid) GROUP BY ALL), h AS (SELECT band, count(*) FILTER (n = 1) AS hole_edges FROM e GROUP BY band)
SELECT band::VARCHAR AS mesh_id, CASE WHEN whole THEN 'ok' ELSE 'CLEAN' END AS status, whole AS had_some, 0::BIGINT AS after, CASE WHEN whole THEN 1 ELSE 0 END::BIGINT AS holes,
  CASE WHEN whole THEN 1 ELSE 0 END::BIGINT AS filled, 0::BIGINT AS loose, hole_edges, 0::BIGINT AS non_manifold FROM bands JOIN h USING (band)""")
def repair_surfaces(spark, sf_dir):
    """Open surfaces with a defect each, repaired by themselves: one hole is made and closed, the outside boundary is as before."""
    fixed, status = region_repair.repair_surfaces(_bands(spark, sf_dir))
    edges = T.edge_incidence(fixed.triangles).groupBy("mesh_id").agg(F.count_if(F.col("n_inc") == 1).alias("hole_edges"), F.count_if(F.col("n_inc") > 2).alias("non_manifold"))
    return status.join(edges, "mesh_id").select("mesh_id", "status", (F.col("before") > 0).alias("had_some"), "after", "holes", "filled", "loose", "hole_edges", "non_manifold")


@query(f"WITH {_SQL_BANDS} SELECT band::VARCHAR AS mesh_id, 'ok' AS status, true AS had_some, 0::BIGINT AS after, 1::BIGINT AS holes, 1::BIGINT AS filled FROM bands WHERE whole")
def repair_on_patches(spark, sf_dir):
    """One defect of each surface, on a patch of nine rings with the inner three taken out."""
    mesh = _bands(spark, sf_dir)
    found = repair.distinct_self_intersections(mesh)
    _, status = region_repair.repair_on_patches(mesh, found, inner=3, outer=9)
    return status.select("mesh_id", "status", (F.col("before") > 0).alias("had_some"), "after", "holes", "filled")


@query(f"""WITH {_SQL_BANDS} SELECT band::VARCHAR AS mesh_id, 'ok' AS status, true AS had_some, 0::BIGINT AS after, 1::BIGINT AS filled, triangles AS mesh_triangles FROM bands WHERE whole""")
def try_regions(spark, sf_dir):
    """The self-intersecting region of each surface, repaired beside it; the surfaces are untouched."""
    mesh = _bands(spark, sf_dir)
    _, status = region_repair.try_regions(mesh)
    sizes = mesh.triangles.groupBy("mesh_id").agg(F.count("*").alias("mesh_triangles"))
    return status.join(sizes, "mesh_id").select("mesh_id", "status", (F.col("before") > 0).alias("had_some"), "after", "filled", "mesh_triangles")


@query(f"""WITH {SQL_HEIGHT}, o AS (SELECT v0, v1 FROM he GROUP BY ALL HAVING count(*) = 1), v AS (SELECT DISTINCT unnest([v0, v1]) AS vid FROM o),
k AS (SELECT vid FROM v WHERE vid NOT IN (SELECT a FROM ht WHERE a = 0) AND NOT (vid % 20 = 19 AND vid = (SELECT max(vid) FROM hv)))
SELECT (SELECT min(vid) FROM v)::VARCHAR AS loop_id, count(*) AS n, min(vid) AS first, max(vid) AS last, sum(vid)::BIGINT AS ids FROM k""")
def smooth_loops(spark, sf_dir):
    """The boundary of a surface of cells: of its four corners two are cut off with their triangle."""
    mesh = height_field(spark, sf_dir)
    found = loops.smooth_loops(loops.boundary_loops(mesh.triangles), mesh.triangles)
    return found.groupBy("loop_id").agg(F.count("*").alias("n"), F.min("vid").alias("first"), F.max("vid").alias("last"), F.sum("vid").alias("ids"))
