"""Incidence, adjacency and renumbering of meshes as joins and aggregates.

All tables carry ``mesh_id``: any number of meshes is processed together, and a key of one of them is never compared with
another's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetflow.sources.derived import MeshFrame


def materialize(mesh: MeshFrame, keep: list[str] | None = None) -> DataFrame:
    """Triangles with their corners' coordinates ax ... cz; triangles with a missing vertex are dropped (see ``invalid_rows``)."""
    rows = mesh.triangles.select("mesh_id", "tid", "a", "b", "c", *(keep or []))
    for corner in "abc":
        v = mesh.vertices.select("mesh_id", F.col("vid").alias(corner), *[F.col(n).alias(f"{corner}{n}") for n in "xyz"])
        rows = rows.join(v, ["mesh_id", corner])
    return rows.select("mesh_id", "tid", "a", "b", "c", *(keep or []), *[f"{q}{n}" for q in "abc" for n in "xyz"])


def edges(triangles: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Three rows a triangle: slot 0 AB, 1 BC, 2 CA; (v0, v1) in order, ``forward`` if the triangle runs that way, and the corner opposite."""
    slot = lambda k, p, q, o: F.struct(F.lit(k).alias("slot"), F.col(p).alias("p"), F.col(q).alias("q"), F.col(o).alias("opposite"))
    rows = triangles.select("mesh_id", "tid", *(keep or []), F.inline(F.array(slot(0, "a", "b", "c"), slot(1, "b", "c", "a"), slot(2, "c", "a", "b"))))
    return rows.withColumns({"v0": F.least("p", "q"), "v1": F.greatest("p", "q"), "forward": F.col("p") < F.col("q")})


def edge_incidence(triangles: DataFrame) -> DataFrame:
    """(mesh_id, v0, v1, n_inc, tid, slot): each edge once, with how many triangles have it and the first of them.

    Counted before and after the shuffle; the members are not gathered, as an edge may have any number (``edges`` has them).
    """
    first = F.min(F.struct("tid", "slot"))
    rows = edges(triangles).groupBy("mesh_id", "v0", "v1").agg(F.count("*").alias("n_inc"), first.alias("first"))
    return rows.select("mesh_id", "v0", "v1", "n_inc", "first.tid", "first.slot")


def non_manifold_edges(triangles: DataFrame) -> DataFrame:
    return edge_incidence(triangles).where("n_inc <> 2")


def hole_edges(triangles: DataFrame) -> DataFrame:
    """Directed boundary edges p to q of the one triangle that has each."""
    once = edge_incidence(triangles).where("n_inc = 1").select("mesh_id", "tid", "slot")
    return edges(triangles).join(once, ["mesh_id", "tid", "slot"], "left_semi").select("mesh_id", "tid", "slot", "p", "q")


def edge_neighbours(triangles: DataFrame) -> DataFrame:
    """(mesh_id, tid, slot, other, other_slot): triangles that share an edge."""
    e = edges(triangles).select("mesh_id", "tid", "slot", "v0", "v1")
    o = e.select("mesh_id", F.col("tid").alias("other"), F.col("slot").alias("other_slot"), "v0", "v1")
    return e.join(o, ["mesh_id", "v0", "v1"]).where("tid <> other").select("mesh_id", "tid", "slot", "other", "other_slot")


def vertex_stars(triangles: DataFrame) -> DataFrame:
    """(mesh_id, vid, n_triangles, first_tid)."""
    from facetflow.operators.graph import triangle_vertices

    return triangle_vertices(triangles).groupBy("mesh_id", "vid").agg(F.count("*").alias("n_triangles"), F.min("tid").alias("first_tid"))


def by_corners(triangles: DataFrame, wanted: DataFrame) -> DataFrame:
    """Triangles of ``wanted(mesh_id, p, q, r)``, in whatever order the corners stand."""
    key = lambda *c: F.array_sort(F.array(*c)).alias("key")
    w = wanted.select("mesh_id", key("p", "q", "r")).distinct()
    return triangles.withColumn("key", key("a", "b", "c")).join(w, ["mesh_id", "key"], "left_semi").drop("key")


def by_uid(triangles: DataFrame, wanted: DataFrame, uid: str = "uid") -> DataFrame:
    """Triangles whose id in their source is wanted."""
    return triangles.join(wanted.select(uid), uid, "left_semi")


def flip(triangles: DataFrame, when: Column | None = None) -> DataFrame:
    """Turns orientation, everywhere or where a condition holds."""
    turn = F.lit(True) if when is None else when
    return triangles.withColumns({"a": F.when(turn, F.col("b")).otherwise(F.col("a")), "b": F.when(turn, F.col("a")).otherwise(F.col("b"))})


def offset(triangles: DataFrame, by: int) -> DataFrame:
    return triangles.withColumns({n: F.col(n) + by for n in "abc"})


def disjoint_union(left: MeshFrame, right: MeshFrame, mesh_id: str = "u") -> MeshFrame:
    """Both meshes side by side; ids become ``2 * id + operand``, which needs no maximum, and ``label`` names the operand."""
    of = F.lit(mesh_id).alias("mesh_id")
    vertices = [m.vertices.select(of, (F.col("vid") * 2 + k).alias("vid"), "x", "y", "z") for k, m in enumerate((left, right))]
    triangles = [m.triangles.select(of, *[(F.col(n) * 2 + k).alias(n) for n in ("tid", "a", "b", "c")], F.lit(k).alias("label")) for k, m in enumerate((left, right))]
    return MeshFrame(vertices[0].unionByName(vertices[1]), triangles[0].unionByName(triangles[1]))


def deduplicate_vertices(mesh: MeshFrame) -> MeshFrame:
    """Vertices of exactly equal coordinates become the one with the smallest id; -0.0 equals 0.0."""
    zero = [F.when(F.col(n) == 0, F.lit(0.0)).otherwise(F.col(n)).alias(n) for n in "xyz"]
    v = mesh.vertices.select("mesh_id", "vid", *zero)
    kept = v.groupBy("mesh_id", "x", "y", "z").agg(F.min("vid").alias("new"))
    remap = v.join(kept, ["mesh_id", "x", "y", "z"]).select("mesh_id", "vid", "new")
    return MeshFrame(kept.select("mesh_id", F.col("new").alias("vid"), "x", "y", "z"), _remapped(mesh.triangles, remap))


def _remapped(triangles: DataFrame, remap: DataFrame) -> DataFrame:
    rows, names = triangles, triangles.columns
    for corner in "abc":
        rows = rows.join(remap.select("mesh_id", F.col("vid").alias(corner), F.col("new").alias(f"new_{corner}")), ["mesh_id", corner])
    return rows.select(*[F.col(f"new_{n}").alias(n) if n in "abc" else F.col(n) for n in names])


def used_vertices(triangles: DataFrame) -> DataFrame:
    from facetflow.operators.graph import triangle_vertices

    return triangle_vertices(triangles).select("mesh_id", "vid").distinct()


def compact(mesh: MeshFrame) -> tuple[MeshFrame, DataFrame]:
    """Drops vertices that no triangle has and numbers vertices and triangles from 0, in order; also (mesh_id, vid, new).

    Numbers are dense per mesh: a count per range of ids is added up and added on, so no mesh has to fit into a task.
    """
    remap = dense_numbers(used_vertices(mesh.triangles), "vid")
    vertices = mesh.vertices.join(remap, ["mesh_id", "vid"]).select("mesh_id", F.col("new").alias("vid"), "x", "y", "z")
    numbers = dense_numbers(mesh.triangles.select("mesh_id", "tid"), "tid")
    triangles = _remapped(mesh.triangles, remap).join(numbers, ["mesh_id", "tid"]).drop("tid").withColumnRenamed("new", "tid")
    return MeshFrame(vertices, triangles.select(*mesh.triangles.columns)), remap


def dense_numbers(rows: DataFrame, key: str, per_block: int = 1 << 16) -> DataFrame:
    """(mesh_id, key, new): positions from 0 in order of the key, within each mesh."""
    block = F.floor(F.col(key) / per_block)
    at = rows.withColumn("__block", block)
    counts = at.groupBy("mesh_id", "__block").count()
    before = F.coalesce(F.sum("count").over(W.partitionBy("mesh_id").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("mesh_id", "__block", before.alias("__before"))
    inner = F.row_number().over(W.partitionBy("mesh_id", "__block").orderBy(key))
    return at.withColumn("__inner", inner).join(counts, ["mesh_id", "__block"]).select("mesh_id", key, (F.col("__before") + F.col("__inner") - 1).alias("new"))


def extract(mesh: MeshFrame, chosen: DataFrame) -> tuple[MeshFrame, DataFrame]:
    """The sub-mesh of the triangles in ``chosen(mesh_id, tid)``, renumbered, and the map of its vertices."""
    return compact(MeshFrame(mesh.vertices, mesh.triangles.join(chosen, ["mesh_id", "tid"], "left_semi")))


def remove(mesh: MeshFrame, gone: DataFrame) -> tuple[MeshFrame, DataFrame]:
    """Without the triangles in ``gone(mesh_id, tid)``; vertices that are left over go too, the rest is renumbered."""
    return compact(MeshFrame(mesh.vertices, mesh.triangles.join(gone, ["mesh_id", "tid"], "left_anti")))


def invalid_rows(mesh: MeshFrame) -> DataFrame:
    """(mesh_id, kind, id): vertices with coordinates that are null or not finite, triangles with a corner that doesn't exist."""
    finite = " AND ".join(f"{n} IS NOT NULL AND NOT isnan({n}) AND abs({n}) < double('infinity')" for n in "xyz")
    bad = mesh.vertices.where(f"NOT ({finite})").select("mesh_id", F.lit("vertex").alias("kind"), F.col("vid").alias("id"))
    from facetflow.operators.graph import triangle_vertices

    lost = triangle_vertices(mesh.triangles).join(mesh.vertices.select("mesh_id", "vid"), ["mesh_id", "vid"], "left_anti")
    return bad.union(lost.select("mesh_id", F.lit("triangle").alias("kind"), F.col("tid").alias("id")).distinct())


def label_mix(triangles: DataFrame) -> DataFrame:
    """(mesh_id, v0, v1, n_inc, intersects): whether an edge has triangles of more than one label."""
    rows = edges(triangles, keep=["label"]).groupBy("mesh_id", "v0", "v1")
    return rows.agg(F.count("*").alias("n_inc"), (F.min("label") != F.max("label")).alias("intersects"))


def unique_ids(mesh: MeshFrame) -> MeshFrame:
    """Moves each mesh's ids up by the sizes of the meshes before it, so that they are unique over all meshes; one row a mesh is ordered."""
    size = mesh.vertices.groupBy("mesh_id").agg((F.max("vid") + 1).alias("nv")).join(mesh.triangles.groupBy("mesh_id").agg((F.max("tid") + 1).alias("nt")), "mesh_id", "left")
    before = W.orderBy("mesh_id").rowsBetween(W.unboundedPreceding, -1)
    up = size.select("mesh_id", *[F.coalesce(F.sum(F.coalesce(n, F.lit(0))).over(before), F.lit(0)).alias(f"up_{n}") for n in ("nv", "nt")])
    vertices = mesh.vertices.join(up, "mesh_id").withColumn("vid", F.col("vid") + F.col("up_nv")).select(*mesh.vertices.columns)
    triangles = mesh.triangles.join(up, "mesh_id").withColumns({"tid": F.col("tid") + F.col("up_nt"), **{n: F.col(n) + F.col("up_nv") for n in "abc"}})
    return MeshFrame(vertices, triangles.select(*mesh.triangles.columns))
