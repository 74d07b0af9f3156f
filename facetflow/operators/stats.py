"""Geometric and topological statistics, a row per mesh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetflow.functions.vec import Triangle
from facetflow.operators import graph
from facetflow.operators.topology import edge_incidence, materialize
from facetflow.sources.derived import MeshFrame

#: Properties that can be asked for; what is not asked for is not computed.
GEOMETRIC = ("counts", "area", "volume", "edge_lengths", "bbox", "max_abs")


def geometric_statistics(mesh: MeshFrame, properties: tuple[str, ...] = GEOMETRIC) -> DataFrame:
    """num_triangles, num_vertices, area, volume, min_edge, max_edge, bbox, max_abs: one pass over triangles with their corners."""
    t = Triangle.of()
    made = {
        "counts": [F.count("*").alias("num_triangles")],
        "area": [(F.sum(t.double_area()) / 2).alias("area")],
        "volume": [(F.sum(t.signed_volume6()) / 6).alias("volume")],
        "edge_lengths": [F.sqrt(F.min(F.least(*t.edge_squares()))).alias("min_edge"), F.sqrt(F.max(F.greatest(*t.edge_squares()))).alias("max_edge")],
        "bbox": [f(c).alias(f"{side}_{n}") for side, f, corner in (("min", F.min, t.box().low), ("max", F.max, t.box().high)) for c, n in zip(corner.parts(), "xyz", strict=True)],
        "max_abs": [F.max(F.greatest(*[x for v in (t.a, t.b, t.c) for x in v.abs().parts()])).alias("max_abs")],
    }
    rows = materialize(mesh).groupBy("mesh_id").agg(*[c for p in properties for c in made[p]])
    if "counts" in properties:
        rows = rows.join(mesh.vertices.groupBy("mesh_id").agg(F.count("*").alias("num_vertices")), "mesh_id")
    return rows


def topological_statistics(triangles: DataFrame, bodies: bool = False) -> DataFrame:
    """num_edges, num_non_manifold, num_hole_edges, max_incidence, euler, two_manifold; with ``bodies`` also num_bodies."""
    e = edge_incidence(triangles).groupBy("mesh_id").agg(
        F.count("*").alias("num_edges"), F.count_if(F.col("n_inc") != 2).alias("num_non_manifold"), F.count_if(F.col("n_inc") == 1).alias("num_hole_edges"), F.max("n_inc").alias("max_incidence")
    )
    corners = graph.triangle_vertices(triangles).groupBy("mesh_id").agg(F.countDistinct("vid").alias("v"))
    faces = triangles.groupBy("mesh_id").agg(F.count("*").alias("f"))
    rows = e.join(corners, "mesh_id").join(faces, "mesh_id").withColumns({"euler": F.col("v") - F.col("num_edges") + F.col("f"), "two_manifold": F.col("num_non_manifold") == 0}).drop("v", "f")
    if bodies:
        rows = rows.join(graph.bodies(triangles).groupBy("mesh_id").agg(F.countDistinct("body").alias("num_bodies")), "mesh_id")
    return rows
