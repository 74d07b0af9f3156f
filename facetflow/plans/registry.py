"""All registered queries of the mesh engine, and their SQL."""

from __future__ import annotations

from facetflow.plans import regions, relational, scalar, solids, surfaces  # noqa: F401  each registers its queries
from facetflow.plans.scalar import QUERIES, SQL  # noqa: F401


def flagship(spark, sf_dir: str):
    from facetflow.operators import stats
    from facetflow.sources.derived import height_field

    mesh = height_field(spark, sf_dir)
    return stats.geometric_statistics(mesh).join(stats.topological_statistics(mesh.triangles), "mesh_id")
