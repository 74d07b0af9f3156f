"""Batch driver: all ordered pairs of the models in a folder, their boolean operations, and statistics as TSV.

``python -m facetflow.plans.batch --input 'models/*.off' --union --difference --write-results out --write-statistics stats``
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetflow.operators import boolean, stats
from facetflow.operators import topology as T
from facetflow.operators.tables import write_table
from facetflow.operators.repair import close_holes, remove_non_manifold_edges, remove_self_intersections
from facetflow.sources.derived import MeshFrame
from facetflow.sources.off import read_off, write_off

OPERATIONS = tuple(boolean.RULES)


def model_pairs(meshes: MeshFrame) -> tuple[MeshFrame, MeshFrame]:
    """Both operands of every ordered pair of different models, as meshes named ``left~right``: one row a model is paired."""
    names = meshes.vertices.select("mesh_id").distinct()
    pairs = names.withColumnRenamed("mesh_id", "l").join(names.withColumnRenamed("mesh_id", "r"), F.col("l") != F.col("r"))
    pairs = pairs.withColumn("pair", F.concat("l", F.lit("~"), "r"))

    def side(name: str) -> MeshFrame:
        of = pairs.select(F.col(name).alias("mesh_id"), "pair")
        put = lambda rows: rows.join(of, "mesh_id").drop("mesh_id").withColumnRenamed("pair", "mesh_id").select(*rows.columns)
        return T.unique_ids(MeshFrame(put(meshes.vertices), put(meshes.triangles)))

    return side("l"), side("r")


def run(spark: SparkSession, path: str, operations: tuple[str, ...] = OPERATIONS, repair: bool = False) -> tuple[dict[str, MeshFrame], DataFrame]:
    """Results by operation, and a row per pair and operation: status, attempts, seconds until its verdict, vertices and triangles of both operands,
    statistics of the result; all pairs go through each step together, so a pair has no CPU time of its own."""
    meshes = read_off(spark, path)
    if repair:
        meshes = T.unique_ids(meshes)
        meshes = close_holes(remove_self_intersections(remove_non_manifold_edges(meshes)[0])[0])[0]
    began = time.time()
    sides = model_pairs(meshes)
    cut = boolean.resolve(*sides)
    pairs = cut.status.select("mesh_id", "status", "attempts", "bits_left", "seconds")
    for name, side in zip(("left", "right"), sides, strict=True):
        for part in ("vertices", "triangles"):
            pairs = pairs.join(getattr(side, part).groupBy("mesh_id").agg(F.count("*").alias(f"{name}_{part}")), "mesh_id", "left")
    pairs, _ = write_table(pairs)
    results = {name: boolean.select(cut, name) for name in operations}
    rows = None
    for name, mesh in results.items():
        found = stats.geometric_statistics(mesh).join(stats.topological_statistics(mesh.triangles), "mesh_id").withColumn("operation", F.lit(name))
        found = pairs.withColumn("operation", F.lit(name)).join(found, ["mesh_id", "operation"], "left")
        rows = found if rows is None else rows.unionByName(found)
    return results, rows.withColumn("resolve_seconds", F.lit(round(time.time() - began, 3)))


def rollup(rows: DataFrame) -> DataFrame:
    """Per operation and in all: runs, successes and failures by ``status``, two-manifold results, triangles."""
    good = F.col("status") == "OK"
    return rows.rollup("operation").agg(F.count("*").alias("runs"), F.count_if(good).alias("successes"), F.count_if(~good).alias("failures"), F.count_if("two_manifold").alias("two_manifold"), F.sum("num_triangles").alias("triangles"))


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    p.add_argument("--input", required=True)
    p.add_argument("--repair", action="store_true")
    for name in OPERATIONS:
        p.add_argument(f"--{name.replace('_', '-')}", action="store_true")
    p.add_argument("--write-results")
    p.add_argument("--write-statistics")
    a = p.parse_args()
    chosen = tuple(n for n in OPERATIONS if getattr(a, n)) or OPERATIONS
    spark = SparkSession.builder.appName("mesh batch").getOrCreate()
    results, rows = run(spark, a.input, chosen, a.repair)
    if a.write_results:
        for name, mesh in results.items():
            write_off(T.compact(mesh)[0], f"{a.write_results}/{name}")
    if a.write_statistics:
        rows.write.option("sep", "\t").option("header", True).csv(f"{a.write_statistics}/pairs")
        rollup(rows).write.option("sep", "\t").option("header", True).csv(f"{a.write_statistics}/totals")
    else:
        rows.show(100, truncate=False)


if __name__ == "__main__":
    main()
