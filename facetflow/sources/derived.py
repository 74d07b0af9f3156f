"""Meshes made from the tables, in the same way as the SQL in ``facetflow.plans``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Vertices of a row of the height field.
WIDTH = 20
#: Corners of a box as signs, and its twelve outward triangles.
BOX_CORNERS = [(-1, -1, -1), (1, -1, -1), (1, 1, -1), (-1, 1, -1), (-1, -1, 1), (1, -1, 1), (1, 1, 1), (-1, 1, 1)]
BOX_TRIANGLES = [(0, 2, 1), (0, 3, 2), (4, 5, 6), (4, 6, 7), (0, 1, 5), (0, 5, 4), (1, 2, 6), (1, 6, 5), (2, 3, 7), (2, 7, 6), (3, 0, 4), (3, 4, 7)]


@dataclass
class MeshFrame:
    """Any number of meshes: ``vertices(mesh_id, vid, x, y, z)`` and ``triangles(mesh_id, tid, a, b, c)``, more columns may follow."""

    vertices: DataFrame
    triangles: DataFrame

    def where(self, mesh_id: str) -> MeshFrame:
        return MeshFrame(self.vertices.where(F.col("mesh_id") == mesh_id), self.triangles.where(F.col("mesh_id") == mesh_id))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def component(k: int, scale: int) -> Column:
    """An embedding's component on an integer grid, as a double."""
    return F.floor(F.col("embedding")[k].cast("double") * scale).cast("double")


def height_field(spark: SparkSession, sf_dir: str, k: int = 0, grid: int = 1, offset: int = 0, mesh_id: str = "h") -> MeshFrame:
    """An open surface: vector i is the vertex (i mod 20, i div 20), scaled by ``grid`` and moved by ``offset``, at the height of its component k."""
    e = table(spark, sf_dir, "embeddings")
    of = F.lit(mesh_id).alias("mesh_id")
    x = ((F.col("vec_id") % WIDTH) * grid + offset).cast("double")
    y = (F.expr(f"vec_id div {WIDTH}") * grid + offset).cast("double")
    vertices = e.select(of, F.col("vec_id").alias("vid"), x.alias("x"), y.alias("y"), component(k, 1024).alias("z"))
    last = e.agg(F.max("vec_id")).first()[0] or 0
    cells = e.select("vec_id").where((F.col("vec_id") % WIDTH < WIDTH - 1) & (F.col("vec_id") + WIDTH + 1 <= last))
    i = F.col("vec_id")
    corners = F.array(F.struct((2 * i).alias("tid"), i.alias("a"), (i + 1).alias("b"), (i + WIDTH).alias("c")), F.struct((2 * i + 1).alias("tid"), (i + 1).alias("a"), (i + WIDTH + 1).alias("b"), (i + WIDTH).alias("c")))
    return MeshFrame(vertices, cells.select(F.inline(corners)).select(of, "tid", "a", "b", "c"))


def boxes(spark: SparkSession, sf_dir: str) -> MeshFrame:
    """A closed box per vector: its centre three components on a grid of 1/64, its half width 1 to 3 by label; mesh 'b0' to 'b3' by id."""
    e = table(spark, sf_dir, "embeddings")
    of = F.concat(F.lit("b"), (F.col("vec_id") % 4).cast("string")).alias("mesh_id")
    half = (1 + F.col("label") % 3).cast("double")
    corners = F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(float(s)).alias(n) for s, n in zip(signs, "xyz", strict=True)]) for k, signs in enumerate(BOX_CORNERS)])
    v = e.select(of, "vec_id", half.alias("half"), *[component(k, 64).alias(f"c{k}") for k in range(3)], F.explode(corners).alias("p"))
    vertices = v.select("mesh_id", (F.col("vec_id") * 8 + F.col("p.k")).alias("vid"), *[(F.col(f"c{k}") + F.col(f"p.{n}") * F.col("half")).alias(n) for k, n in enumerate("xyz")])
    faces = F.array(*[F.struct(F.lit(j).alias("j"), *[F.lit(q).alias(n) for q, n in zip(abc, "abc", strict=True)]) for j, abc in enumerate(BOX_TRIANGLES)])
    t = e.select(of, "vec_id", F.explode(faces).alias("f"))
    return MeshFrame(vertices, t.select("mesh_id", (F.col("vec_id") * 12 + F.col("f.j")).alias("tid"), *[(F.col("vec_id") * 8 + F.col(f"f.{n}")).alias(n) for n in "abc"]))


def soup(spark: SparkSession, sf_dir: str, ids: int = 700) -> DataFrame:
    """Triangles without coordinates, most edges of which are shared by many: ids from the keys of ``lineitem``."""
    i = table(spark, sf_dir, "lineitem")
    t = i.select(F.lit("s").alias("mesh_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("tid"), (F.col("l_orderkey") % ids).alias("a"), (F.col("l_partkey") % ids).alias("b"), (F.col("l_suppkey") % ids).alias("c"))
    return t.where("a <> b AND b <> c AND a <> c")


#: The same in SQL, as common table expressions.
SQL_HEIGHT = """
hv AS (SELECT vec_id AS vid, CAST(vec_id % 20 AS DOUBLE) AS x, CAST(vec_id // 20 AS DOUBLE) AS y, floor(CAST(embedding[1] AS DOUBLE) * 1024) AS z FROM embeddings),
hc AS (SELECT vec_id AS i FROM embeddings WHERE vec_id % 20 < 19 AND vec_id + 21 <= (SELECT max(vec_id) FROM embeddings)),
ht AS (SELECT 2 * i AS tid, i AS a, i + 1 AS b, i + 20 AS c FROM hc UNION ALL SELECT 2 * i + 1, i + 1, i + 21, i + 20 FROM hc),
tg AS (
  SELECT t.tid, t.a, t.b, t.c, p.x AS ax, p.y AS ay, p.z AS az, q.x AS bx, q.y AS by_, q.z AS bz, r.x AS cx, r.y AS cy, r.z AS cz
  FROM ht AS t JOIN hv AS p ON p.vid = t.a JOIN hv AS q ON q.vid = t.b JOIN hv AS r ON r.vid = t.c),
he AS (
  SELECT tid, 0 AS slot, least(a, b) AS v0, greatest(a, b) AS v1 FROM ht UNION ALL SELECT tid, 1, least(b, c), greatest(b, c) FROM ht
  UNION ALL SELECT tid, 2, least(c, a), greatest(c, a) FROM ht)"""
SQL_SOUP = """
st AS (
  SELECT * FROM (SELECT l_orderkey * 8 + l_linenumber AS tid, l_orderkey % 700 AS a, l_partkey % 700 AS b, l_suppkey % 700 AS c FROM lineitem)
  WHERE a <> b AND b <> c AND a <> c),
se AS (
  SELECT tid, 0 AS slot, least(a, b) AS v0, greatest(a, b) AS v1 FROM st UNION ALL SELECT tid, 1, least(b, c), greatest(b, c) FROM st
  UNION ALL SELECT tid, 2, least(c, a), greatest(c, a) FROM st)"""
SQL_BOXES = f"""
bk AS (SELECT * FROM (VALUES {", ".join(f"({k}, {x}, {y}, {z})" for k, (x, y, z) in enumerate(BOX_CORNERS))}) AS t(k, sx, sy, sz)),
bj AS (SELECT * FROM (VALUES {", ".join(f"({j}, {a}, {b}, {c})" for j, (a, b, c) in enumerate(BOX_TRIANGLES))}) AS t(j, a, b, c)),
be AS (
  SELECT vec_id, 'b' || (vec_id % 4) AS mesh_id, 1.0::DOUBLE + label % 3 AS half, floor(CAST(embedding[1] AS DOUBLE) * 64) AS c0,
    floor(CAST(embedding[2] AS DOUBLE) * 64) AS c1, floor(CAST(embedding[3] AS DOUBLE) * 64) AS c2 FROM embeddings),
bv AS (SELECT mesh_id, vec_id * 8 + k AS vid, c0 + sx * half AS x, c1 + sy * half AS y, c2 + sz * half AS z FROM be, bk),
bt AS (SELECT mesh_id, vec_id * 12 + j AS tid, vec_id * 8 + a AS a, vec_id * 8 + b AS b, vec_id * 8 + c AS c FROM be, bj)"""
