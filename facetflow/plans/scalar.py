"""Queries of the row-wise operators: projections, exterior algebra, predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetflow.functions import predicates as P
from facetflow.functions.ext import K1
from facetflow.functions.quantize import Quantizer, perturbation, sql_perturbation
from facetflow.functions.vec import V2, V3, Box, Triangle, fdiv, seeded_vector
from facetflow.functions.wide import Wide
from facetflow.operators import topology as T
from facetflow.sources.derived import SQL_HEIGHT, component, height_field, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _points(spark, sf_dir: str, count: int = 3, scale: int = 1024) -> DataFrame:
    """Each vector's first components as points p0, p1, ... on an integer grid."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", *[component(3 * p + k, scale).alias(f"p{p}{n}") for p in range(count) for k, n in enumerate("xyz")])


def _sql_points(count: int = 3, scale: int = 1024) -> str:
    return "p AS (SELECT vec_id, label, " + ", ".join(f"floor(CAST(embedding[{3 * p + k + 1}] AS DOUBLE) * {scale}) AS p{p}{n}" for p in range(count) for k, n in enumerate("xyz")) + " FROM embeddings)"


def _three() -> tuple[V3, V3, V3]:
    return V3.of("p0"), V3.of("p1"), V3.of("p2")


@query(f"""WITH {_sql_points()}
SELECT vec_id, p0x + p1x AS add_x, p0y + p1y AS add_y, p0z + p1z AS add_z, p0x - p1x AS sub_x, p0y - p1y AS sub_y, p0z - p1z AS sub_z,
  p0x * 3 AS mul_x, p0y * 3 AS mul_y, p0z * 3 AS mul_z, p0x / 4 AS div_x, p0y / 4 AS div_y, p0z / 4 AS div_z, -p0x AS neg_x, -p0y AS neg_y, -p0z AS neg_z,
  p0x = p1x AND p0y = p1y AND p0z = p1z AS same, p0x < p1x OR (p0x = p1x AND (p0y < p1y OR (p0y = p1y AND p0z < p1z))) AS before,
  p0x * p0x + p0y * p0y + p0z * p0z AS len2, sqrt(p0x * p0x + p0y * p0y + p0z * p0z) AS len, p0x * p1x + p0y * p1y + p0z * p1z AS dot,
  p0y * p1z - p0z * p1y AS cross_x, p0z * p1x - p0x * p1z AS cross_y, p0x * p1y - p0y * p1x AS cross_z,
  round(p0x / sqrt(p0x * p0x + p0y * p0y + p0z * p0z), 9) AS unit_x
FROM p""")
def vec3_algebra(spark, sf_dir):
    U, V, N = _three()  # noqa: N806
    return _points(spark, sf_dir).select(
        "vec_id", *(U + V).columns("add_"), *(U - V).columns("sub_"), *(U * 3).columns("mul_"), *(U / 4).columns("div_"), *(-U).columns("neg_"), U.equals(V).alias("same"), U.before(V).alias("before"),
        U.len_squared().alias("len2"), U.length().alias("len"), U.dot(V).alias("dot"), *U.cross(V).columns("cross_"), F.round(U.normalized().x, 9).alias("unit_x"),
    )


@query(f"""WITH {_sql_points()}
SELECT vec_id, abs(p0x) AS abs_x, abs(p0y) AS abs_y, abs(p0z) AS abs_z, greatest(p0x, p0y, p0z) AS max_c, least(p0x, p0y, p0z) AS min_c,
  CASE WHEN p0x >= p0y THEN CASE WHEN p0x >= p0z THEN 0 ELSE 2 END ELSE CASE WHEN p0y >= p0z THEN 1 ELSE 2 END END AS max_dim,
  CASE WHEN p0x <= p0y THEN CASE WHEN p0x <= p0z THEN 0 ELSE 2 END ELSE CASE WHEN p0y <= p0z THEN 1 ELSE 2 END END AS min_dim,
  least(p0x, p1x) AS min2_x, least(p0y, p1y) AS min2_y, least(p0z, p1z) AS min2_z, greatest(p0x, p1x, p2x) AS max3_x, greatest(p0y, p1y, p2y) AS max3_y, greatest(p0z, p1z, p2z) AS max3_z,
  CASE label % 3 WHEN 0 THEN p0y WHEN 1 THEN p0z ELSE p0x END AS flat_x, CASE label % 3 WHEN 0 THEN p0z WHEN 1 THEN p0x ELSE p0y END AS flat_y
FROM p""")
def vec3_minmax_dims(spark, sf_dir):
    U, V, N = _three()  # noqa: N806
    flat = U.project(F.col("label") % 3)
    return _points(spark, sf_dir).select("vec_id", *U.abs().columns("abs_"), U.max_component().alias("max_c"), U.min_component().alias("min_c"), U.max_dim().alias("max_dim"), U.min_dim().alias("min_dim"), *U.least(V).columns("min2_"), *U.greatest(V, N).columns("max3_"), *flat.columns("flat_"))


_DET = "p0x * (p1y * p2z - p1z * p2y) + p0y * (p1z * p2x - p1x * p2z) + p0z * (p1x * p2y - p1y * p2x)"


@query(f"WITH {_sql_points()} SELECT vec_id, {_DET} AS det FROM p")
def det3(spark, sf_dir):
    U, V, N = _three()  # noqa: N806
    return _points(spark, sf_dir).select("vec_id", U.det(V, N).alias("det"))


@query(f"""WITH {_sql_points()}
SELECT vec_id, p0x + p1x AS add_x, p0y + p1y AS add_y, p0x - p1x AS sub_x, p0y - p1y AS sub_y, p0x * p1x + p0y * p1y AS dot, p0x * p1y - p0y * p1x AS det,
  p0x * p0x + p0y * p0y AS len2, sqrt(p0x * p0x + p0y * p0y) AS len, least(p0x, p1x) AS min_x, least(p0y, p1y) AS min_y, greatest(p0x, p1x) AS max_x,
  greatest(p0y, p1y) AS max_y, CASE WHEN p0x >= p0y THEN 0 ELSE 1 END AS max_dim, CASE WHEN p0x <= p0y THEN 0 ELSE 1 END AS min_dim, abs(p0x) AS abs_x, abs(p0y) AS abs_y
FROM p""")
def vec2_algebra(spark, sf_dir):
    a, b = V2.of("p0"), V2.of("p1")
    return _points(spark, sf_dir).select("vec_id", *(a + b).columns("add_"), *(a - b).columns("sub_"), a.dot(b).alias("dot"), a.det(b).alias("det"), a.len_squared().alias("len2"), a.length().alias("len"), *a.least(b).columns("min_"), *a.greatest(b).columns("max_"), a.max_dim().alias("max_dim"), a.min_dim().alias("min_dim"), *a.abs().columns("abs_"))


def _sql_random(k: int) -> str:
    return f"-1.0::DOUBLE + 2.0::DOUBLE * (((((vec_id * 1103515245 + {12_345 * (k + 1)}) % 2147483648) * 1103515245 + 12345) % 2147483648) / 2147483648.0::DOUBLE)"


@query(f"SELECT vec_id, {_sql_random(0)} AS x, {_sql_random(1)} AS y, {_sql_random(2)} AS z FROM embeddings")
def random_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", *seeded_vector(F.col("vec_id"), -1.0, 1.0).columns(""))


def _geometry(spark, sf_dir) -> DataFrame:
    return T.materialize(height_field(spark, sf_dir))


_NX, _NY, _NZ = "(by_ - ay) * (cz - az) - (bz - az) * (cy - ay)", "(bz - az) * (cx - ax) - (bx - ax) * (cz - az)", "(bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax)"


@query(f"""WITH {SQL_HEIGHT}, n AS (SELECT *, {_NX} AS nx, {_NY} AS ny, {_NZ} AS nz FROM tg)
SELECT tid, ax - bx AS ab_x, ay - by_ AS ab_y, az - bz AS ab_z, ax - cx AS ac_x, ay - cy AS ac_y, az - cz AS ac_z, bx - cx AS bc_x, by_ - cy AS bc_y, bz - cz AS bc_z,
  nx AS normal_x, ny AS normal_y, nz AS normal_z, nx * nx + ny * ny + nz * nz AS double_area2, round(sqrt(nx * nx + ny * ny + nz * nz), 6) AS double_area FROM n""")
def tri_normal_area(spark, sf_dir):
    t = Triangle.of()
    ab, ac, bc = t.edge_vectors()
    return _geometry(spark, sf_dir).select("tid", *ab.columns("ab_"), *ac.columns("ac_"), *bc.columns("bc_"), *t.normal().columns("normal_"), t.normal().len_squared().alias("double_area2"), F.round(t.double_area(), 6).alias("double_area"))


_EDGES2 = "(bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) + (bz - az) * (bz - az), (cx - bx) * (cx - bx) + (cy - by_) * (cy - by_) + (cz - bz) * (cz - bz), (ax - cx) * (ax - cx) + (ay - cy) * (ay - cy) + (az - cz) * (az - cz)"


@query(f"""WITH {SQL_HEIGHT}
SELECT tid, least(ax, bx, cx) AS min_x, least(ay, by_, cy) AS min_y, least(az, bz, cz) AS min_z, greatest(ax, bx, cx) AS max_x, greatest(ay, by_, cy) AS max_y,
  greatest(az, bz, cz) AS max_z, sqrt(least({_EDGES2})) AS min_edge, sqrt(greatest({_EDGES2})) AS max_edge,
  greatest(abs(ax), abs(ay), abs(az), abs(bx), abs(by_), abs(bz), abs(cx), abs(cy), abs(cz)) AS max_abs FROM tg""")
def tri_bbox(spark, sf_dir):
    t = Triangle.of()
    corners = [x for v in (t.a, t.b, t.c) for x in v.abs().parts()]
    return _geometry(spark, sf_dir).select("tid", *t.box().columns(), F.sqrt(F.least(*t.edge_squares())).alias("min_edge"), F.sqrt(F.greatest(*t.edge_squares())).alias("max_edge"), F.greatest(*corners).alias("max_abs"))


@query(f"""WITH {SQL_HEIGHT},
d AS (SELECT tid, 0 AS slot, a AS p, b AS q, c AS opposite FROM ht UNION ALL SELECT tid, 1, b, c, a FROM ht UNION ALL SELECT tid, 2, c, a, b FROM ht)
SELECT tid, slot, least(p, q) AS v0, greatest(p, q) AS v1, p < q AS forward, opposite, p AS vertex FROM d""")
def edge_slots(spark, sf_dir):
    return T.edges(height_field(spark, sf_dir).triangles).select("tid", "slot", "v0", "v1", "forward", "opposite", F.col("p").alias("vertex"))


@query(f"""WITH {SQL_HEIGHT}, e AS (SELECT f.tid, f.slot, s.tid AS other, s.slot AS other_slot, f.v0, f.v1, s.v0 AS w0, s.v1 AS w1 FROM he AS f JOIN he AS s ON s.tid = f.tid + 1)
SELECT tid, slot, other, other_slot, v0 = w0 AND v1 = w1 AS same_segment, v0 = w0 OR v0 = w1 OR v1 = w0 OR v1 = w1 AS shares_vertex FROM e""")
def edge_relations(spark, sf_dir):
    e = T.edges(height_field(spark, sf_dir).triangles).select("tid", "slot", "v0", "v1")
    o = e.select((F.col("tid") - 1).alias("tid"), F.col("tid").alias("other"), F.col("slot").alias("other_slot"), F.col("v0").alias("w0"), F.col("v1").alias("w1"))
    same, shares = F.expr("v0 = w0 AND v1 = w1"), F.expr("v0 = w0 OR v0 = w1 OR v1 = w0 OR v1 = w1")
    return e.join(o, "tid").select("tid", "slot", "other", "other_slot", same.alias("same_segment"), shares.alias("shares_vertex"))


@query(f"WITH {SQL_HEIGHT} SELECT tid, b + 1000 AS a, a + 1000 AS b, c + 1000 AS c, CAST(tid % 2 AS INTEGER) AS label FROM ht")
def flip_offset(spark, sf_dir):
    return T.offset(T.flip(height_field(spark, sf_dir).triangles), 1000).select("tid", "a", "b", "c", (F.col("tid") % 2).cast("int").alias("label"))


_SQL_BOX = """b AS (SELECT tid, least(ax, bx, cx) AS x0, least(ay, by_, cy) AS y0, least(az, bz, cz) AS z0, greatest(ax, bx, cx) AS x1, greatest(ay, by_, cy) AS y1, greatest(az, bz, cz) AS z1 FROM tg)"""


@query(f"""WITH {SQL_HEIGHT}, {_SQL_BOX}
SELECT tid, (x0 + x1) * 0.5 AS center_x, (y0 + y1) * 0.5 AS center_y, (z0 + z1) * 0.5 AS center_z, x1 - x0 AS dim_x, y1 - y0 AS dim_y, z1 - z0 AS dim_z,
  ((y1 - y0) * (z1 - z0) + (x1 - x0) * (z1 - z0) + (x1 - x0) * (y1 - y0)) * 2 AS surface, (x0 + x1) * 0.5 - (x1 - x0) * 0.5 * 2 AS scaled_min_x, (z0 + z1) * 0.5 + (z1 - z0) * 0.5 * 2 AS scaled_max_z
FROM b""")
def bbox_measures(spark, sf_dir):
    box = Triangle.of().box()
    return _geometry(spark, sf_dir).select("tid", *box.center().columns("center_"), *box.dim().columns("dim_"), box.surface_area().alias("surface"), box.scaled(2.0).low.x.alias("scaled_min_x"), box.scaled(2.0).high.z.alias("scaled_max_z"))


@query(f"""WITH {_sql_points()}, d AS (SELECT vec_id, 2 * p0x + 1 AS x, 2 * p0y + 1 AS y, 2 * p0z + 1 AS z FROM p)
SELECT vec_id, 1.0::DOUBLE / x AS inv_x, 1.0::DOUBLE / y AS inv_y, 1.0::DOUBLE / z AS inv_z, CAST(x < 0 AS INTEGER) AS sign_x, CAST(y < 0 AS INTEGER) AS sign_y, CAST(z < 0 AS INTEGER) AS sign_z FROM d""")
def ray_setup(spark, sf_dir):
    U, V, N = _three()  # noqa: N806
    d = U * 2.0 + V3.lit(1, 1, 1)
    return _points(spark, sf_dir).select("vec_id", *P.inverse_direction(d).columns("inv_"), *[s.alias(f"sign_{n}") for s, n in zip(P.ray_signs(d), "xyz", strict=True)])


@query(f"""WITH {SQL_HEIGHT}, m AS (SELECT greatest(max(abs(x)), max(abs(y)), max(abs(z))) AS big FROM hv),
e AS (SELECT CASE WHEN big = 0 THEN 1 ELSE floor(log2(big)) + 2 END AS bits FROM m)
SELECT vid, CAST(trunc(x * pow(2, 30 - bits)) AS BIGINT) AS qx, CAST(trunc(y * pow(2, 30 - bits)) AS BIGINT) AS qy, CAST(trunc(z * pow(2, 30 - bits)) AS BIGINT) AS qz,
  trunc(z * pow(2, 30 - bits)) * pow(2, bits - 30) AS back_z FROM hv, e""")
def quantize(spark, sf_dir):
    mesh = height_field(spark, sf_dir)
    q = Quantizer.calibrate(mesh)
    grid = q.to_grid(V3.of())
    return mesh.vertices.select("vid", *grid.columns("q"), q.back(grid).z.alias("back_z"))


@query(f"""WITH {SQL_HEIGHT}, m AS (SELECT greatest(max(abs(x)), max(abs(y)), max(abs(z))) AS big FROM hv), e AS (SELECT floor(log2(big)) + 2 AS bits FROM m)
SELECT vid, CAST(trunc(x * pow(2, 30 - bits)) + {sql_perturbation('vid', 0, 9, 8)} AS BIGINT) AS px,
  CAST(trunc(y * pow(2, 30 - bits)) + {sql_perturbation('vid', 1, 9, 8)} AS BIGINT) AS py,
  CAST(trunc(z * pow(2, 30 - bits)) + {sql_perturbation('vid', 2, 9, 8)} AS BIGINT) AS pz FROM hv, e""")
def perturb(spark, sf_dir):
    mesh = height_field(spark, sf_dir)
    moved = Quantizer.calibrate(mesh).to_grid(V3.of()) + perturbation(F.col("vid"), seed=9, quanta=8)
    return mesh.vertices.select("vid", *moved.columns("p"))


@query(f"""WITH {_sql_points()}, n AS (SELECT *, sqrt(p1x * p1x + p1y * p1y + p1z * p1z) AS l FROM p)
SELECT vec_id, round((p0x - p2x) * (p1x / l) + (p0y - p2y) * (p1y / l) + (p0z - p2z) * (p1z / l), 6) AS distance,
  round(p0x - (p1x / l) * ((p0x - p2x) * (p1x / l) + (p0y - p2y) * (p1y / l) + (p0z - p2z) * (p1z / l)), 6) AS on_x FROM n WHERE l > 0""")
def plane_distance(spark, sf_dir):
    U, V, N = _three()  # noqa: N806
    unit = V3(*(fdiv(c, V.length()) for c in V.parts()))
    far = (U - N).dot(unit)
    on = U - unit * far
    return _points(spark, sf_dir).where(V.length() > 0).select("vec_id", F.round(far, 6).alias("distance"), F.round(on.x, 6).alias("on_x"))


@query(f"""WITH {SQL_HEIGHT}, n AS (SELECT *, {_NX} AS nx, {_NY} AS ny, {_NZ} AS nz FROM tg),
d AS (SELECT *, CASE WHEN abs(nx) >= abs(ny) THEN CASE WHEN abs(nx) >= abs(nz) THEN 0 ELSE 2 END ELSE CASE WHEN abs(ny) >= abs(nz) THEN 1 ELSE 2 END END AS dim FROM n)
SELECT tid, dim, CASE dim WHEN 0 THEN ay WHEN 1 THEN az ELSE ax END AS flat_x,
  CASE WHEN CASE dim WHEN 0 THEN nx WHEN 1 THEN ny ELSE nz END < 0 THEN -1 ELSE 1 END * CASE dim WHEN 0 THEN az WHEN 1 THEN ax ELSE ay END AS flat_y FROM d""")
def axis_project(spark, sf_dir):
    t = Triangle.of()
    return _geometry(spark, sf_dir).select("tid", t.normal().abs().max_dim().alias("dim"), *t.project_2d(t.a).columns("flat_"))


@query(f"WITH {SQL_HEIGHT} SELECT tid, a, b, c, ax, ay, az, bx, by_ AS \"by\", bz, cx, cy, cz FROM tg")
def tri_materialize(spark, sf_dir):
    return _geometry(spark, sf_dir).drop("mesh_id")


def _k1(p: int) -> list[str]:
    return [f"p{p}x", f"p{p}y", f"p{p}z", "1"]


def _s11(a: list[str], b: list[str], op: str = "-") -> list[str]:
    return [f"({a[i]}) * ({b[j]}) {op} ({a[j]}) * ({b[i]})" for i, j in ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))]


_J2 = ("01", "02", "03", "12", "13", "23")
_J3 = ("012", "013", "023", "123")


def _s21(e: str, b: list[str]) -> list[str]:
    return [f"{e}{i}{j} * ({b[k]}) - {e}{i}{k} * ({b[j]}) + {e}{j}{k} * ({b[i]})" for i, j, k in ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3))]


def _named(parts: list[str], prefix: str, names: tuple[str, ...]) -> str:
    return ", ".join(f"{x} AS {prefix}{n}" for x, n in zip(parts, names, strict=True))


@query(f"WITH {_sql_points()} SELECT vec_id, {_named(_s11(_k1(0), _k1(1)), 'e', _J2)} FROM p")
def ext_join11(spark, sf_dir):
    U, V, N = _three()  # noqa: N806
    return _points(spark, sf_dir).select("vec_id", *K1.point(U).join(K1.point(V)).columns("e"))


@query(f"WITH {_sql_points()}, e AS (SELECT *, {_named(_s11(_k1(0), _k1(1)), 'e', _J2)} FROM p) SELECT vec_id, {_named(_s21('e', _k1(2)), 't', _J3)} FROM e")
def ext_join21(spark, sf_dir):
    U, V, N = _three()  # noqa: N806
    return _points(spark, sf_dir).select("vec_id", *K1.point(U).join(K1.point(V)).join(K1.point(N)).columns("t"))


def _five(spark, sf_dir):
    points = [K1.point(V3.of(f"p{k}")) for k in range(5)]
    return _points(spark, sf_dir, 5, 64), points


_SQL_FIVE = f"""{_sql_points(5, 64)}, e1 AS (SELECT *, {_named(_s11(_k1(0), _k1(1)), 'e', _J2)}, {_named(_s11(_k1(2), _k1(3)), 'f', _J2)}, {_named(_s11(_k1(0), _k1(2)), 'g', _J2)} FROM p),
e2 AS (SELECT *, {_named(_s21('f', _k1(4)), 't', _J3)}, {_named(_s21('g', _k1(1)), 'u', _J3)} FROM e1)"""
_DUAL_E, _DUAL_T, _DUAL_U = ["e23", "-e13", "e12", "e03", "-e02", "e01"], ["t123", "-t023", "t013", "-t012"], ["u123", "-u023", "u013", "-u012"]


@query(f"""WITH {_SQL_FIVE}, d AS (SELECT vec_id, {_named(_DUAL_E, 'd', _J2)}, {_named(_DUAL_T, 'w', ('0', '1', '2', '3'))} FROM e2),
j AS (SELECT vec_id, {_named(_s21('d', ['w0', 'w1', 'w2', 'w3']), 'j', _J3)} FROM d)
SELECT vec_id, -j123 AS m0, j023 AS m1, -j013 AS m2, j012 AS m3, CASE WHEN j012 <> 0 THEN round(-j123 / j012, 9) END AS point_x FROM j""")
def ext_meet23(spark, sf_dir):
    rows, k = _five(spark, sf_dir)
    m = k[0].join(k[1]).meet(k[2].join(k[3]).join(k[4]))
    return rows.select("vec_id", *m.columns("m"), F.when(m.e[3] != 0, F.round(m.to_point().x, 9)).alias("point_x"))


@query(f"""WITH {_SQL_FIVE}, d AS (SELECT vec_id, {_named(_DUAL_T, 'w', ('0', '1', '2', '3'))}, {_named(_DUAL_U, 'v', ('0', '1', '2', '3'))} FROM e2),
j AS (SELECT vec_id, {_named(_s11(['w0', 'w1', 'w2', 'w3'], ['v0', 'v1', 'v2', 'v3']), 'j', _J2)} FROM d)
SELECT vec_id, j23 AS m01, -j13 AS m02, j12 AS m03, j03 AS m12, -j02 AS m13, j01 AS m23 FROM j""")
def ext_meet33(spark, sf_dir):
    rows, k = _five(spark, sf_dir)
    return rows.select("vec_id", *k[2].join(k[3]).join(k[4]).meet(k[0].join(k[2]).join(k[1])).columns("m"))


def _dots(a: str, b: str, names: tuple[str, ...]) -> str:
    return " + ".join(f"{a}{n} * {b}{n}" for n in names)


@query(f"WITH {_SQL_FIVE} SELECT vec_id, p0x * p1x + p0y * p1y + p0z * p1z + 1 AS inner1, {_dots('e', 'f', _J2)} AS inner2, {_dots('t', 'u', _J3)} AS inner3, false AS same FROM e2")
def ext_inner(spark, sf_dir):
    rows, k = _five(spark, sf_dir)
    e, f = k[0].join(k[1]), k[2].join(k[3])
    t, u = f.join(k[4]), k[0].join(k[2]).join(k[1])
    return rows.select("vec_id", k[0].inner(k[1]).alias("inner1"), e.inner(f).alias("inner2"), t.inner(u).alias("inner3"), k[0].equals(k[1]).alias("same"))


@query(f"""WITH {_SQL_FIVE}
SELECT vec_id, CAST(1 AS DOUBLE) AS a012, -p0z AS a013, p0y AS a023, -p0x AS a123, {_named(_DUAL_E, 'b', _J2)}, {_named(_DUAL_T, 'c', ('0', '1', '2', '3'))}, -t123 AS r0, t023 AS r1, -t013 AS r2, t012 AS r3, -e01 AS n01 FROM e2""")
def ext_dual(spark, sf_dir):
    rows, k = _five(spark, sf_dir)
    e, t = k[0].join(k[1]), k[2].join(k[3]).join(k[4])
    return rows.select("vec_id", *k[0].dual().columns("a"), *e.dual().columns("b"), *t.dual().columns("c"), *t.reverse_dual().columns("r"), e.negate().e[0].alias("n01"))


_ABS = [[f"abs(p{p}x)", f"abs(p{p}y)", f"abs(p{p}z)", "1"] for p in range(3)]
_SABS = [f"e{i}{j} * ({_ABS[2][k]}) + e{i}{k} * ({_ABS[2][j]}) + e{j}{k} * ({_ABS[2][i]})" for i, j, k in ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3))]


@query(f"WITH {_sql_points()}, e AS (SELECT *, {_named(_s11(_ABS[0], _ABS[1], '+'), 'e', _J2)} FROM p) SELECT vec_id, {', '.join('e' + n for n in _J2)}, {_named(_SABS, 't', _J3)} FROM e")
def ext_abs_bounds(spark, sf_dir):
    U, V, N = _three()  # noqa: N806
    k = [K1.point(p).absolute() for p in (U, V, N)]
    e = k[0].join(k[1])
    return _points(spark, sf_dir).select("vec_id", *e.columns("e"), *e.join(k[2]).columns("t"))


@query(f"""WITH {_sql_points()}, i AS (SELECT vec_id, CAST(p0x AS HUGEINT) * 1048576 AS a, CAST(p1x AS HUGEINT) * 1048576 + 7 AS b FROM p)
SELECT vec_id, CAST(a + b AS VARCHAR) AS plus, CAST(a - b AS VARCHAR) AS minus, CAST(-a AS VARCHAR) AS negated, CAST(a * b AS VARCHAR) AS product, CAST(sign(a * b) AS INTEGER) AS signum, a < b AS less FROM i""")
def exact_integers(spark, sf_dir):
    a, b = (F.col(f"p{p}x").cast("decimal(10,0)") * 1048576 + k for p, k in ((0, 0), (1, 7)))
    a, b = a.cast("decimal(18,0)"), b.cast("decimal(18,0)")
    text = lambda x: x.cast("string")
    return _points(spark, sf_dir).select("vec_id", text(a + b).alias("plus"), text(a - b).alias("minus"), text(-a).alias("negated"), text(a * b).alias("product"), F.signum(a * b).cast("int").alias("signum"), (a < b).alias("less"))


@query(f"""WITH {_sql_points()}, i AS (SELECT vec_id, CAST(p0x AS HUGEINT) * 1048576 AS a, CAST(p1x AS HUGEINT) * 1048576 + 7 AS b, CAST(p2x AS HUGEINT) * 99991 AS c FROM p)
SELECT vec_id, CAST(a * b * c AS VARCHAR) AS product, CAST(a * a - b * c AS VARCHAR) AS turned, CAST(-(a * b) AS VARCHAR) AS negated, CAST(sign(a * b * c) AS INTEGER) AS signum,
  CAST(sign(a * b - b * c) AS INTEGER) AS compared, CAST(a * b * c AS DOUBLE) AS size FROM i""")
def wide_integers(spark, sf_dir):
    """Integers of several words: sums, products, signs, order and digits."""
    a, b, c = (F.col(f"p{p}x").cast("bigint") * k + more for p, k, more in ((0, 1048576, 0), (1, 1048576, 7), (2, 99991, 0)))
    a, b, c = Wide.of(a), Wide.of(b), Wide.of(c)
    ab, bc = a * b, b * c
    rows = _points(spark, sf_dir).withColumns({"ab": ab.words, "bc": bc.words, "turned": (t := a.cross(b, c, a)).words})
    rows = rows.withColumn("abc", (abc := ab.named("ab") * c).words)
    ab, bc, abc = ab.named("ab"), bc.named("bc"), abc.named("abc")
    return rows.select("vec_id", abc.to_text().alias("product"), t.named("turned").to_text().alias("turned"), (-ab).to_text().alias("negated"), abc.sign().alias("signum"), ab.compare(bc).alias("compared"), abc.to_double().alias("size"))


@query(f"""WITH {SQL_HEIGHT}, {_SQL_BOX}, r AS (SELECT a.tid, b.tid AS other, a.x0, a.y0, a.z0, a.x1, a.y1, a.z1, b.x0 AS u0, b.y0 AS v0, b.z0 AS w0, b.x1 AS u1, b.y1 AS v1, b.z1 AS w1 FROM b AS a JOIN b ON b.tid = a.tid + 3)
SELECT tid, other, x0 <= u0 AND y0 <= v0 AND z0 <= w0 AND u0 <= x1 AND v0 <= y1 AND w0 <= z1 AS has_corner, x0 <= u0 AND y0 <= v0 AND z0 <= w0 AND u1 <= x1 AND v1 <= y1 AND w1 <= z1 AS contains_box,
  x0 <= u1 AND u0 <= x1 AND y0 <= v1 AND v0 <= y1 AND z0 <= w1 AND w0 <= z1 AS meets, NOT (x0 <= u1 AND u0 <= x1 AND y0 <= v1 AND v0 <= y1 AND z0 <= w1 AND w0 <= z1) AS misses,
  least(x1, u1) < greatest(x0, u0) OR least(y1, v1) < greatest(y0, v0) OR least(z1, w1) < greatest(z0, w0) AS overlap_empty FROM r""")
def bbox_predicates(spark, sf_dir):
    b = _geometry(spark, sf_dir).select("tid", *Triangle.of().box().columns("p_"))
    o = b.toDF("other", *[c.replace("p_", "q_") for c in b.columns[1:]])
    p, q = Box.of("p_"), Box.of("q_")
    return b.join(o, F.col("other") == F.col("tid") + 3).select("tid", "other", p.contains_point(q.low).alias("has_corner"), p.contains(q).alias("contains_box"), p.meets(q).alias("meets"), p.misses(q).alias("misses"), p.intersection(q).is_empty().alias("overlap_empty"))


_RAY = "(9.25, 11.5, -3000.0), direction (0.5, 0.75, 500.0)"


@query(f"""WITH {SQL_HEIGHT}, {_SQL_BOX}, s AS (SELECT tid, (x0 - 9.25::DOUBLE) * 2.0 AS a0, (x1 - 9.25::DOUBLE) * 2.0 AS a1, (y0 - 11.5::DOUBLE) * (1.0::DOUBLE / 0.75) AS b0, (y1 - 11.5::DOUBLE) * (1.0::DOUBLE / 0.75) AS b1,
  (z0 + 3000.0::DOUBLE) * (1.0::DOUBLE / 500) AS c0, (z1 + 3000.0::DOUBLE) * (1.0::DOUBLE / 500) AS c1 FROM b)
SELECT tid, greatest(a0, b0, c0) <= least(a1, b1, c1) AS hit FROM s""")
def ray_bbox(spark, sf_dir):
    hit = P.ray_meets_box(V3.lit(9.25, 11.5, -3000), V3.lit(0.5, 0.75, 500), Triangle.of().box())
    return _geometry(spark, sf_dir).select("tid", hit.alias("hit"))


def quoted(name: str) -> str:
    """A column name in SQL: "by" is a keyword."""
    return f'"{name}"' if name == "by" else name


def _sdet(a: str, b: str, c: str) -> str:
    return _sdet_parts(*([quoted(p + n) for n in "xyz"] for p in (a, b, c)))


def _sdet_parts(a: list[str], b: list[str], c: list[str]) -> str:
    return f"({a[0]} * ({b[1]} * {c[2]} - {b[2]} * {c[1]}) + {a[1]} * ({b[2]} * {c[0]} - {b[0]} * {c[2]}) + {a[2]} * ({b[0]} * {c[1]} - {b[1]} * {c[0]}))"


@query(f"""WITH {SQL_HEIGHT}, s AS (SELECT tid, {", ".join(f"{c}{n}{'_' if c + n == 'by' else ''} - {o} AS {quoted(c + n)}" for c in "abc" for n, o in (("x", "9.25::DOUBLE"), ("y", "11.5::DOUBLE"), ("z", "(-3000.0::DOUBLE)")))},
  0.5::DOUBLE AS dx, 0.75::DOUBLE AS dy, 500.0::DOUBLE AS dz FROM tg),
v AS (SELECT tid, {_sdet('a', 'b', 'd')} AS ab, {_sdet('b', 'c', 'd')} AS bc, -{_sdet('a', 'c', 'd')} AS ca, {_sdet('a', 'b', 'c')} AS w FROM s),
h AS (SELECT *, ab * w >= 0 AND bc * w >= 0 AND ca * w >= 0 AND ab + bc + ca <> 0 AND w / nullif(ab + bc + ca, 0) > 0 AS ok FROM v)
SELECT tid, coalesce(ok, false) AS hit, CASE WHEN ok THEN round(w / (ab + bc + ca), 6) END AS t, CASE WHEN ok THEN round(bc / (ab + bc + ca), 6) END AS bary_x FROM h""")
def ray_triangle(spark, sf_dir):
    hit, t, bary = P.ray_triangle(V3.lit(9.25, 11.5, -3000), V3.lit(0.5, 0.75, 500), Triangle.of())
    return _geometry(spark, sf_dir).select("tid", hit.alias("hit"), F.round(t, 6).alias("t"), F.round(bary.x, 6).alias("bary_x"))


@query(f"""WITH {_sql_points(4, 64)}, d AS (SELECT vec_id,
  (p0x - p2x) * (p3y - p2y) - (p0y - p2y) * (p3x - p2x) AS d1, (p1x - p2x) * (p3y - p2y) - (p1y - p2y) * (p3x - p2x) AS d2,
  (p2x - p0x) * (p1y - p0y) - (p2y - p0y) * (p1x - p0x) AS d3, (p3x - p0x) * (p1y - p0y) - (p3y - p0y) * (p1x - p0x) AS d4 FROM p)
SELECT vec_id, ((d1 < 0 AND d2 > 0) OR (d1 > 0 AND d2 < 0)) AND ((d3 > 0 AND d4 < 0) OR (d3 < 0 AND d4 > 0)) AS crosses FROM d""")
def seg2d_cross(spark, sf_dir):
    a = [V2.of(f"p{k}") for k in range(4)]
    return _points(spark, sf_dir, 4, 64).select("vec_id", P.segments_cross(*a).alias("crosses"))


def _so(a: str, b: str, c: str, d: str) -> str:
    """The orientation determinant in HUGEINT."""
    u, v, w = ([f"({quoted(p + n)} - {quoted(d + n)})" for n in "xyz"] for p in (a, b, c))
    return f"{u[0]} * ({v[1]} * {w[2]} - {v[2]} * {w[1]}) + {u[1]} * ({v[2]} * {w[0]} - {v[0]} * {w[2]}) + {u[2]} * ({v[0]} * {w[1]} - {v[1]} * {w[0]})"


#: meets and degenerate from the signs sp, sq, s1, s2, s3, like ``predicates.pierces``.
SQL_VERDICT = """NOT (sp * sq > 0 OR (least(s1, s2, s3) < 0 AND greatest(s1, s2, s3) > 0)) AS near, sp = 0 OR sq = 0 OR s1 = 0 OR s2 = 0 OR s3 = 0 AS zero"""


def sql_signs(p: str, q: str, a: str, b: str, c: str) -> str:
    s = lambda *x: f"CAST(sign({_so(*x)}) AS INTEGER)"
    return f"{s(a, b, c, p)} AS sp, {s(a, b, c, q)} AS sq, {s(p, q, a, b)} AS s1, {s(p, q, b, c)} AS s2, {s(p, q, c, a)} AS s3"


_SQL_EXACT = f"""p AS (SELECT vec_id, {", ".join(f"CAST(floor(CAST(embedding[{3 * p + k + 1}] AS DOUBLE) * 536870912) AS HUGEINT) AS p{p}{n}" for p in range(5) for k, n in enumerate("xyz"))} FROM embeddings),
s AS (SELECT vec_id, {sql_signs("p0", "p1", "p2", "p3", "p4")} FROM p), r AS (SELECT vec_id, sp, sq, s1, s2, s3, {SQL_VERDICT} FROM s)"""


@query(f"WITH {_SQL_EXACT} SELECT vec_id, sp, sq, s1, s2, s3, near AND NOT zero AS meets, near AND zero AS degenerate FROM r")
def exact_edge_triangle(spark, sf_dir):
    p, q, a, b, c = (P.exact(V3.of(f"p{k}")) for k in range(5))
    meets, degenerate = P.pierces()
    rows = P.with_piercing_signs(_points(spark, sf_dir, 5, 1 << 29), p, q, Triangle(a, b, c))
    return rows.select("vec_id", *P.SIGNS, meets.alias("meets"), degenerate.alias("degenerate"))


@query(f"WITH {_SQL_EXACT} SELECT vec_id, CASE WHEN zero AND near THEN 'maybe' WHEN near THEN 'meets' ELSE 'empty' END AS verdict FROM r")
def filtered_edge_triangle(spark, sf_dir):
    """The floating filter, and the exact signs where it is unsure."""
    p = [V3.of(f"p{k}") for k in range(5)]
    rows = P.with_filtered_verdict(_points(spark, sf_dir, 5, 1 << 29), p[0], p[1], Triangle(*p[2:]), "first")
    rows = P.with_piercing_signs(rows, *(P.exact(x) for x in p[:2]), Triangle(*(P.exact(x) for x in p[2:])))
    meets, degenerate = P.pierces()
    exact = F.when(meets, "meets").when(degenerate, "maybe").otherwise("empty")
    return rows.select("vec_id", F.when(F.col("first") == "maybe", exact).otherwise(F.col("first")).alias("verdict"))
