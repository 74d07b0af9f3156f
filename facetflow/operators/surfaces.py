"""Surfaces as wholes: outside boundaries, the largest connected one, and points where three triangles meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetflow.functions import predicates as P
from facetflow.functions.quantize import Quantizer
from facetflow.functions.vec import V3, Triangle
from facetflow.functions.wide import Wide
from facetflow.operators import loops, planes
from facetflow.operators.graph import edge_components
from facetflow.operators.tables import write_table
from facetflow.operators.topology import edge_incidence, edges, materialize
from facetflow.sources.derived import MeshFrame


def representatives(mesh: MeshFrame, keep: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """(by..., tid, double_area): the largest triangle of each mesh, or of each group of the columns ``by`` (which ``keep`` brings along); of equal ones the first."""
    t, by = Triangle.of(), by or ["mesh_id"]
    rows = materialize(mesh, keep).withColumn("double_area", t.double_area())
    return rows.groupBy(*by).agg(F.max_by("tid", F.struct("double_area", -F.col("tid"))).alias("tid"), F.max("double_area").alias("double_area"))


def mesh_metrics(mesh: MeshFrame) -> DataFrame:
    """(mesh_id, n_vertices, max_abs, box): one aggregate of the vertices."""
    p = V3.of()
    return mesh.vertices.groupBy("mesh_id").agg(
        F.count("*").alias("n_vertices"), F.max(F.greatest(*p.abs().parts())).alias("max_abs"),
        *[f(n).alias(f"{side}_{n}") for side, f in (("min", F.min), ("max", F.max)) for n in "xyz"],
    )


def quantized_edges(mesh: MeshFrame, quantizer: Quantizer) -> DataFrame:
    """(mesh_id, v0, v1, length2): squared lengths of all edges on the grid, in whole steps."""
    grid = quantizer.to_grid(V3.of())
    v = mesh.vertices.select("mesh_id", "vid", *grid.columns(""))
    rows = edge_incidence(mesh.triangles).select("mesh_id", "v0", "v1")
    for end, name in (("p", "v0"), ("q", "v1")):
        rows = rows.join(v.select("mesh_id", F.col("vid").alias(name), *[F.col(n).alias(f"{end}{n}") for n in "xyz"]), ["mesh_id", name])
    d = V3(*((a - b).cast("decimal(18,0)") for a, b in zip(V3.of("p").parts(), V3.of("q").parts(), strict=True)))
    return rows.select("mesh_id", "v0", "v1", d.len_squared().alias("length2"))


def boundary_lengths(mesh: MeshFrame, found: DataFrame) -> DataFrame:
    """Of the loops ``found`` by ``boundary_loops``: (mesh_id, loop_id, n, length, outside): the longest loop of a mesh is its outside boundary; ties go to the first."""
    points = loops.with_coordinates(found.where("status = 'ok'"), mesh.vertices)
    points = points.withColumn("key", F.concat_ws("/", "mesh_id", "loop_id"))
    length = planes.polyline_length(points, "key", "pos").join(points.select("key", "mesh_id", "loop_id").distinct(), "key")
    longest = length.groupBy("mesh_id").agg(F.max_by("key", F.struct("length", "n")).alias("longest"))
    return length.join(longest, "mesh_id").select("mesh_id", "loop_id", "n", "length", (F.col("key") == F.col("longest")).alias("outside"))


def largest_surface(triangles: DataFrame) -> DataFrame:
    """(mesh_id, tid, status): of each mesh's surfaces connected over edges the one with most triangles, of equal ones the first.

    A mesh that has an edge with more than two triangles gives one row without ``tid``, of status NON_MANIFOLD_EDGE; others are ok.
    """
    bad, _ = write_table(edge_incidence(triangles).where("n_inc > 2").select("mesh_id").distinct())
    found = edge_components(triangles.join(bad, "mesh_id", "left_anti"))
    sizes = found.groupBy("mesh_id", "component").agg(F.count("*").alias("n"))
    best = sizes.groupBy("mesh_id").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("component"))
    largest = found.join(best, ["mesh_id", "component"], "left_semi").select("mesh_id", "tid", F.lit("ok").alias("status"))
    return largest.unionByName(bad.select("mesh_id", F.lit(None).cast("long").alias("tid"), F.lit("NON_MANIFOLD_EDGE").alias("status")))


def loop_owners(mesh: MeshFrame, found: DataFrame) -> DataFrame:
    """(mesh_id, loop_id, tid): the triangle that has each loop's first edge."""
    first = found.where("pos = 0").select("mesh_id", "loop_id", F.col("vid").alias("p"))
    second = found.where("pos = 1").select("mesh_id", "loop_id", F.col("vid").alias("q"))
    owner = edges(mesh.triangles).select("mesh_id", "p", "q", "tid")
    return first.join(second, ["mesh_id", "loop_id"]).join(owner, ["mesh_id", "p", "q"]).select("mesh_id", "loop_id", "tid")


#: Pairs of triangles that the third is seen from, in turn, and the ends of a triangle's sides.
_OTHERS = ((1, 2), (2, 0), (0, 1))
_SIDES = ((0, 1), (1, 2), (2, 0))
#: Bound of the rounding error of a side's value in doubles, of the sum of its absolute products: 11 roundings, rounded up.
_SIDE_BOUND = 16 * 2.0**-53
#: The variants of the test: doubles as they come; doubles where their error bound decides, else 'maybe'; integers; the last two in turn.
TRIPLE_TESTS = ("inexact", "filter", "exact", "combined")


def triple_points(rows: DataFrame, names: list[str], test: str = "combined") -> DataFrame:
    """Adds status ('meets', 'empty' or 'degenerate'), stage ('filter' or 'exact': which one decided) and point x, y, z of three triangles.

    ``names`` are the 27 columns of three triangles' corners, integers of 2^29 at most; rows with a null among them get null status.
    ``test`` is one of ``TRIPLE_TESTS``; 'filter' leaves the status 'maybe' where the bound does not decide.

    With f_k(p) the volume that a corner p spans with triangle k, the line in which the planes of triangles i and j meet passes the side from
    q to r at f_i(q) f_j(r) - f_i(r) f_j(q), and a triangle's three values add up to the determinant of the three normals. The planes'
    point is inside the triangle if all three have its sign. Volumes take two 64-bit words, sides some 190 bits. They are found in
    doubles with a bound of their error first; what is not decided by it, and the point of triangles that meet, in wide integers.
    """
    if test not in TRIPLE_TESTS:
        raise ValueError(f"test {test!r} is none of {TRIPLE_TESTS}")
    kept = rows.columns
    # without nulls generated code needs no checks for each operation
    rows = rows.select("*", *[F.coalesce(F.col(n).cast("bigint"), F.lit(0).cast("bigint")).alias(f"_p{k}") for k, n in enumerate(names)], (F.greatest(*[F.col(n).isNull() for n in names]) == F.lit(False)).alias("_known"))
    corners = [[V3(*(F.col(f"_p{9 * k + 3 * c + i}") for i in range(3))) for c in range(3)] for k in range(3)]
    normals = {f"_n{k}{i}": x for k, (a, b, c) in enumerate(corners) for i, x in zip("xyz", (b - a).cross(c - a).parts(), strict=True)}
    rows = rows.withColumns(normals)
    seen = [(k, t, c) for t in range(3) for k in range(3) if k != t for c in range(3)]  # triangle k from corner c of triangle t
    # as text: hundreds of columns made one by one would take seconds
    away = {(k, t, c): [f"(_p{9 * t + 3 * c + i} - _p{9 * k + i})" for i in range(3)] for k, t, c in seen}
    doubles = {}
    for k, t, c in seen:
        parts = [f"double(_n{k}{n}) * {d}" for n, d in zip("xyz", away[k, t, c], strict=True)]
        doubles[f"_f{k}{t}{c}"] = F.expr(" + ".join(parts))
        doubles[f"_g{k}{t}{c}"] = F.expr(" + ".join(f"abs({x})" for x in parts))
    rows = rows.withColumns(doubles)
    bounded = test != "inexact"
    sides = {}
    for t, (i, j) in enumerate(_OTHERS):
        for e, (q, r) in enumerate(_SIDES):
            a, b, c, d = f"{i}{t}{q}", f"{j}{t}{r}", f"{i}{t}{r}", f"{j}{t}{q}"
            sides[f"_s{t}{e}"] = F.expr(f"_f{a} * _f{b} - _f{c} * _f{d}")
            sides[f"_b{t}{e}"] = F.expr(f"(_g{a} * _g{b} + _g{c} * _g{d}) * {_SIDE_BOUND if bounded else 0.0!r}D")
    rows = rows.withColumns(sides)
    whole = F.col("_s00") + F.col("_s01") + F.col("_s02")
    slack = F.col("_b00") + F.col("_b01") + F.col("_b02") + (F.abs("_s00") + F.abs("_s01") + F.abs("_s02")) * (_SIDE_BOUND if bounded else 0.0)
    signed = lambda x, bound: F.expr(f"CASE WHEN {x} > {bound} THEN 1 WHEN {x} < -{bound} THEN -1 ELSE 0 END")  # noqa: E731  0: not sure
    rows = rows.withColumns({"_s": whole, "_b": slack})
    rows = rows.withColumns({"_w": signed("_s", "_b")} | {f"_c{n[2:]}": signed(n, f"_b{n[2:]}") for n in sides if n[1] == "s"})
    rows = rows.withColumn("_worst", F.expr("least({})".format(", ".join(f"_c{n[2:]} * _w" for n in sides if n[1] == "s"))))
    quick = F.when(~F.col("_known"), None).when(F.col("_worst") < 0, "empty").when(F.col("_worst") > 0, "meets")
    quick = {"exact": F.lit(None).cast("string"), "inexact": F.when(F.col("_known"), F.coalesce(quick, F.lit("degenerate")))}.get(test, quick)
    rows = rows.withColumn("_quick", quick)
    if test == "filter":
        return rows.select(*kept, F.when(F.col("_known"), F.coalesce("_quick", F.lit("maybe"))).alias("status"), F.when(F.col("_quick").isNotNull(), "filter").alias("stage"))
    if test == "inexact":
        return rows.select(*kept, F.col("_quick").alias("status"), *_weighted(corners[0], [F.when(F.col("_quick") == "meets", F.col(f"_s0{e}") / F.col("_s")) for e in range(3)]))
    # from here on rows that the filter has found empty are null, which skips the arithmetic
    rows = rows.withColumn("_open", F.col("_known") & F.coalesce(F.col("_quick") == "meets", F.lit(True)))
    # one expression for all volumes and one for all sides, looped over as arrays, so that generated code stays small
    v = lambda x: Wide.of_two(*P.triple(*(V3(*(x[f"{of}{n}"] for n in "xyz")) for of in "dn")))
    asked = [F.expr("named_struct({})".format(", ".join(f"'d{n}', {d}, 'n{n}', _n{at[0]}{n}" for n, d in zip("xyz", away[at], strict=True)))) for at in seen]
    rows = rows.withColumn("_v", F.when(F.col("_open"), F.transform(F.array(*asked), lambda x: v(x).words)))
    four = [{"iq": (i, t, q), "ir": (i, t, r), "jq": (j, t, q), "jr": (j, t, r)} for t, (i, j) in enumerate(_OTHERS) for q, r in _SIDES]
    side = lambda x: Wide(x["iq"], 4).cross(Wide(x["ir"], 4), Wide(x["jq"], 4), Wide(x["jr"], 4))
    asked = F.array(*[F.expr("named_struct({})".format(", ".join(f"'{n}', _v[{seen.index(at)}]" for n, at in x.items()))) for x in four])
    rows = rows.withColumn("_e", F.when(F.col("_open"), F.transform(asked, lambda x: side(x).words)))
    size = 8  # words of a side
    first = [Wide(F.get("_e", F.lit(e)), size) for e in range(3)]
    total = first[0] + first[1] + first[2]
    rows = rows.withColumn("_t", F.when(F.col("_open"), total.words))
    total = total.named("_t")
    worst = F.array_min(F.transform("_e", lambda x: Wide(x, size).sign())), F.array_max(F.transform("_e", lambda x: Wide(x, size).sign()))
    rows = rows.withColumns({"_z": F.when(F.col("_open"), total.sign()), "_low": worst[0], "_high": worst[1]})
    worst = F.when(F.col("_z") > 0, F.col("_low")).otherwise(-F.col("_high"))
    known = F.when(F.col("_z") == 0, "degenerate").when(worst < 0, "empty").when(worst > 0, "meets").otherwise("degenerate")
    rows = rows.withColumns({"status": F.coalesce("_quick", F.when(F.col("_open"), known)), "stage": F.when(F.col("_quick").isNotNull(), "filter").when(F.col("_open"), "exact")})
    rows = rows.withColumns({f"_q{e}": F.when(F.col("status") == "meets", first[e].to_double() / total.to_double()) for e in range(3)})
    return rows.select(*kept, "status", "stage", *_weighted(corners[0], [F.col(f"_q{e}") for e in range(3)]))


def _weighted(corners: list[V3], sides: list[Column]) -> list[Column]:
    """The point of a triangle by its sides' shares of the whole: the side ab is c's, ca is b's."""
    a, b, c = (v.double() for v in corners)
    p = a + (b - a) * sides[2] + (c - a) * sides[0]
    return p.columns("")
