"""Boolean operations on solids: union, difference, intersection and symmetric difference.

Both operands go side by side, their vertices onto one integer grid, moved there by a few steps of a seeded hash. Edges of one
operand that pierce triangles of the other give cut points, each known by its edge and its triangle; triangles that
share two cut points are cut along the segment between them. Cut triangles are triangulated anew, each in a group of its own.
Surfaces between cuts are patches; one ray per patch decides whether it lies inside the other operand. What stays, goes or is
turned is a CASE over (operand, inside).

Every table is keyed by ``mesh_id``: operands of any number of pairs, those with equal ids, are combined at once, and none
depends on its company: each pair has a grid, attempts and a status of its own. A pair whose status isn't OK has no result.
Triangle and vertex ids have to be unique over all meshes of an operand.
"""

from __future__ import annotations

import itertools
import time
from collections import namedtuple
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetflow.functions.quantize import BITS, Quantizer, binary_exponent, grid_exponents, perturbation_budget
from facetflow.functions.vec import V3, Triangle
from facetflow.operators import topology as T
from facetflow.operators.graph import labelled_components
from facetflow.operators.spatial import edge_triangle_pairs, intersection_point, on_grid
from facetflow.operators.tables import write_table
from facetflow.operators.triangulate import TriangulationError, triangulate
from facetflow.sources.derived import MeshFrame

#: Vertices are moved by up to 2^FIRST_BITS steps of the grid at first, and by twice as many in turn while the configuration is degenerate
#: or cut points of a triangle lie too close together to be told apart in doubles, as long as the pair's budget of bits lasts.
FIRST_BITS = 8
#: For each operation: (operand, inside) that stay as they are, and those that stay turned.
RULES = {
    "union": ([(0, 0), (1, 0)], []),
    "difference": ([(0, 0)], [(1, 1)]),
    "intersection": ([(0, 1), (1, 1)], []),
    "symmetric_difference": ([(0, 0), (1, 0)], [(0, 1), (1, 1)]),
}


@dataclass
class Resolved:
    """Both operands cut along each other, in grid coordinates, with label (operand), patch and inside of each triangle.

    ``original`` has the operands' vertices where they were: only predicates see moved ones. ``status``: (mesh_id, exponent,
    status, attempts, seconds, bits_left) of every pair: seconds from the start until its verdict, which it shares with the pairs of its attempt; bits_left by which the perturbation could still have been widened; status OK, DEGENERATE, SUBDIVISION_FAILED, SELF_INTERSECTING_OPERAND or
    EXCESSIVE_DYNAMIC_RANGE_FOR_QUANTIZATION.
    """

    mesh: MeshFrame
    original: DataFrame
    status: DataFrame


def _cut(part: list) -> list[tuple]:
    """Triangulates one cut triangle: its corners, cut points on its edges (slot 0 to 2), inside it (slot -1), and segments."""
    head = part[0]
    corners = [tuple(getattr(head, f"{c}{n}") for n in "xyz") for c in "abc"]
    ids = [head.a, head.b, head.c]
    where = dict(zip(ids, corners, strict=True))
    on_edge: dict[int, set[int]] = {0: set(), 1: set(), 2: set()}
    segments = set()
    for r in part:
        where[r.point] = (r.x, r.y, r.z)
        if r.slot >= 0:
            on_edge[r.slot].add(r.point)
        if r.other_point is not None:
            segments.add(frozenset((r.point, r.other_point)))
    n = [0.0, 0.0, 0.0]
    (ax, ay, az), (bx, by, bz), (cx, cy, cz) = corners
    n = [(by - ay) * (cz - az) - (bz - az) * (cy - ay), (bz - az) * (cx - ax) - (bx - ax) * (cz - az), (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)]
    dim = max(range(3), key=lambda k: abs(n[k]))
    i, j = (dim + 1) % 3, (dim + 2) % 3
    if n[dim] < 0:
        i, j = j, i
    order = list(where)
    at = {v: k for k, v in enumerate(order)}
    lines = []
    for slot, (p, q) in enumerate(((0, 1), (1, 2), (2, 0))):
        start, end = corners[p], corners[q]
        along = lambda v, s=start, e=end: sum((where[v][k] - s[k]) * (e[k] - s[k]) for k in range(3))
        chain = [ids[p], *sorted(on_edge[slot], key=lambda v: (along(v), v)), ids[q]]
        lines += [(at[u], at[v]) for u, v in zip(chain, chain[1:], strict=False)]
    lines += [tuple(at[v] for v in s) for s in sorted(segments, key=sorted) if len(s) == 2]
    try:
        found, status = triangulate([(where[v][i], where[v][j]) for v in order], lines), "ok"
    except TriangulationError as error:
        found, status = [(0, 1, 2)], error.code
    return [(head.mesh_id, head.tid, k, order[a], order[b], order[c], head.label, status) for k, (a, b, c) in enumerate(found)]


_PIECES = {"mesh_id": pa.string(), "tid": pa.int64(), "piece": pa.int32(), "a": pa.int64(), "b": pa.int64(), "c": pa.int64(), "label": pa.int32(), "status": pa.string()}


def _cut_all(batches):
    """Rows in order of their triangle in, pieces out; a triangle's rows are in memory at a time."""
    now, held, out = None, [], []

    def pieces() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * len(_PIECES)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _PIECES.values(), strict=True)], names=list(_PIECES))

    for batch in batches:
        row_of = namedtuple("row_of", batch.schema.names)._make
        for row in map(row_of, zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            if (row.mesh_id, row.tid) != now:
                if held:
                    out.extend(_cut(held))
                now, held = (row.mesh_id, row.tid), []
            held.append(row)
        if len(out) > 10_000:
            yield pieces()
    if held:
        out.extend(_cut(held))
    yield pieces()


def resolve(left: MeshFrame, right: MeshFrame, seed: int = 1, first_bits: int = FIRST_BITS) -> Resolved:
    """Cuts both operands along each other and labels the pieces.

    An attempt takes the pairs that are still open, each on a perturbation as wide as its own budget says; one number of an
    attempt, how many are left, comes to the driver. There are at most 17 attempts.
    """
    both = MeshFrame(*(_with_mesh_ids(left, right, part) for part in ("vertices", "triangles")))
    t = Triangle.of()
    sizes = T.materialize(both).groupBy("mesh_id").agg(F.max(F.greatest(*[x for v in (t.a, t.b, t.c) for x in v.abs().parts()])).alias("largest"), F.sqrt(F.min(F.least(*t.edge_squares()))).alias("shortest"))
    exponent, status = grid_exponents(F.col("largest"), F.col("shortest"))
    begin, ranges = perturbation_budget(binary_exponent(F.col("shortest")) - (F.col("exponent") - BITS), first_bits)
    sizes = sizes.select("mesh_id", "shortest", exponent.alias("exponent"), status.alias("status"))
    grids, _ = write_table(sizes.select("mesh_id", "exponent", "status", begin.alias("begin"), ranges.alias("ranges")))
    todo = grids.where("status = 'OK'").drop("status")
    verdicts, done = [grids.where("status <> 'OK'").select("mesh_id", "status", F.lit(0).alias("attempts"), F.lit(0.0).alias("seconds"))], []
    began = time.monotonic()
    for attempt in itertools.count():
        mesh = MeshFrame(both.vertices.join(todo, "mesh_id"), both.triangles.join(todo.select("mesh_id"), "mesh_id", "left_semi"))
        grid = on_grid(mesh, Quantizer.per_mesh(), seed + attempt, F.expr(f"shiftleft(1L, begin + {attempt})"))
        vertices, _ = write_table(grid.vertices)
        grid = MeshFrame(vertices, grid.triangles)
        pairs, _ = write_table(edge_triangle_pairs(grid, other=None).where("meets OR degenerate AND l_label <> r_label"))
        own = F.col("l_label") == F.col("r_label")
        bad = pairs.groupBy("mesh_id").agg(F.max(own & F.col("meets")).alias("own"), F.max(~own & F.col("degenerate")).alias("degenerate")).where("own OR degenerate")
        bad, _ = write_table(bad.select("mesh_id", F.when(F.col("own"), "SELF_INTERSECTING_OPERAND").otherwise("DEGENERATE").alias("status")))
        cut, failed = _subdivide(grid, pairs.where(~own), bad, attempt)
        failed, _ = write_table(bad.union(failed).join(todo.select("mesh_id", "ranges"), "mesh_id"))
        done.append((*cut, grid, failed))
        final = (F.col("ranges") <= attempt + 1) | (F.col("status") == "SELF_INTERSECTING_OPERAND")
        tries = [F.lit(attempt + 1).alias("attempts"), F.lit(round(time.monotonic() - began, 3)).alias("seconds")]
        verdicts.append(todo.join(failed, "mesh_id", "left_anti").select("mesh_id", F.lit("OK").alias("status"), *tries))
        verdicts.append(failed.where(final).select("mesh_id", "status", *tries))
        still = failed.where(~final)
        if not still.count():
            break
        todo = todo.join(still, "mesh_id", "left_semi")
    verdict = grids.drop("status").join(reduce(DataFrame.union, verdicts), "mesh_id")
    verdict, _ = write_table(verdict.select("mesh_id", "exponent", "status", "attempts", "seconds", F.when(F.col("attempts") > 0, F.col("ranges") - F.col("attempts")).alias("bits_left")))
    many = len(done) > 1
    keep = lambda rows, failed: rows.join(failed, "mesh_id", "left_anti") if many else rows
    vertices, triangles, cuts = (reduce(DataFrame.union, [keep(d[k], d[4]) for d in done]) for k in range(3))
    grid = MeshFrame(*(reduce(DataFrame.union, [keep(getattr(d[3], part), d[4]) for d in done]) for part in ("vertices", "triangles")))
    good = verdict.where("status = 'OK'").select("mesh_id")
    triangles = triangles.join(good, "mesh_id", "left_semi")
    return _label(vertices, triangles, cuts, both.vertices.join(good, "mesh_id", "left_semi"), grid, verdict)


def _with_mesh_ids(left: MeshFrame, right: MeshFrame, part: str) -> DataFrame:
    """The disjoint union with operands' own mesh ids, so that equal ids meet."""
    rows = []
    for k, m in enumerate((left, right)):
        names = ("vid",) if part == "vertices" else ("tid", "a", "b", "c")
        r = getattr(m, part)
        keep = ["x", "y", "z"] if part == "vertices" else []
        label = [] if part == "vertices" else [F.lit(k).alias("label")]
        rows.append(r.select("mesh_id", *[(F.col(n) * 2 + k).alias(n) for n in names], *keep, *label))
    return rows[0].unionByName(rows[1])


def _doubles(mesh: MeshFrame) -> MeshFrame:
    return MeshFrame(mesh.vertices.select("mesh_id", "vid", *V3.of().double().columns("")), mesh.triangles)


def _subdivide(grid: MeshFrame, pairs: DataFrame, bad: DataFrame, attempt: int) -> tuple[tuple[DataFrame, DataFrame, DataFrame], DataFrame]:
    """(vertices, triangles, cut edges) with cut points in, without ``bad`` meshes; and (mesh_id, status) of those that fail."""
    pairs = pairs.join(bad, "mesh_id", "left_anti")
    base = F.lit(attempt << 58)  # ids of attempts are told apart
    spot = intersection_point(V3.of("p"), V3.of("q"), Triangle.of())
    points = pairs.select("mesh_id", "v0", "v1", F.col("tid").alias("hit"), *spot.columns(""))
    points, _ = write_table(points.withColumn("point", -1 - base - F.monotonically_increasing_id()))
    e = T.edges(grid.triangles, keep=["label"]).select("mesh_id", "tid", "slot", "v0", "v1")
    # a cut point lies on the pierced triangle and on every triangle of the piercing edge; each such pair of triangles shares it
    shared = points.join(e, ["mesh_id", "v0", "v1"]).select("mesh_id", "point", "x", "y", "z", F.col("tid").alias("owner"), "slot", "hit")
    shared, _ = write_table(shared)
    both = shared.select("mesh_id", "point", F.least("owner", "hit").alias("t0"), F.greatest("owner", "hit").alias("t1"))
    ends = both.groupBy("mesh_id", "t0", "t1").agg(F.min("point").alias("p0"), F.max("point").alias("p1"), F.count("*").alias("n"))
    segments, _ = write_table(ends.where("n = 2 AND p0 <> p1"))
    on = shared.select("mesh_id", F.col("owner").alias("tid"), "slot", "point", "x", "y", "z").union(shared.select("mesh_id", F.col("hit").alias("tid"), F.lit(-1).alias("slot"), "point", "x", "y", "z")).distinct()
    lines = segments.select("mesh_id", F.explode(F.array("t0", "t1")).alias("tid"), F.col("p0").alias("point"), F.col("p1").alias("other_point")).distinct()
    work = on.join(lines, ["mesh_id", "tid", "point"], "left").join(T.materialize(_doubles(grid), ["label"]), ["mesh_id", "tid"])
    work = work.repartition("mesh_id", "tid").sortWithinPartitions("mesh_id", "tid", "slot", "x", "y", "z", "point")
    pieces = work.mapInArrow(_cut_all, "mesh_id string, tid long, piece int, a long, b long, c long, label int, status string")
    pieces, _ = write_table(pieces)
    failed = pieces.where("status <> 'ok'").select("mesh_id", F.lit("SUBDIVISION_FAILED").alias("status")).distinct()
    whole = grid.triangles.join(pieces.select("mesh_id", "tid").distinct(), ["mesh_id", "tid"], "left_anti")
    triangles = whole.select("mesh_id", "a", "b", "c", "label").union(pieces.select("mesh_id", "a", "b", "c", "label"))
    triangles, _ = write_table(triangles.withColumn("tid", base + F.monotonically_increasing_id()))
    vertices = _doubles(grid).vertices.union(points.select("mesh_id", F.col("point").alias("vid"), "x", "y", "z"))
    cut = segments.select("mesh_id", F.col("p0").alias("v0"), F.col("p1").alias("v1")).distinct()
    return (vertices, triangles, cut), failed


def _label(vertices: DataFrame, triangles: DataFrame, cut: DataFrame, original: DataFrame, grid: MeshFrame, status: DataFrame) -> Resolved:
    mesh = MeshFrame(vertices, triangles)
    # patches: triangles of an operand that share an edge which is no cut
    e = T.edges(triangles, keep=["label"]).join(cut, ["mesh_id", "v0", "v1"], "left_anti")
    first = e.groupBy("mesh_id", "label", "v0", "v1").agg(F.min("tid").alias("low"))
    links = e.join(first, ["mesh_id", "label", "v0", "v1"]).select("mesh_id", F.col("tid").alias("a"), F.col("low").alias("b"))
    patch, _ = write_table(labelled_components(triangles.select(F.col("tid").alias("node")), links, ["mesh_id"]).toDF("tid", "patch"))
    geometry = T.materialize(mesh, ["label"]).join(patch, "tid")
    t = Triangle.of()
    rays = geometry.groupBy("mesh_id", "label", "patch").agg(F.max_by(F.struct(*t.centroid().columns("")), F.struct(t.double_area(), -F.col("tid"))).alias("o"))
    inside = patch.join(_inside(rays.select("mesh_id", "label", "patch", "o.x", "o.y", "o.z"), grid), "patch", "left").select("tid", "patch", F.coalesce("inside", F.lit(0)).alias("inside"))
    labelled, _ = write_table(triangles.join(inside, "tid"))
    return Resolved(MeshFrame(vertices, labelled), original, status)


def _inside(rays: DataFrame, grid: MeshFrame) -> DataFrame:
    """(patch, inside): the winding of the other operand about each point, by a ray along z.

    Points and triangles meet in cells of the xy plane, on levels: cells have the triangles' mean extent, doubled from level to level. A triangle is
    entered on the level whose cells are as large as itself, in four cells at most, a point in one cell of each level that occurs.
    """
    t = Triangle.of()
    box = t.box()
    rows = T.materialize(_doubles(grid), ["label"]).withColumns({"lx": box.low.x, "hx": box.high.x, "ly": box.low.y, "hy": box.high.y, "hz": box.high.z})
    extent = F.greatest(F.col("hx") - F.col("lx"), F.col("hy") - F.col("ly"))
    size = rows.agg(F.avg(extent)).first()[0] or 1.0
    rows = rows.withColumn("level", F.ceil(F.log2(F.greatest(extent / size, F.lit(1.0)))).cast("int"))
    levels = sorted(r[0] for r in rows.select("level").distinct().collect())  # a few dozen numbers
    cell = lambda of: F.floor(F.col(of) / (F.lit(size) * F.pow(F.lit(2.0), F.col("level"))))
    rows = rows.withColumn("gx", F.explode(F.sequence(cell("lx"), cell("hx")))).withColumn("gy", F.explode(F.sequence(cell("ly"), cell("hy")))).withColumnRenamed("label", "of")
    points = rays.select("mesh_id", "label", "patch", *[F.col(n).alias(f"o{n}") for n in "xyz"]).withColumn("level", F.explode(F.array(*map(F.lit, levels or [0]))))
    points = points.withColumns({"gx": cell("ox"), "gy": cell("oy")})
    met = points.join(rows, ["mesh_id", "level", "gx", "gy"]).where("label <> of AND ox BETWEEN lx AND hx AND oy BETWEEN ly AND hy AND hz >= oz")
    o = V3.of("o")
    flat = lambda p, q: (p.x - o.x) * (q.y - o.y) - (p.y - o.y) * (q.x - o.x)
    ab, bc, ca = flat(t.a, t.b), flat(t.b, t.c), flat(t.c, t.a)
    hit = ((ab > 0) & (bc > 0) & (ca > 0)) | ((ab < 0) & (bc < 0) & (ca < 0))
    above = (t.a - o).dot(t.normal()) * F.signum(ab + bc + ca) > 0
    wound = met.where(hit & above).groupBy("patch").agg(F.sum(F.signum(ab + bc + ca)).alias("winding"))
    return wound.select("patch", (F.col("winding") > 0).cast("int").alias("inside"))


def _put_back(resolved: Resolved) -> DataFrame:
    """All vertices in the operands' coordinates."""
    cut = resolved.mesh.vertices.where("vid < 0").join(resolved.status.where("status = 'OK'").select("mesh_id", "exponent"), "mesh_id")
    return resolved.original.union(cut.select("mesh_id", "vid", *Quantizer.per_mesh().back(V3.of()).columns("")))


def volumes(resolved: Resolved) -> DataFrame:
    """(mesh_id, union, difference, intersection, symmetric_difference): volumes of all four results in one pass over the pieces."""
    t, code = Triangle.of(), F.col("label") * 2 + F.col("inside")
    part = t.signed_volume6() / 6

    def total(operation: str):
        stay, turned = ([a * 2 + b for a, b in rule] for rule in RULES[operation])
        return F.sum(F.when(code.isin(stay), part).when(code.isin(turned) if turned else F.lit(False), -part).otherwise(0.0)).alias(operation)

    return T.materialize(MeshFrame(_put_back(resolved), resolved.mesh.triangles), ["label", "inside"]).groupBy("mesh_id").agg(*map(total, RULES))


def rule(operation: str) -> Callable[[Column, Column], Column]:
    """The classifier of one of ``RULES``."""
    stay, turned = ([a * 2 + b for a, b in pairs] for pairs in RULES[operation])

    def classify(label: Column, inside: Column) -> Column:
        code = label * 2 + inside
        return F.when(code.isin(stay), "keep").when(code.isin(turned) if turned else F.lit(False), "flip").otherwise("drop")

    return classify


def select(resolved: Resolved, operation: str | Callable[[Column, Column], Column]) -> MeshFrame:
    """The result of one operation, in the operands' coordinates; resolving once serves all.

    ``operation`` is one of ``RULES`` or a classifier of one's own: from the columns label (operand) and inside (1 within the other
    operand) of each piece it makes a column that says keep, flip (keep with its orientation turned) or drop.
    """
    classify = rule(operation) if isinstance(operation, str) else operation
    rows = resolved.mesh.triangles.withColumn("said", classify(F.col("label"), F.col("inside"))).where("said IN ('keep', 'flip')")
    return MeshFrame(_put_back(resolved), T.flip(rows, F.col("said") == "flip").select("mesh_id", "tid", "a", "b", "c"))


def boolean(left: MeshFrame, right: MeshFrame, operation: str | Callable[[Column, Column], Column]) -> MeshFrame:
    """The result of one operation; pairs that fail have no rows, ``resolve(...).status`` says why."""
    return select(resolve(left, right), operation)
