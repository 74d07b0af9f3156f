"""Repair of regions beside their mesh: gaps filled, open surfaces, single defects on a patch, trials of many candidates.

Everything is keyed by mesh and region: any number of candidates is worked on side by side, and what becomes of one does not
depend on the others. Loops are matched and holes closed as groups; no region passes through the driver.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetflow.functions.quantize import Quantizer
from facetflow.operators import graph as G
from facetflow.operators import topology as T
from facetflow.operators.loops import boundary_loops, with_coordinates
from facetflow.operators.repair import closed_loops, self_intersecting_regions, with_triangles
from facetflow.operators.spatial import self_intersections, with_exponents
from facetflow.operators.surfaces import boundary_lengths
from facetflow.operators.tables import write_table
from facetflow.sources.derived import MeshFrame

#: A region of more boundaries is left as it is.
MOST_BOUNDARIES = 6
#: Triangles that may come into a region.
MOST_FILLED = 500
#: Lengths of a boundary before and after may differ by this.
SAME_LENGTH = 1e-6


def apart(mesh: MeshFrame, member: DataFrame) -> MeshFrame:
    """The sub-meshes of ``member(mesh_id, region, tid)`` as meshes of their own, named region/mesh.

    Ids are unique over all of them. Vertices have their mesh's ``exponent``, ``of`` and ``source_vid``, triangles ``of``, ``region`` and ``source_tid``.
    """
    name = F.concat_ws("/", "region", "of").alias("mesh_id")
    rows = member.select("mesh_id", "region", "tid").join(mesh.triangles.select("mesh_id", "tid", "a", "b", "c"), ["mesh_id", "tid"]).withColumnRenamed("mesh_id", "of")
    triangles, _ = write_table(rows.select(name, "of", "region", "tid", F.col("tid").alias("source_tid"), "a", "b", "c"))
    used = triangles.select("mesh_id", "of", F.explode(F.array("a", "b", "c")).alias("vid")).distinct()
    own = with_exponents(mesh).vertices.withColumnRenamed("mesh_id", "of").select("of", "vid", F.col("vid").alias("source_vid"), "x", "y", "z", "exponent")
    vertices, _ = write_table(used.join(own, ["of", "vid"]).select("mesh_id", "vid", "x", "y", "z", "of", "source_vid", "exponent"))
    parts = T.unique_ids(MeshFrame(vertices, triangles))
    return MeshFrame(write_table(parts.vertices)[0], write_table(parts.triangles)[0])


def rings(corners: DataFrame, seeds: DataFrame, layers: int) -> DataFrame:
    """(mesh_id, region, tid, layer): each region's seeds as layer 0 and ``layers`` rings around them, by ``corners(mesh_id, tid, vid)``.

    Vertices are reached from vertices beside them, which are found once: a round joins its front to these. What it reaches lies in the front, in
    the one before or in neither, so only these are compared and no round's work grows with the rounds before. Each front is written. Triangles
    are looked up at the end: a triangle's ring is one more than that of its nearest vertex.
    """
    key = ["mesh_id", "region"]
    first, _ = write_table(seeds.select(*key, "tid").distinct())
    start = first.select("*", F.lit(0).alias("layer"))
    if not layers:
        return start
    corners, _ = write_table(corners.select("mesh_id", "tid", "vid"))
    beside = corners.join(corners.withColumnRenamed("vid", "other"), ["mesh_id", "tid"]).where("vid <> other").select("mesh_id", "vid", "other").distinct()
    beside = write_table(beside)[0] if layers > 1 else beside
    at, _ = write_table(first.join(corners, ["mesh_id", "tid"]).select(*key, "vid").distinct())
    fronts = [at.limit(0), at]
    for _ in range(1, layers):
        new = fronts[-1].join(beside, ["mesh_id", "vid"]).select(*key, F.col("other").alias("vid")).distinct()
        fronts.append(write_table(new.join(fronts[-1].unionByName(fronts[-2]), [*key, "vid"], "left_anti"))[0])
    reached = fronts[1].withColumn("layer", F.lit(1))
    for k, front in enumerate(fronts[2:], 2):
        reached = reached.unionByName(front.withColumn("layer", F.lit(k)))
    around = reached.join(corners, ["mesh_id", "vid"]).groupBy(*key, "tid").agg(F.min("layer").alias("layer"))
    return start.unionByName(around.join(first, [*key, "tid"], "left_anti"))


def _loops(mesh: MeshFrame) -> tuple[DataFrame, DataFrame]:
    """Boundary loops, written, and (mesh_id, loop_id, n, length, outside)."""
    found, _ = write_table(boundary_loops(mesh.triangles))
    return found, write_table(boundary_lengths(mesh, found))[0]


def _subsets(count: int) -> list[tuple[int, ...]]:
    """Sets of boundaries that may bound a region, smaller ones first."""
    return [x for size in range(1, count + 1) for x in combinations(range(count), size)]


def _grown(first: DataFrame, own: DataFrame, links: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """What is reached over edges behind each boundary (mesh_id, region, k), its region left out; and the boundaries where it passes ``most``.

    Neighbours of a front lie in it, in the one before or in the next one, so that only these are compared.
    """
    grow = ["mesh_id", "region", "k"]
    before, front, member = first.limit(0), first, first
    over = member.groupBy(*grow).count().where(F.col("count") > most).select(*grow)
    while front.limit(1).count():
        new = front.join(over, grow, "left_anti").join(links, ["mesh_id", "tid"]).select(*grow, F.col("other").alias("tid")).distinct()
        new = new.join(own, ["mesh_id", "region", "tid"], "left_anti")
        before, front = front, write_table(new.join(front.unionByName(before), [*grow, "tid"], "left_anti"))[0]
        member = member.unionByName(front)
        over = member.groupBy(*grow).count().where(F.col("count") > most).select(*grow)
    over, _ = write_table(over)
    return write_table(member.join(over, grow, "left_anti"))[0], over


def scrub_regions(mesh: MeshFrame, regions: DataFrame, most_filled: int = MOST_FILLED) -> tuple[DataFrame, DataFrame]:
    """Fills the gaps that ``regions(mesh_id, region, tid)`` enclose, as regions merged of several may.

    A region's boundaries are ordered by length, longest first. Of the sets of boundaries, smaller ones first, the first one is taken that holds
    the region and all that is reached from it over its other boundaries, if that is ``most_filled`` triangles at most.
    Returns the regions and (mesh_id, region, boundaries, filled, status): ok, TOO_MANY_BOUNDARIES (over six: left as it is), or
    NOT_CLOSED, NO_BOUNDARY (dropped, and left as it is).

    What lies behind each boundary is grown by edges, all regions' boundaries at once; a growth ends as it passes the limit.
    """
    key = ["mesh_id", "region"]
    regions, _ = write_table(regions.select(*key, "tid").distinct())
    parts = apart(mesh, regions)
    found, lengths = _loops(parts)
    of = parts.triangles.select("mesh_id", "of", "region").distinct()
    bad = found.where("status <> 'ok'").select("mesh_id").distinct()
    order = F.row_number().over(W.partitionBy("mesh_id").orderBy(F.desc("length"), F.desc("n"), "loop_id")) - 1
    ordered = lengths.join(bad, "mesh_id", "left_anti").join(of, "mesh_id").select("mesh_id", "of", "region", "loop_id", order.alias("k"))
    counts = ordered.groupBy("of", "region").agg(F.count("*").alias("boundaries"))
    several, _ = write_table(ordered.join(counts.where(F.col("boundaries").between(2, MOST_BOUNDARIES)), ["of", "region"]))

    # the triangles across each edge of these boundaries
    at = found.where("status = 'ok'").join(several, ["mesh_id", "loop_id"])
    pos = at.select("mesh_id", "of", "region", "k", "loop_id", "pos", "vid")
    size = pos.groupBy("mesh_id", "loop_id").agg(F.count("*").alias("n"))
    after = pos.select("mesh_id", "loop_id", F.col("pos").alias("next"), F.col("vid").alias("q"))
    steps = pos.join(size, ["mesh_id", "loop_id"]).withColumn("next", (F.col("pos") + 1) % F.col("n")).join(after, ["mesh_id", "loop_id", "next"])
    source = parts.vertices.select("mesh_id", "vid", "source_vid")
    for end in ("vid", "q"):
        steps = steps.join(source.select("mesh_id", F.col("vid").alias(end), F.col("source_vid").alias(f"of_{end}")), ["mesh_id", end])
    rim = steps.select(F.col("of").alias("mesh_id"), "region", "k", F.least("of_vid", "of_q").alias("v0"), F.greatest("of_vid", "of_q").alias("v1"))
    around, _ = write_table(T.edges(mesh.triangles).select("mesh_id", "tid", "v0", "v1"))
    own = regions.select(*key, "tid")
    first, _ = write_table(rim.join(around, ["mesh_id", "v0", "v1"]).select(*key, "k", "tid").distinct().join(own, [*key, "tid"], "left_anti"))
    links = around.join(around.withColumnRenamed("tid", "other"), ["mesh_id", "v0", "v1"]).where("tid <> other").select("mesh_id", "tid", "other")
    # the longest boundary alone comes first of all sets: what lies behind it is asked for only where that set does not hold
    closed, unbounded = _grown(first.where("k > 0"), own, links, most_filled)
    wide = closed.select(*key, "tid").distinct().groupBy(*key).count().where(F.col("count") > most_filled).select(*key)
    further, _ = write_table(unbounded.select(*key).union(wide).distinct())
    if further.limit(1).count():
        behind = _grown(first.where("k = 0").join(further, key, "left_semi"), own, links, most_filled)
        closed, unbounded = closed.unionByName(behind[0]), unbounded.unionByName(behind[1])

    # a set of boundaries holds a region if nothing that passes the limit is reached over the others
    several_of = several.select(F.col("of").alias("mesh_id"), "region", "boundaries").distinct()
    bit = F.pow(F.lit(2), F.col("k")).cast("int")
    unbounded = unbounded.groupBy(*key).agg(F.bit_or(bit).alias("unbounded"))
    sets = F.array(*[F.struct(F.lit(n).alias("of"), F.lit(i).alias("i"), F.lit(sum(1 << x for x in s)).alias("kept")) for n in range(2, MOST_BOUNDARIES + 1) for i, s in enumerate(_subsets(n))])
    tried = several_of.join(unbounded, key, "left").select(*key, F.coalesce("unbounded", F.lit(0)).alias("unbounded"), F.explode(F.filter(sets, lambda s: s["of"] == F.col("boundaries"))).alias("s"))
    tried = tried.select(*key, "s.i", "s.kept", "unbounded").where(F.col("unbounded").bitwiseAND(F.bitwise_not("kept")) == 0)
    through = tried.join(closed, key).where(F.col("kept").bitwiseAND(bit) == 0)
    amount = through.groupBy(*key, "i").agg(F.count_distinct("tid").alias("filled"))
    fits = tried.join(amount, [*key, "i"], "left").where(F.coalesce("filled", F.lit(0)) <= most_filled)
    chosen, _ = write_table(fits.groupBy(*key).agg(F.min(F.struct("i", "kept")).alias("s")).select(*key, "s.kept"))
    new, _ = write_table(closed.join(chosen, key).where(F.col("kept").bitwiseAND(bit) == 0).select(*key, "tid").distinct())

    dropped = bad.join(of, "mesh_id").select(F.col("of").alias("mesh_id"), "region", F.lit("NOT_CLOSED").alias("bad"))
    n = counts.select(F.col("of").alias("mesh_id"), "region", "boundaries")
    status = regions.select(*key).distinct().join(n, key, "left").join(dropped, key, "left").join(new.groupBy(*key).agg(F.count("*").alias("filled")), key, "left")
    said = F.coalesce("bad", F.when(F.col("boundaries") > MOST_BOUNDARIES, "TOO_MANY_BOUNDARIES").when(F.col("boundaries").isNull(), "NO_BOUNDARY").otherwise("ok"))
    status, _ = write_table(status.select(*key, F.coalesce("boundaries", F.lit(0)).alias("boundaries"), F.coalesce("filled", F.lit(0)).alias("filled"), said.alias("status")))
    kept = regions.unionByName(new).join(status.where("status <> 'NOT_CLOSED'"), key, "left_semi")
    return kept, status


def _crossings(mesh: MeshFrame, name: str) -> DataFrame:
    return self_intersections(mesh, Quantizer.per_mesh()).groupBy("mesh_id").agg(F.count("*").alias(name))


def _main_part(triangles: DataFrame, at: DataFrame | None) -> DataFrame:
    """(mesh_id, tid) of the part connected over edges that holds a triangle of ``at(mesh_id, tid)``, or of the largest part."""
    found, _ = write_table(G.edge_components(triangles))
    if at is None:
        sizes = found.groupBy("mesh_id", "component").agg(F.count("*").alias("n"))
        chosen = sizes.groupBy("mesh_id").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("component"))
    else:
        chosen = found.join(at, ["mesh_id", "tid"], "left_semi").groupBy("mesh_id").agg(F.min("component").alias("component"))
    return found.join(chosen, ["mesh_id", "component"], "left_semi").select("mesh_id", "tid")


def _filled(mesh: MeshFrame, loops: DataFrame) -> tuple[MeshFrame, DataFrame]:
    """The mesh with the ``loops`` closed, and (mesh_id, holes, filled)."""
    patches, _ = write_table(closed_loops(with_coordinates(loops, mesh.vertices)))
    told = patches.select("mesh_id", "loop_id", "status").distinct().groupBy("mesh_id").agg(F.count("*").alias("holes"), F.count_if(F.col("status") == "ok").alias("filled"))
    return with_triangles(mesh, patches.where("status = 'ok'")), told


def _zero(*names: str) -> list[Column]:
    return [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in names]


def repair_surfaces(mesh: MeshFrame) -> tuple[MeshFrame, DataFrame]:
    """Takes self-intersections out of open surfaces, each mesh by itself, and closes the holes that this makes, but no other.

    Triangles at a piercing edge and pierced ones go with a ring around them, and what is then cut off from the outside
    boundary, a mesh's longest loop. That loop has to be left as it was, and so have the holes: a loop is known again by its first
    vertex, its number of edges and its length to 1e-6. Returns the meshes and a row each: (mesh_id, status, before, after, removed, loose, holes,
    filled). Status: ok; CLEAN (no self-intersection), NO_BOUNDARY (closed, or loops that don't close), OUTSIDE_BOUNDARY_BROKEN, HOLE_LOST,
    HOLE_NOT_CLOSED, STILL_INTERSECTING: these meshes are as before.

    Vertex and triangle ids are unique over meshes (``topology.unique_ids``).
    """
    mesh = MeshFrame(write_table(with_exponents(mesh).vertices)[0], mesh.triangles.select("mesh_id", "tid", "a", "b", "c"))
    found, _ = write_table(self_intersections(mesh, Quantizer.per_mesh()))
    todo = found.select("mesh_id").distinct()
    some = MeshFrame(mesh.vertices.join(todo, "mesh_id", "left_semi"), write_table(mesh.triangles.join(todo, "mesh_id", "left_semi"))[0])
    loops, before = _loops(some)
    broken = loops.where("status <> 'ok'").select("mesh_id").distinct()
    sharing = found.join(T.edges(some.triangles).select("mesh_id", "v0", "v1", F.col("tid").alias("at")), ["mesh_id", "v0", "v1"])
    seeds = sharing.select("mesh_id", F.col("at").alias("tid")).union(found.select("mesh_id", "tid")).distinct()
    gone = rings(G.triangle_vertices(some.triangles), seeds.select("mesh_id", F.lit(0).alias("region"), "tid"), 1).select("mesh_id", "tid")
    gone, _ = write_table(gone)
    left, _ = write_table(some.triangles.join(gone, ["mesh_id", "tid"], "left_anti"))

    outer = loops.join(before.where("outside"), ["mesh_id", "loop_id"], "left_semi")
    at = _owners(left, outer)
    main, _ = write_table(_main_part(left, at))
    kept = MeshFrame(some.vertices, write_table(left.join(main, ["mesh_id", "tid"], "left_semi"))[0])
    again, after = _loops(kept)
    was = before.select("mesh_id", "loop_id", "n", F.col("length").alias("was"), F.col("outside").alias("outer"))
    known = after.join(was, ["mesh_id", "loop_id", "n"]).where(F.abs(F.col("length") - F.col("was")) <= SAME_LENGTH).select("mesh_id", "loop_id", "outer")
    known, _ = write_table(known)
    judged = before.groupBy("mesh_id").agg(F.count("*").alias("loops"))
    judged = judged.join(known.groupBy("mesh_id").agg(F.count("*").alias("same"), F.max("outer").alias("whole")), "mesh_id", "left")
    new = again.where("status = 'ok'").join(known.select("mesh_id", "loop_id"), ["mesh_id", "loop_id"], "left_anti")
    stuck = again.where("status <> 'ok'").select("mesh_id").distinct().withColumn("stuck", F.lit(True))
    intact = judged.where("whole AND same = loops").select("mesh_id").join(stuck, "mesh_id", "left_anti").join(broken, "mesh_id", "left_anti")
    intact, _ = write_table(intact)
    trial = MeshFrame(kept.vertices.join(intact, "mesh_id", "left_semi"), kept.triangles.join(intact, "mesh_id", "left_semi"))
    trial, told = _filled(trial, new.join(intact, "mesh_id", "left_semi"))

    status = mesh.vertices.select("mesh_id").distinct().join(found.groupBy("mesh_id").agg(F.count("*").alias("before")), "mesh_id", "left")
    removed = gone.groupBy("mesh_id").agg(F.count("*").alias("removed"))
    loose = left.join(main, ["mesh_id", "tid"], "left_anti").groupBy("mesh_id").agg(F.count("*").alias("loose"))
    for more in (judged, stuck, removed, loose, told, _crossings(trial, "after"), intact.withColumn("intact", F.lit(True)), broken.withColumn("broken", F.lit(True))):
        status = status.join(more, "mesh_id", "left")
    said = (
        F.when(F.col("before").isNull(), "CLEAN").when(F.col("broken") | F.col("loops").isNull(), "NO_BOUNDARY").when(~F.coalesce("whole", F.lit(False)), "OUTSIDE_BOUNDARY_BROKEN")
        .when(F.col("same") < F.col("loops"), "HOLE_LOST").when(F.col("stuck") | (F.col("filled") < F.col("holes")), "HOLE_NOT_CLOSED").when(F.col("after") > 0, "STILL_INTERSECTING").otherwise("ok")
    )
    status, _ = write_table(status.select("mesh_id", said.alias("status"), *_zero("before", "after", "removed", "loose", "holes", "filled")))
    ok = status.where("status = 'ok'").select("mesh_id")
    triangles = mesh.triangles.join(ok, "mesh_id", "left_anti").unionByName(trial.triangles.join(ok, "mesh_id", "left_semi").select(*mesh.triangles.columns))
    return MeshFrame(mesh.vertices.drop("exponent"), write_table(triangles)[0]), status


def _owners(triangles: DataFrame, loops: DataFrame) -> DataFrame:
    """(mesh_id, tid): triangles with a boundary edge between two vertices of ``loops``, one loop a mesh."""
    on = loops.select("mesh_id", "vid").distinct()
    edges = T.hole_edges(triangles)
    for end in "pq":
        edges = edges.join(on.withColumnRenamed("vid", end), ["mesh_id", end], "left_semi")
    return edges.select("mesh_id", "tid").distinct()


def repair_on_patches(mesh: MeshFrame, found: DataFrame, inner: int = 2, outer: int = 12) -> tuple[MeshFrame, DataFrame]:
    """Repairs each self-intersection of ``found(mesh_id, v0, v1, edge_tid, tid)`` on a patch of its own; patches may overlap.

    A patch is ``outer`` rings around the piercing edge's triangle. Its ``inner`` rings go, and of the rest what does not hang together
    with the largest part over edges; then all loops but the longest are closed. Returns the patches, as meshes named by region/mesh with
    the region the edge's triangle, and a row each: (mesh_id, region, status, triangles, removed, holes, filled, before, after).
    Status: ok, NO_BOUNDARY (nothing but one loop or none is left), HOLE_NOT_CLOSED, STILL_INTERSECTING.
    """
    seeds = found.select("mesh_id", F.col("edge_tid").alias("region"), F.col("edge_tid").alias("tid")).distinct()
    member, _ = write_table(rings(G.triangle_vertices(mesh.triangles), seeds, outer))
    parts = apart(mesh, member)
    near = member.where(F.col("layer") <= inner).select(F.col("mesh_id").alias("of"), "region", F.col("tid").alias("source_tid"))
    left, _ = write_table(parts.triangles.join(near, ["of", "region", "source_tid"], "left_anti"))
    main = left.join(_main_part(left, None), ["mesh_id", "tid"], "left_semi").select("mesh_id", "tid", "a", "b", "c")
    kept = MeshFrame(parts.vertices, write_table(main)[0])
    loops, lengths = _loops(kept)
    stuck = loops.where("status <> 'ok'").select("mesh_id").distinct().withColumn("stuck", F.lit(True))
    holes = loops.where("status = 'ok'").join(lengths.where("NOT outside"), ["mesh_id", "loop_id"], "left_semi")
    patched, told = _filled(kept, holes)
    sizes = parts.triangles.groupBy("mesh_id", "of", "region").agg(F.count("*").alias("triangles"))
    status = sizes.join(kept.triangles.groupBy("mesh_id").agg(F.count("*").alias("kept")), "mesh_id", "left")
    whole = MeshFrame(parts.vertices, parts.triangles.select("mesh_id", "tid", "a", "b", "c"))
    for more in (told, stuck, _crossings(whole, "before"), _crossings(patched, "after")):
        status = status.join(more, "mesh_id", "left")
    said = F.when(F.col("stuck") | (F.col("filled") < F.col("holes")), "HOLE_NOT_CLOSED").when(F.coalesce("holes", F.lit(0)) == 0, "NO_BOUNDARY").when(F.col("after") > 0, "STILL_INTERSECTING").otherwise("ok")
    removed = (F.col("triangles") - F.coalesce("kept", F.lit(0))).alias("removed")
    status, _ = write_table(status.select(F.col("of").alias("mesh_id"), "region", said.alias("status"), "triangles", removed, *_zero("holes", "filled", "before", "after")))
    return patched, status


def try_regions(mesh: MeshFrame) -> tuple[MeshFrame, DataFrame]:
    """Tries to repair each self-intersecting region beside the mesh, which is not touched.

    Regions are found (``self_intersecting_regions``), their gaps filled (``scrub_regions``), and each is taken out as a surface of its own
    and repaired (``repair_surfaces``). Returns the surfaces and a row each: (mesh_id, region, triangles, and what ``repair_surfaces`` tells).
    """
    regions, _ = scrub_regions(mesh, self_intersecting_regions(mesh))
    parts = apart(mesh, regions)
    surfaces, status = repair_surfaces(MeshFrame(parts.vertices.select("mesh_id", "vid", "x", "y", "z", "exponent"), parts.triangles))
    sizes = parts.triangles.groupBy("mesh_id", "of", "region").agg(F.count("*").alias("triangles"))
    return surfaces, sizes.join(status, "mesh_id").select(F.col("of").alias("mesh_id"), "region", "triangles", *[c for c in status.columns if c != "mesh_id"])
