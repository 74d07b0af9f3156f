"""Joins on overlapping boxes, and the exact tests that refine them."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from facetflow.functions import predicates as P
from facetflow.functions.quantize import Quantizer, grid_exponents, perturbation
from facetflow.functions.vec import V3, Box, Triangle
from facetflow.operators.tables import write_table
from facetflow.operators.topology import edges, materialize
from facetflow.sources.derived import MeshFrame

#: Box columns, after a prefix.
BOX = ("min_x", "min_y", "min_z", "max_x", "max_y", "max_z")
#: Pairs of rows of one cell that one task compares; a cell of more is dealt over several.
CROWDED = 1 << 24
#: Pairs of rows of equal keys, in all, that are compared as they are: cells would be more work, as they shuffle a row dozens of times.
FEW = 1 << 20
#: Triples of rows of one cell that one task looks through, of which it compares a small part; first rows of a cell of more are dealt over several.
CROWDED_TRIPLES = 1 << 30
#: Where one partner of many is sought: rows of the first block at least, and how many times larger each block is.
BLOCK, BLOCKS = 1 << 14, 8
#: Triples that a task hands on at once.
BATCH = 1 << 18


def box_join(left: DataFrame, right: DataFrame, keys: list[str], finer: int = 0) -> DataFrame:
    """Pairs of rows with equal ``keys`` whose boxes meet: ``left`` has columns l_min_x ... l_max_z, ``right`` r_min_x ... r_max_z.

    An equi-join on grid cells, not a nested loop. Cells have the boxes' mean extent on each axis, doubled from level to
    level; a box lies on the level whose cells are as large as itself, so in 8 cells at most. With ``finer``, cells are as many times
    halved: flat boxes then lie in a few cells more, and cells have far fewer pairs that don't meet. It is also entered on the
    coarser levels that occur, and a pair is met on the coarser one of its two: rows that both came from finer levels are not
    paired there (``kind``). Of the cells that both share only the one with the larger of the low corners gives the pair, so nothing is deduplicated.

    Only boxes are shuffled, by their cells, never pairs: what follows a pair runs in the task that found it. Left boxes of a cell
    of over ``CROWDED`` pairs are dealt over as many tasks as that takes, each with all right ones.

    Keys of ``FEW`` pairs at most, as small meshes are, need no cells: their rows are joined by key.
    """
    counts = left.groupBy(*keys).agg(F.count("*").alias("l_rows")).join(right.groupBy(*keys).agg(F.count("*").alias("r_rows")), keys)
    counts, _ = write_table(counts.select(*keys, (F.col("l_rows") * F.col("r_rows") <= FEW).alias("few")))
    found = {r[0] for r in counts.select("few").distinct().collect()}
    if True not in found:
        return _cell_join(left, right, keys, finer)
    few = [rows if found == {True} else rows.join(counts.where("few").select(*keys), keys, "left_semi") for rows in (left, right)]
    pairs = few[0].join(few[1].hint("merge"), keys).where(Box.of("l_").meets(Box.of("r_")))
    if found == {True}:
        return pairs
    many = [rows.join(counts.where("NOT few").select(*keys), keys, "left_semi") for rows in (left, right)]
    return pairs.unionByName(_cell_join(*many, keys, finer))


def _cell_join(left: DataFrame, right: DataFrame, keys: list[str], finer: int) -> DataFrame:
    extents = [rows.select(*[(F.col(f"{p}max_{n}") - F.col(f"{p}min_{n}")).alias(n) for n in "xyz"]) for rows, p in ((left, "l_"), (right, "r_"))]
    both = extents[0].union(extents[1])
    mean = both.agg(*[F.avg(n) for n in "xyz"]).first()
    cell = {n: (float(m) if m else 1.0) / 2**finer for n, m in zip("xyz", mean, strict=True)}
    level = lambda of: F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(*[c / cell[n] for n, c in of.items()], F.lit(1.0)))) - finer).cast("int")
    present = sorted(r[0] for r in both.select(level({n: F.col(n) for n in "xyz"})).distinct().collect())  # a few dozen numbers
    size = {n: F.lit(cell[n]) * F.pow(F.lit(2.0), F.col("level")) for n in "xyz"}
    sides = []
    for rows, p in ((left, "l_"), (right, "r_")):
        rows = rows.withColumn(f"{p}level", level({n: F.col(f"{p}max_{n}") - F.col(f"{p}min_{n}") for n in "xyz"}))
        rows = rows.withColumn("level", F.explode(_from_level(present, F.col(f"{p}level"))))
        own = F.col("level") == F.col(f"{p}level")
        # kind 0: left rows on their own level and all right ones; kind 1: left rows from finer levels and right ones on their own
        kind = F.when(own, 0).otherwise(1) if p == "l_" else F.explode(F.when(own, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
        rows = rows.withColumn("kind", kind).drop(f"{p}level")
        for n in "xyz":
            rows = rows.withColumn(f"cell_{n}", F.explode(F.sequence(F.floor(F.col(f"{p}min_{n}") / size[n]), F.floor(F.col(f"{p}max_{n}") / size[n]))))
        # a bit for each axis on which the box's low corner is in the cell: the cell gives a pair that has all bits
        sides.append(rows.withColumn(f"{p}bits", sum(((F.col(f"cell_{n}") == F.floor(F.col(f"{p}min_{n}") / size[n])).cast("int") * 2**k for k, n in enumerate("xyz")), F.lit(0))))
    same = [*keys, "level", "kind", "cell_x", "cell_y", "cell_z"]
    sides = _dealt(*sides, same)
    pairs = sides[0].join(sides[1].hint("merge"), [*same, "part"]).drop("part")
    here = Box.of("l_").meets(Box.of("r_")) & (F.col("l_bits").bitwiseOR(F.col("r_bits")) == 7)
    return pairs.where(here).drop("level", "kind", "cell_x", "cell_y", "cell_z", "l_bits", "r_bits")


def box_triples(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t0, t1, t2): triples of ``boxes(keys, id, min_x ... max_z)`` that meet pairwise, t0 < t1 < t2, each once.

    Boxes that meet pairwise have a point in common. Levels as in ``box_join``, of cells twice as large: a triple is met on the coarsest level of its three, in the
    cell of the largest of the low corners. Boxes are shuffled once, by their cells, and neither pairs nor triples are: a cell's boxes are compared
    as arrays in the task that has them, for each first box those that meet it with each other. First boxes of a cell of over
    ``CROWDED_TRIPLES`` triples are dealt over as many tasks as that takes, each with all boxes of the cell.
    """
    mean = boxes.agg(*[F.avg(F.col(f"max_{n}") - F.col(f"min_{n}")).alias(n) for n in "xyz"]).first()
    cell = {n: 2 * float(m) if m else 1.0 for n, m in zip("xyz", mean, strict=True)}
    wide = F.greatest(*[(F.col(f"max_{n}") - F.col(f"min_{n}")) / cell[n] for n in "xyz"], F.lit(1.0))
    rows = boxes.withColumn("own", F.ceil(F.log2(wide)).cast("int"))
    present = sorted(r[0] for r in rows.select("own").distinct().collect())  # a few dozen numbers
    size = {n: F.lit(cell[n]) * F.pow(F.lit(2.0), F.col("level")) for n in "xyz"}
    rows = rows.withColumn("level", F.explode(_from_level(present, F.col("own"))))
    for n in "xyz":
        rows = rows.withColumn(f"cell_{n}", F.explode(F.sequence(F.floor(F.col(f"min_{n}") / size[n]), F.floor(F.col(f"max_{n}") / size[n]))))
    # a bit for the box's own level and one for each axis on which its low corner is in the cell: the cell gives a triple whose boxes have all bits among them
    bits = [F.col("level") == F.col("own"), *[F.col(f"cell_{n}") == F.floor(F.col(f"min_{n}") / size[n]) for n in "xyz"]]
    rows = rows.withColumn("bits", sum((b.cast("int") * 2**k for k, b in enumerate(bits)), F.lit(0))).drop("own")
    same = [*keys, "level", "cell_x", "cell_y", "cell_z"]
    triples = F.pow(F.col("n").cast("double"), 3)
    crowded = rows.groupBy(*same).agg(F.count("*").alias("n")).where(triples > CROWDED_TRIPLES)
    crowded, _ = write_table(crowded.select(*same, F.least("n", F.ceil(triples / CROWDED_TRIPLES)).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    rows = rows.join(crowded, same, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    same = [*same, "part"]
    rows = rows.select(*same, "id", "bits", (F.pmod(F.xxhash64("id"), parts) == F.col("part")).alias("leads"), *[F.col(c).cast("double") for c in BOX]).dropna()
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *same).sortWithinPartitions(*same, "id")
    of = boxes.schema["id"].dataType
    schema = StructType([*[boxes.schema[k] for k in keys], StructField("t0", of), StructField("t1", of), StructField("thirds", ArrayType(of))])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _runs(batches, same):
            key = [cell.column(k)[0] for k in keys]
            for t0, t1, each, t2 in _cell_triples(*[cell.column(c).to_numpy() for c in ("id", "bits", "leads", *BOX)]):
                thirds = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(each)]), pa.int32()), pa.array(t2))
                yield pa.RecordBatch.from_arrays([*[pa.repeat(k, len(t0)) for k in key], pa.array(t0), pa.array(t1), thirds], names=schema.names)

    return rows.mapInArrow(found, schema).select(*keys, "t0", "t1", F.explode("thirds").alias("t2"))


def _runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Of sorted rows those of each key, one key in memory at a time."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now]).combine_chunks()
        new = np.zeros(held.num_rows - 1, bool)
        for k in key:
            new |= pc.not_equal(held.column(k).slice(1), held.column(k).slice(0, held.num_rows - 1)).to_numpy()
        starts = [0, *(np.flatnonzero(new) + 1).tolist()]
        for i, j in itertools.pairwise(starts):
            yield held.slice(i, j - i)
        held = held.slice(starts[-1])
    if held is not None:
        yield held


def _cell_triples(ids: np.ndarray, bits: np.ndarray, leads: np.ndarray, *box: np.ndarray) -> Iterator[list[np.ndarray]]:
    """Triples of ascending ids of boxes of one cell that meet pairwise and have all bits among them; of the first boxes those that ``leads`` names.

    As arrays: first and second ids of pairs, how many thirds each has, and all thirds.
    """
    n = len(ids)
    different, rank = np.unique(ids, return_inverse=True)
    repeated = len(different) < n
    # coordinates as ranks: the same comparisons of shorter numbers
    places = [np.unique(np.concatenate([box[k], box[k + 3]]), return_inverse=True)[1].astype(np.int16 if n < 1 << 14 else np.int32) for k in range(3)]
    low, high, bits = np.stack([p[:n] for p in places]), np.stack([p[n:] for p in places]), bits.astype(np.int8)
    made, count = [], 0
    for a in np.flatnonzero(leads):
        after = np.searchsorted(rank, rank[a], "right")
        near = after + np.flatnonzero(((low[:, after:] <= high[:, a, None]) & (high[:, after:] >= low[:, a, None])).all(axis=0))
        if len(near) < 2:
            continue
        lo, hi, own, order = low[:, near], high[:, near], bits[near] | bits[a], rank[near]
        step = max(1, (1 << 16) // len(near))
        for i in range(0, len(near) - 1, step):
            rows = slice(i, i + step)
            meet = lo[0, None, i:] <= hi[0, rows, None]
            meet &= hi[0, None, i:] >= lo[0, rows, None]
            for k in (1, 2):
                meet &= lo[k, None, i:] <= hi[k, rows, None]
                meet &= hi[k, None, i:] >= lo[k, rows, None]
            later = len(near) if repeated else step  # boxes behind those of these rows are later ones
            meet[:, :later] &= order[rows, None] < order[None, i : i + later]
            if bits[a] != 15:
                meet &= (own[rows, None] | own[None, i:]) == 15
            each = np.count_nonzero(meet, axis=1)
            c = np.flatnonzero(meet)
            if not len(c):
                continue
            c -= np.repeat(np.arange(len(each)) * meet.shape[1], each)
            at, some = ids[near[i:]], np.flatnonzero(each)
            made.append((np.full(len(some), ids[a]), at[some], each[some], at[c]))
            count += len(c)
            if count >= BATCH:
                yield [np.concatenate(column) for column in zip(*made, strict=True)]
                made, count = [], 0
    if made:
        yield [np.concatenate(column) for column in zip(*made, strict=True)]


def _dealt(left: DataFrame, right: DataFrame, same: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both with ``part``: one of its cell's parts a left row, each of them a right row."""
    met = left.groupBy(*same).agg(F.count("*").alias("l_rows")).join(right.groupBy(*same).agg(F.count("*").alias("r_rows")), same).where(F.col("l_rows") * F.col("r_rows") > CROWDED)
    crowded, _ = write_table(met.select(*same, F.ceil(F.col("l_rows") * F.col("r_rows") / CROWDED).cast("int").alias("parts")))
    if not crowded.limit(1).count():
        return left.withColumn("part", F.lit(0)), right.withColumn("part", F.lit(0))
    parts = F.coalesce("parts", F.lit(1))
    one = F.pmod(F.xxhash64(*left.columns), parts).cast("int")
    return tuple(rows.join(crowded, same, "left").withColumn("part", part).drop("parts") for rows, part in ((left, one), (right, F.explode(F.sequence(F.lit(0), parts - 1)))))


def _from_level(levels: list[int], own: Column) -> Column:
    return F.filter(F.array(*[F.lit(k) for k in levels or [0]]), lambda k: k >= own)


def grids(mesh: MeshFrame) -> DataFrame:
    """(mesh_id, exponent, status): each mesh's own grid, and OK or why the grid is too coarse for its shortest edge."""
    largest = mesh.vertices.groupBy("mesh_id").agg(F.max(F.greatest(F.abs("x"), F.abs("y"), F.abs("z"))).alias("largest"))
    rows = edges(mesh.triangles).select("mesh_id", "v0", "v1")
    for end in ("v0", "v1"):
        rows = rows.join(mesh.vertices.select("mesh_id", F.col("vid").alias(end), F.struct("x", "y", "z").alias(f"at_{end}")), ["mesh_id", end])
    length = F.sqrt(sum(((F.col(f"at_v0.{n}") - F.col(f"at_v1.{n}")) ** 2 for n in "xyz"), F.lit(0.0)))
    shortest = rows.groupBy("mesh_id").agg(F.min(length).alias("shortest"))
    exponent, status = grid_exponents(F.col("largest"), F.col("shortest"))
    return largest.join(shortest, "mesh_id", "left").select("mesh_id", exponent.alias("exponent"), status.alias("status"))


def with_exponents(mesh: MeshFrame) -> MeshFrame:
    """Vertices with the ``exponent`` of their own mesh's grid, if they don't have one already: a row a mesh is joined."""
    if "exponent" in mesh.vertices.columns:
        return mesh
    largest = mesh.vertices.groupBy("mesh_id").agg(F.max(F.greatest(F.abs("x"), F.abs("y"), F.abs("z"))).alias("largest"))
    own = largest.select("mesh_id", grid_exponents(F.col("largest"), F.lit(1.0))[0].alias("exponent"))
    return MeshFrame(mesh.vertices.join(own, "mesh_id"), mesh.triangles)


def on_grid(mesh: MeshFrame, quantizer: Quantizer, seed: int = 0, quanta: int | Column = 0) -> MeshFrame:
    """Vertices as integers of the grid, moved by up to ``quanta`` (a number or a column of the vertices) by a seeded hash; with ``Quantizer.per_mesh()`` of each mesh's own."""
    if isinstance(quantizer.exponent, Column):
        mesh = with_exponents(mesh)
    p = quantizer.to_grid(V3.of())
    if isinstance(quanta, Column) or quanta:
        p = p + perturbation(F.col("vid"), seed, quanta)
    return MeshFrame(mesh.vertices.select("mesh_id", "vid", *p.columns("")), mesh.triangles)


def edge_ends(mesh: MeshFrame, keep: list[str]) -> DataFrame:
    """Each edge of each label once, with its end points p and q."""
    rows = edges(mesh.triangles, keep=keep).groupBy("mesh_id", *keep, "v0", "v1").agg(F.min("tid").alias("edge_tid"))
    for end, v in (("p", "v0"), ("q", "v1")):
        rows = rows.join(mesh.vertices.select("mesh_id", F.col("vid").alias(v), *[F.col(n).alias(f"{end}{n}") for n in "xyz"]), ["mesh_id", v])
    return rows


def edge_triangle_pairs(mesh: MeshFrame, other: bool | None, keep: tuple[str, ...] = (), written: bool = False) -> DataFrame:
    """Edges and triangles of a labelled mesh on the grid that may meet: of another label, of the same one, or (None) of any.

    Pairs that share a vertex are left out; with the exact verdict as columns ``meets`` and ``degenerate``. Columns ``keep`` of the
    triangles, equal on all triangles of an edge, come as l_ of the edge and r_ of the triangle.
    ``written``: edges and triangles are written, as the join reads them four times; pairs then come in another order in each run.
    """
    return _tested(*_sides(mesh, keep, written), other, keep)


def _sides(mesh: MeshFrame, keep: tuple[str, ...], written: bool) -> tuple[DataFrame, DataFrame]:
    kept = ["label", *keep]
    left = edge_ends(mesh, kept).withColumnsRenamed({n: f"l_{n}" for n in kept})
    right = materialize(mesh, kept).withColumnsRenamed({n: f"r_{n}" for n in kept})
    return (write_table(left)[0], write_table(right)[0]) if written else (left, right)


def _tested(left: DataFrame, right: DataFrame, other: bool | None, keep: tuple[str, ...], keys: tuple[str, ...] = ("mesh_id",)) -> DataFrame:
    """Pairs of the two ``_sides`` with their verdict; of equal ``keys`` only."""
    kept = ["label", *keep]
    p, q = V3.of("p"), V3.of("q")
    left, right = left.select("*", *Box(p.least(q), p.greatest(q)).columns("l_")), right.select("*", *Triangle.of().box().columns("r_"))
    pairs = box_join(left, right, list(keys), finer=1)
    if other is not None:
        pairs = pairs.where(F.col("l_label") != F.col("r_label")) if other else pairs.where(F.col("l_label") == F.col("r_label"))
    apart = ~(F.col("v0").isin(F.col("a"), F.col("b"), F.col("c")) | F.col("v1").isin(F.col("a"), F.col("b"), F.col("c")))
    t = Triangle(*(P.exact(V3.of(n)) for n in "abc"))
    meets, degenerate = P.pierces()
    # candidates are tested where they are found: there are many times more of them than boxes
    pairs = pairs.where(apart).select("mesh_id", *[f"{p}_{n}" for p in "lr" for n in kept], "v0", "v1", "edge_tid", "tid", *[f"{c}{n}" for c in "pqabc" for n in "xyz"])
    signed = P.with_piercing_signs(pairs, P.exact(V3.of("p")), P.exact(V3.of("q")), t)
    return signed.withColumns({"meets": meets, "degenerate": degenerate}).drop(*P.SIGNS)


def intersection_point(p: V3, q: V3, t: Triangle) -> V3:
    """Where an edge meets a triangle's plane: from two signed volumes in doubles."""
    p, q, t = p.double(), q.double(), Triangle(*(v.double() for v in (t.a, t.b, t.c)))
    n = t.normal()
    sp, sq = (t.a - p).dot(n), (t.a - q).dot(n)
    return p + (q - p) * (sp / (sp - sq))


def self_intersections(mesh: MeshFrame, quantizer: Quantizer | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(mesh_id, v0, v1, edge_tid, tid): edges that pierce a triangle of their own mesh; each edge once, with its first triangle.

    Without a quantizer each mesh has its own grid, so that a mesh is judged as it is alone, whatever its company. ``keep`` as in ``edge_triangle_pairs``.
    Rows may be as many as pairs of an edge and a triangle: aggregate them before they are shuffled.
    """
    pairs = edge_triangle_pairs(_judged(mesh, quantizer), other=False, keep=keep, written=True)
    return pairs.where("meets").select("mesh_id", "v0", "v1", "edge_tid", "tid", *[f"{p}_{n}" for p in "lr" for n in keep])


def _judged(mesh: MeshFrame, quantizer: Quantizer | None) -> MeshFrame:
    labelled = MeshFrame(mesh.vertices, mesh.triangles if "label" in mesh.triangles.columns else mesh.triangles.withColumn("label", F.lit(0)))
    grid = on_grid(labelled, quantizer or Quantizer.per_mesh())
    return MeshFrame(write_table(grid.vertices)[0], grid.triangles)  # joined five times


def first_intersections(mesh: MeshFrame, quantizer: Quantizer | None = None) -> DataFrame:
    """(mesh_id, v0, v1, edge_tid, tid): of ``self_intersections`` those of each edge with its smallest pierced triangle.

    Triangles are taken in blocks of ascending ids, each ``BLOCKS`` times the one before; an edge that pierces one of a block is not compared with
    later ones, which are larger. Every pair is compared once at most.
    """
    left, right = _sides(_judged(mesh, quantizer), (), True)
    edge, ranges = ["mesh_id", "l_label", "v0", "v1"], [1.0 / BLOCKS**k for k in range(1, _blocks(right))][::-1]
    cuts = right.agg(F.percentile_approx("tid", ranges)).first()[0] or [] if ranges else []
    found, low = None, None
    for cut in [*cuts, None]:
        block = right if low is None else right.where(F.col("tid") > low)
        hits = _tested(left, block if cut is None else block.where(F.col("tid") <= cut), False, ()).where("meets").groupBy(*edge).agg(F.min(F.struct("tid", "edge_tid")).alias("first"))
        if cuts:
            hits, _ = write_table(hits)
        found, low = hits if found is None else found.unionByName(hits), cut
        if cut is not None:
            left, _ = write_table(left.join(hits, edge, "left_anti"))
    first = found.groupBy("mesh_id", "v0", "v1").agg(F.min("first").alias("first"))
    return first.select("mesh_id", "v0", "v1", "first.edge_tid", "first.tid")


def _blocks(rows: DataFrame) -> int:
    """How many blocks, each ``BLOCKS`` times the one before, the first of ``BLOCK`` rows at least."""
    n, blocks = rows.count(), 1
    while n >= BLOCK * BLOCKS**blocks:
        blocks += 1
    return blocks


def meeting_triples(pairs: DataFrame) -> DataFrame:
    """(mesh_id, t0, t1, t2): of ``pairs(mesh_id, a, b)`` with a < b that are there once, the triples whose three pairs are there.

    Two equi-joins: pairs that follow each other, then the pair of their ends.
    """
    ab = pairs.select("mesh_id", F.col("a").alias("t0"), F.col("b").alias("t1"))
    bc = pairs.select("mesh_id", F.col("a").alias("t1"), F.col("b").alias("t2"))
    ac = pairs.select("mesh_id", F.col("a").alias("t0"), F.col("b").alias("t2"))
    return ab.join(bc, ["mesh_id", "t1"]).join(ac, ["mesh_id", "t0", "t2"]).select("mesh_id", "t0", "t1", "t2")


def without_shared_vertices(pairs: DataFrame, triangles: DataFrame) -> DataFrame:
    """Those of ``pairs(mesh_id, a, b)`` of triangle ids whose triangles have no vertex in common."""
    corners = lambda of: triangles.select("mesh_id", F.col("tid").alias(of), F.array("a", "b", "c").alias(f"of_{of}"))
    return pairs.join(corners("a"), ["mesh_id", "a"]).join(corners("b"), ["mesh_id", "b"]).where(~F.arrays_overlap("of_a", "of_b")).select(*pairs.columns)


def without_common_vertex(triples: DataFrame, triangles: DataFrame) -> DataFrame:
    """Those of ``triples(mesh_id, t0, t1, t2)`` whose triangles have no vertex common to all three; two of them may share."""
    rows = triples
    for of in ("t0", "t1", "t2"):
        rows = rows.join(triangles.select("mesh_id", F.col("tid").alias(of), F.array("a", "b", "c").alias(f"of_{of}")), ["mesh_id", of])
    return rows.where(F.size(F.array_intersect(F.array_intersect("of_t0", "of_t1"), "of_t2")) == 0).select(*triples.columns)
