"""Iterative operators on graphs and on the neighbourhoods of triangles."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetflow.operators.tables import drop_table, write_table


#: Edges of a graph that one task joins: a few MB.
ONE_TASK = 1 << 16
#: Edges that a task contracts at a time: some tens of MB.
CHUNK = 1 << 17


class _Forest:
    """Union-find with halved paths; each root is the smallest of its nodes."""

    def __init__(self):
        self.above: dict = {}

    def root(self, x):
        above = self.above
        while above.setdefault(x, x) != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    def join(self, batch: pa.RecordBatch) -> None:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = self.root(a), self.root(b)
            self.above[max(a, b)] = min(a, b)

    def rows(self, names: list[str], roots: bool) -> pa.RecordBatch:
        nodes = [x for x in list(self.above) if roots or self.above[x] != x]
        kind = pa.string() if nodes and isinstance(nodes[0], str) else pa.int64()
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x in (nodes, [self.root(x) for x in nodes])], names=names)


def _united(batches):
    """Components of the edges of one task."""
    forest = _Forest()
    for batch in batches:
        forest.join(batch)
    yield forest.rows(["node", "component"], roots=True)


def _contracted(batches):
    """Edges (a, b) of stars instead of a task's edges, for each ``CHUNK`` of them: what hangs together does so still."""
    forest, seen = _Forest(), 0
    for batch in batches:
        forest.join(batch)
        seen += batch.num_rows
        if seen >= CHUNK:
            yield forest.rows(["a", "b"], roots=False)
            forest, seen = _Forest(), 0
    if seen:
        yield forest.rows(["a", "b"], roots=False)


def components(edges: DataFrame, rounds: int = 60, small: int = 0, within: list[str] | None = None) -> DataFrame:
    """Connected components of ``edges(a, b)``: (node, component), the smallest node reachable; nodes without edges are absent.

    Alternating large-star and small-star steps (Kiveris et al. 2014): each edge keeps to one row, and a node's neighbours are
    only ever reduced to their minimum. Minima are written before they are joined: both sides of a join then come straight
    from an exchange, so that Spark can split a node with very many edges; minima, which grow with the nodes, are not broadcast,
    however well their files are packed. It is over when the edges are stars: no node points to two others or is pointed
    to and points on. Each step's edges are written to the scratch folder; one number a round comes to the driver.
    Empty edges give an empty result. Loops and repeated edges are ignored. Up to ``small`` edges, once written and counted, are one
    task's work instead: a job for each step costs more than that. Nodes are then whole numbers or strings.

    With ``within``, columns that edges of a component agree in (their mesh), edges are first dealt to tasks by these and contracted there, bounded
    chunks at a time: stars are left for the steps. Edges of a mesh of over ``CHUNK`` are dealt over as many tasks as that takes.
    """
    spark = edges.sparkSession
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), *(within or [])).where("a <> b")
    if within:
        kind = "string" if dict(now.dtypes)["a"] == "string" else "long"
        links, path_links = write_table(now.select(F.col("a").cast(kind), F.col("b").cast(kind), *within))
        large, path_large = write_table(links.groupBy(*within).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts")).where("parts > 1"))
        dealt = [*within, F.pmod(F.hash("b"), F.coalesce("parts", F.lit(1)))]
        now = (links.join(large, within, "left").repartition(*dealt) if large.limit(1).count() else links.repartition(*within)).select("a", "b").mapInArrow(_contracted, f"a {kind}, b {kind}")
    now, path = write_table(now.distinct())
    if within:
        for old in (path_links, path_large):
            drop_table(spark, old)
    if small and now.count() <= small:
        kind = "string" if dict(now.dtypes)["a"] == "string" else "long"
        return write_table(now.select(F.col("a").cast(kind), F.col("b").cast(kind)).coalesce(1).mapInArrow(_united, f"node {kind}, component {kind}"))[0]
    for _ in range(rounds):
        if _are_stars(now):
            break
        both = now.union(now.select("b", "a"))
        low = both.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m")).select("b", F.least("b", "m").alias("m"))
        low, path_low = write_table(low)
        large, path_large = write_table(now.join(low.hint("merge"), "b").select("a", F.col("m").alias("b")).distinct())
        least, path_least = write_table(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least).distinct()
        new, path_new = write_table(small)
        for old in (path, path_low, path_large, path_least):
            drop_table(spark, old)
        now, path = new, path_new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    root = now.select(F.col("b").alias("a")).distinct().select("a", F.col("a").alias("b"))
    return now.union(root).toDF("node", "component").hint("merge")


def _are_stars(edges: DataFrame) -> bool:
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("b", F.lit(0), F.lit(1)))
    degree = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return not degree.where("out > 1 OR out = 1 AND into = 1").limit(1).count()


def triangle_vertices(triangles: DataFrame) -> DataFrame:
    """(mesh_id, tid, vid): a row per corner."""
    return triangles.select("mesh_id", "tid", F.explode(F.array("a", "b", "c")).alias("vid"))


def labelled_components(nodes: DataFrame, edges: DataFrame, within: list[str] | None = None) -> DataFrame:
    """(node, component) of all ``nodes(node)``, those without edges included; ``within`` as in ``components``."""
    found = components(edges, small=ONE_TASK, within=within)
    return nodes.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def bodies(triangles: DataFrame) -> DataFrame:
    """(mesh_id, tid, body): triangles that share vertices are one body, named by its smallest vertex.

    Two edges a triangle join its corners; components run over vertices, which are half as many as triangles.
    Vertex ids have to be unique over meshes (as ``struct`` keys are not ordered numbers); meshes with their own numbering
    are offset before (``topology.disjoint_union``).
    """
    edges = triangles.select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("c").alias("b")))).alias("e")).select("e.a", "e.b")
    found = components(edges, small=ONE_TASK)
    return triangles.join(found, F.col("a") == F.col("node")).select("mesh_id", "tid", F.col("component").alias("body"))


def edge_components(triangles: DataFrame, within: list[str] | None = None) -> DataFrame:
    """(mesh_id, tid, component): triangles that share an edge, and agree in the columns ``within``.

    An edge's triangles are joined to its smallest one: as many edges as incidences, however many triangles an edge has.
    """
    from facetflow.operators.topology import edges as edge_rows

    keys = ["mesh_id", "v0", "v1", *(within or [])]
    rows = edge_rows(triangles, keep=within or [])
    first = rows.groupBy(*keys).agg(F.min("tid").alias("low"))
    links = rows.join(first, keys).select("mesh_id", F.col("tid").alias("a"), F.col("low").alias("b"))
    return labelled_components(triangles.select(F.col("tid").alias("node")), links, ["mesh_id"]).join(triangles.select("mesh_id", F.col("tid").alias("node")), "node").select("mesh_id", F.col("node").alias("tid"), "component")


def ring(triangles: DataFrame, seeds: DataFrame, layers: int = 1) -> DataFrame:
    """(mesh_id, tid, layer): seeds as layer 0, then triangles that share a vertex with the layer before.

    Each layer joins only the frontier; a written table of what was reached cuts the lineage.
    """
    corners = triangle_vertices(triangles)
    reached = seeds.select("mesh_id", "tid", F.lit(0).alias("layer"))
    for k in range(1, layers + 1):
        front = reached.where(F.col("layer") == k - 1)
        touched = corners.join(front.select("mesh_id", "tid"), ["mesh_id", "tid"], "left_semi").select("mesh_id", "vid").distinct()
        new = corners.join(touched, ["mesh_id", "vid"], "left_semi").select("mesh_id", "tid").distinct()
        new = new.join(reached.select("mesh_id", "tid"), ["mesh_id", "tid"], "left_anti").withColumn("layer", F.lit(k))
        reached, _ = write_table(reached.union(new))
    return reached


def extract_around(mesh, seeds: DataFrame, layers: int = 1):
    """The sub-mesh of the seeds and ``layers`` rings around them, renumbered, and the map of its vertices (mesh_id, vid, new)."""
    from facetflow.operators.topology import extract

    return extract(mesh, ring(mesh.triangles, seeds, layers).select("mesh_id", "tid"))


def region_grow(triangles: DataFrame, seeds: DataFrame, barrier: DataFrame, limit: int, most_rounds: int = 10_000) -> DataFrame:
    """(mesh_id, tid): what is reached from the seeds over shared edges that are not in ``barrier(mesh_id, v0, v1)``.

    That is the components of the seeds, found in a logarithmic number of rounds. Only if they have more than ``limit``
    triangles, a size cap of the operator, the region is grown layer by layer from the seeds and stops before a layer
    that would pass the limit.
    """
    from facetflow.operators.topology import edges as edge_rows

    open_edges, _ = write_table(edge_rows(triangles).select("mesh_id", "tid", "v0", "v1").join(barrier, ["mesh_id", "v0", "v1"], "left_anti"))
    first = open_edges.groupBy("mesh_id", "v0", "v1").agg(F.min("tid").alias("low"))
    links = open_edges.join(first.hint("merge"), ["mesh_id", "v0", "v1"]).select(F.col("tid").alias("a"), F.col("low").alias("b"))
    found = labelled_components(triangles.select(F.col("tid").alias("node")), links)
    start = seeds.select("mesh_id", "tid").distinct()
    wanted = found.join(start.select(F.col("tid").alias("node")), "node", "left_semi").select("component").distinct()
    whole = triangles.select("mesh_id", "tid").join(found.join(wanted, "component", "left_semi").select(F.col("node").alias("tid")), "tid", "left_semi").select("mesh_id", "tid")
    whole, _ = write_table(whole)
    if whole.count() <= limit:
        return whole
    reached, _ = write_table(start)
    front, size = reached, reached.count()
    for _ in range(most_rounds):
        touched = open_edges.join(front, ["mesh_id", "tid"], "left_semi").select("mesh_id", "v0", "v1").distinct()
        new = open_edges.join(touched, ["mesh_id", "v0", "v1"], "left_semi").select("mesh_id", "tid").distinct()
        front, _ = write_table(new.join(reached, ["mesh_id", "tid"], "left_anti"))
        more = front.count()
        if not more or size + more > limit:
            break
        reached, size = write_table(reached.union(front))[0], size + more
    return reached


def merge_sets(sets: DataFrame) -> DataFrame:
    """(set_id, merged): sets that overlap in a member of ``sets(set_id, member)`` become one, named by the smallest set."""
    first = sets.groupBy("member").agg(F.min("set_id").alias("low"))
    links = sets.join(first, "member").select(F.col("set_id").alias("a"), F.col("low").alias("b"))
    return labelled_components(sets.select(F.col("set_id").alias("node")), links).toDF("set_id", "merged")
