"""Boundary edges to closed loops, and what is done with loops."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetflow.operators.graph import ONE_TASK, components
from facetflow.operators.tables import drop_table, write_table
from facetflow.operators.topology import dense_numbers, hole_edges


class BoundaryError(ValueError):
    """``code``: EMPTY_REGION, NOT_CLOSED."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def _turned(chain: tuple) -> tuple:
    p, via, q, back = chain
    return q, back, p, via


def close_chains(chains: list[tuple], undirected: bool = False) -> list[list[tuple]]:
    """Simple closed loops of chains (p, via, q, back): ways from p to q whose second vertex is via and whose last but one is back.

    The walk starts at the smallest vertex and goes on to the smallest next one; whenever it comes back to a vertex of its path, the
    loop closed there is taken out. A loop starts at its smallest vertex, without direction towards the smaller of its neighbours. Raises
    EMPTY_REGION without chains, NOT_CLOSED if a walk gets stuck.
    """
    if not chains:
        raise BoundaryError("EMPTY_REGION")
    left: dict[int, list[tuple]] = defaultdict(list)
    for chain in [*chains, *map(_turned, chains if undirected else [])]:
        left[chain[0]].append(chain)
    for ways in left.values():
        ways.sort(key=lambda c: c[1:], reverse=True)  # the smallest next vertex is the last
    loops = []
    for start in sorted(left):
        while left[start]:
            at, path, where = start, [], {start: 0}
            while True:
                if not left[at]:
                    raise BoundaryError("NOT_CLOSED")
                path.append(left[at].pop())
                at = path[-1][2]
                if undirected:
                    left[at].remove(_turned(path[-1]))
                if at not in where:
                    where[at] = len(path)
                    continue
                loop = path[where[at] :]
                del path[where[at] :]
                for chain in loop[:-1]:
                    del where[chain[2]]
                k = min(range(len(loop)), key=lambda i: loop[i][0])
                loop = loop[k:] + loop[:k]
                if undirected and loop[0][1] > loop[-1][3]:
                    loop = [_turned(c) for c in reversed(loop)]
                loops.append(loop)
                if not path:
                    break
    return sorted(loops)


def walk(edges: list[tuple[int, int]]) -> list[list[int]]:
    """Simple closed loops of directed edges, as vertices, in order (``close_chains``)."""
    return [[c[0] for c in loop] for loop in close_chains([(p, q, q, p) for p, q in edges])]


def walk_undirected(edges: list[tuple[int, int]]) -> list[list[int]]:
    """Simple closed loops of edges without direction: each is run through once, each loop towards its smaller neighbour."""
    return [[c[0] for c in loop] for loop in close_chains([(p, q, q, p) for p, q in edges], undirected=True)]


_PLACED = "mesh_id string, loop_id string, pos long, p long, via long, status string"


def _closed(chains: DataFrame, undirected: bool) -> DataFrame:
    """(mesh_id, loop_id, pos, p, via, status): where each of ``chains(mesh_id, p, via, q, back, n)`` starts in its loop.

    Chains that hang together are one group, walked in one task. A group that does not close gives one row with its status.
    """
    node = lambda v: F.concat_ws("/", v, "mesh_id")  # noqa: E731  meshes may have the same ids, and hang together by themselves
    found = components(chains.select(node("p").alias("a"), node("q").alias("b")), small=ONE_TASK)
    grouped = chains.withColumn("node", node("p")).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))

    def loops(part: pd.DataFrame) -> pd.DataFrame:
        mesh, group = part["mesh_id"].iloc[0], int(part[["p", "q"]].min().min())
        rows = []
        length = dict(zip(zip(part["p"], part["via"], strict=True), part["n"].tolist(), strict=True))
        if undirected:
            length |= dict(zip(zip(part["q"], part["back"], strict=True), part["n"].tolist(), strict=True))
        try:
            seen: dict[int, int] = defaultdict(int)
            for loop in close_chains(list(part[["p", "via", "q", "back"]].itertuples(index=False, name=None)), undirected):
                first, pos = loop[0][0], 0
                name = f"{first}" if not seen[first] else f"{first}.{seen[first]}"
                seen[first] += 1
                for p, via, _, _ in loop:
                    rows.append((mesh, name, pos, p, via, "ok"))
                    pos += length[p, via]
        except BoundaryError as error:
            rows = [(mesh, f"{group}", 0, group, group, error.code)]
        return pd.DataFrame(rows, columns=["mesh_id", "loop_id", "pos", "p", "via", "status"])

    return grouped.groupBy("mesh_id", "component").applyInPandas(loops, _PLACED)


def assemble(edges: DataFrame, undirected: bool = False, small: int = ONE_TASK) -> DataFrame:
    """(mesh_id, loop_id, pos, vid, status): the simple closed loops of ``edges(mesh_id, p, q)``, directed or not.

    ``loop_id`` is the loop's smallest vertex, with a number for further loops through it; ``pos`` counts from there, along the edges or,
    without direction, towards the smaller neighbour. Edges that hang together and do not close give one row with their status. Repeated edges
    count once, an edge from a vertex to itself is no part of a loop; no edges, no rows.

    No loop has to fit into a task. Vertices with smaller neighbours, unless edges fork or end there, are taken out level by level, until a loop
    is an edge from its smallest vertex to itself, and what lies between forks is two edges at most; pointer jumping numbers the edges that
    become one, all at once. Only loops through forks are walked (``close_chains``), a row a chain, which gives the loops of a walk over edges, as
    it never ends within a chain. What has come down to ``small`` edges is walked as it is.
    """
    e = edges.select("mesh_id", "p", "q").where("p <> q")
    if undirected:
        e = e.select("mesh_id", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"))
    e, _ = write_table(e.distinct())
    darts = e.union(e.select("mesh_id", "q", "p")) if undirected else e
    links = darts.select("mesh_id", "p", F.col("q").alias("via"), "q", F.col("p").alias("back"), F.lit(1).cast("long").alias("n"))
    levels = []
    if e.count() > small:
        links, _ = write_table(_with_forks(links, 2 if undirected else 1))
        while links.count() > small:
            inside, _ = write_table(_inside_chains(links))
            if not inside.limit(1).count():
                break
            levels.append(_ranked(links, inside, undirected))
            tails = levels[-1].join(inside.withColumnRenamed("v", "q"), ["mesh_id", "q"], "left_anti")
            links, _ = write_table(tails.select("mesh_id", F.col("head").alias("p"), F.col("head_via").alias("via"), "q", "back", (F.col("hops") + F.col("n")).alias("n"), F.col("head_fork").alias("p_fork"), "q_fork"))
    alone = (F.col("p") == F.col("q")) & ~F.col("p_fork") if levels else F.lit(False)
    simple, rest = links.where(alone), links.where(~alone).select("mesh_id", "p", "via", "q", "back", "n")
    if undirected:
        simple, rest = simple.where("via < back"), rest.where("struct(p, via) < struct(q, back)")
    walked = _closed(rest, undirected)
    if not levels:
        return walked.select("mesh_id", "loop_id", F.col("pos").cast("int").alias("pos"), F.col("p").alias("vid"), "status")
    walked, _ = write_table(walked)
    placed = simple.select("mesh_id", F.col("p").cast("string").alias("loop_id"), F.lit(0).cast("long").alias("pos"), "p", "via").union(walked.where("status = 'ok'").drop("status"))
    for ranked in reversed(levels):
        # a hot key, a chain with most of the rows, is on one side only: Spark can split it
        rows = ranked.select("mesh_id", "p", "via", "head", "head_via", "hops").join(placed.toDF("mesh_id", "loop_id", "pos", "head", "head_via"), ["mesh_id", "head", "head_via"])
        placed = rows.select("mesh_id", "loop_id", (F.col("pos") + F.col("hops")).alias("pos"), "p", "via")
    rows = placed.select("mesh_id", "loop_id", "pos", F.col("p").alias("vid"), F.lit("ok").alias("status"))
    rows = rows.union(walked.where("status <> 'ok'").select("mesh_id", "loop_id", "pos", F.col("p").alias("vid"), "status"))
    return rows.withColumn("pos", F.col("pos").cast("int"))


def _with_forks(links: DataFrame, plain: int) -> DataFrame:
    """``links`` with p_fork and q_fork: whether the end has other than ``plain`` ways in and out."""
    ways = links.select("mesh_id", F.col("p").alias("v"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(links.select("mesh_id", "q", F.lit(0), F.lit(1)))
    fork, _ = write_table(ways.groupBy("mesh_id", "v").agg(((F.sum("out") != plain) | (F.sum("into") != plain)).alias("fork")))
    for end in "pq":
        links = links.join(fork.toDF("mesh_id", end, f"{end}_fork"), ["mesh_id", end])
    return links


def _inside_chains(links: DataFrame) -> DataFrame:
    """(mesh_id, v): vertices, no forks, that have a smaller neighbour which is no fork either."""
    plain = links.where("NOT p_fork AND NOT q_fork")
    ends = plain.select("mesh_id", F.col("p").alias("v"), F.col("q").alias("o")).union(plain.select("mesh_id", "q", "p"))
    return ends.groupBy("mesh_id", "v").agg(F.min("o").alias("low")).where("low < v").select("mesh_id", "v")


def _ranked(links: DataFrame, inside: DataFrame, undirected: bool) -> DataFrame:
    """``links`` with (head, head_via, head_fork), the first link of its chain, and hops, the edges before it; chains start where p is not ``inside``.

    Each link points to the one before it, then in each round to where that one points, until it has the first.
    """
    spark = links.sparkSession
    at = inside.withColumnRenamed("v", "p")
    to = lambda p, via, fork, hops, open_: [F.col(p).alias("head"), F.col(via).alias("head_via"), F.col(fork).alias("head_fork"), hops.alias("hops"), F.lit(open_).alias("open")]
    first = links.join(at, ["mesh_id", "p"], "left_anti").select(*links.columns, *to("p", "via", "p_fork", F.lit(0).cast("long"), False))
    before = links.select("mesh_id", F.col("p").alias("x"), F.col("via").alias("x_via"), F.col("q").alias("p"), F.col("back").alias("x_back"), F.col("n").alias("x_n"), F.col("p_fork").alias("x_fork"))
    later = links.join(at, ["mesh_id", "p"], "left_semi").join(before, ["mesh_id", "p"])
    later = later.where("x_back <> via") if undirected else later  # not back where it came from
    now, path = write_table(first.union(later.select(*links.columns, *to("x", "x_via", "x_fork", F.col("x_n"), True))))
    while now.where("open").limit(1).count():
        there = now.select("mesh_id", F.col("p").alias("head"), F.col("via").alias("head_via"), *[F.col(c).alias(f"to_{c}") for c in ("head", "head_via", "head_fork", "hops", "open")])
        jumped = now.where("open").drop("head_fork", "open").join(there, ["mesh_id", "head", "head_via"])
        jumped = jumped.select(*links.columns, F.col("to_head").alias("head"), F.col("to_head_via").alias("head_via"), F.col("to_head_fork").alias("head_fork"), (F.col("hops") + F.col("to_hops")).alias("hops"), F.col("to_open").alias("open"))
        new, path_new = write_table(now.where("NOT open").union(jumped))
        drop_table(spark, path)
        now, path = new, path_new
    return now.drop("open")


def boundary_loops(triangles: DataFrame, small: int = ONE_TASK) -> DataFrame:
    """(mesh_id, loop_id, pos, vid, status): the loops of edges that one triangle has, along its orientation (``assemble``)."""
    return assemble(hole_edges(triangles), small=small)


def with_coordinates(loops: DataFrame, vertices: DataFrame) -> DataFrame:
    return loops.join(vertices, ["mesh_id", "vid"]).select("mesh_id", "loop_id", "pos", "vid", "x", "y", "z")


def translated(points: DataFrame, **by: float | Column) -> DataFrame:
    """Points moved along the named axes."""
    return points.withColumns({n: F.col(n) + d for n, d in by.items()})


def closed_edges(points: DataFrame, key: str, names: tuple[str, ...]) -> DataFrame:
    """(key, edge, p..., q...): the edges of closed polygons of ordered points (pos), the last one back to the first; ``edge`` is the pos of its start.

    ``names`` are the columns that both ends have: coordinates, or ``vid`` for edges of a mesh.
    """
    w = W.partitionBy(key).orderBy("pos")
    after = [F.coalesce(F.lead(n).over(w), F.first(n).over(w)).alias(f"q{n}") for n in names]
    return points.select(key, F.col("pos").alias("edge"), *[F.col(n).alias(f"p{n}") for n in names], *after)


def along(points: DataFrame, key: list[str], by: list[str], following: str) -> DataFrame:
    """Points numbered (pos, from 1) in their order along each edge, with the column ``following`` of the next one."""
    w = W.partitionBy(*key).orderBy(*by)
    return points.select("*", F.row_number().over(w).alias("pos"), F.lead(following).over(w).alias("following"))


def divide(points: DataFrame, key: str, runs: int) -> DataFrame:
    """Numbers ordered points (pos from 0) by ``runs`` runs of equal length; a remainder is dropped."""
    n = points.groupBy(key).agg(F.count("*").alias("__n"))
    rows = points.join(n, key).withColumn("run", F.floor(F.col("pos") / F.floor(F.col("__n") / runs)))
    return rows.where(F.col("run") < runs).drop("__n")


def smooth_loops(loops: DataFrame, triangles: DataFrame, rounds: int = 10_000) -> DataFrame:
    """``loops(mesh_id, loop_id, pos, vid)`` with every two edges of one triangle replaced by its third edge, until none are left.

    All loops at once, in rounds: of corners that form a triangle with their neighbours, those with a smaller id than such neighbours
    of theirs go; of a loop of five or fewer the smallest alone, and none of a triangle. A triangle is cut off once. Loops are tables of
    edges, so no loop has to fit into a task; vertices keep their order. A vertex occurs once in a loop.
    """
    key = ["mesh_id", "loop_id"]
    corners = lambda *c: F.array_sort(F.array(*c)).alias("corners")
    free, _ = write_table(triangles.select("mesh_id", corners("a", "b", "c")).distinct())
    size = loops.groupBy(*key).agg(F.count("*").alias("n"))
    after = loops.select(*key, F.col("pos").alias("next"), F.col("vid").alias("q"))
    edges = loops.join(size, key).withColumn("next", (F.col("pos") + 1) % F.col("n")).join(after, [*key, "next"])
    edges, _ = write_table(edges.select(*key, F.col("vid").alias("p"), "q"))
    gone = None
    for _ in range(rounds):
        size = edges.groupBy(*key).agg(F.count("*").alias("n")).where("n > 3")
        trios = edges.withColumnRenamed("q", "c").join(edges.select(*key, F.col("p").alias("c"), "q"), [*key, "c"]).join(size, key)
        found, _ = write_table(trios.withColumn("corners", corners("p", "c", "q")).join(free, ["mesh_id", "corners"], "left_semi").select(*key, "p", "c", "q", "n", "corners"))
        if not found.limit(1).count():
            break
        rival = found.select(*key, F.col("c").alias("other"))
        beaten = found.select(*key, "c", F.explode(F.array("p", "q")).alias("other")).where("other < c").join(rival, [*key, "other"], "left_semi").select(*key, "c").distinct()
        least = found.groupBy(*key).agg(F.min("c").alias("least"))
        cut = found.join(beaten, [*key, "c"], "left_anti").join(least, key).where("n > 5 OR c = least")
        cut, _ = write_table(cut.select(*key, "p", "c", "q", "corners"))
        kept = edges.join(cut.select(*key, F.col("c").alias("p")), [*key, "p"], "left_anti").join(cut.select(*key, F.col("c").alias("q")), [*key, "q"], "left_anti")
        edges, _ = write_table(kept.unionByName(cut.select(*key, "p", "q")))
        free, _ = write_table(free.join(cut.select("mesh_id", "corners"), ["mesh_id", "corners"], "left_anti"))
        gone = cut.select(*key, F.col("c").alias("vid")) if gone is None else gone.unionByName(cut.select(*key, F.col("c").alias("vid")))
    left = loops.select(*key, "pos", "vid") if gone is None else loops.select(*key, "pos", "vid").join(gone, [*key, "vid"], "left_anti")
    left = left.withColumn("of", F.to_json(F.struct(*key)))
    places = dense_numbers(left.select(F.col("of").alias("mesh_id"), "pos"), "pos").withColumnRenamed("mesh_id", "of")
    return left.join(places, ["of", "pos"]).select(*key, F.col("new").cast("int").alias("pos"), "vid")


def smooth(loop: list[int], triangles: list[tuple[int, int, int]]) -> list[int]:
    """Replaces two boundary edges of one triangle by its third edge, until none is left."""
    have = {frozenset(t) for t in triangles}
    loop = list(loop)
    k = 0
    while len(loop) > 3 and k < len(loop):
        trio = [loop[k - 1], loop[k], loop[(k + 1) % len(loop)]]
        if frozenset(trio) in have:
            have.discard(frozenset(trio))
            del loop[k]
            k = 0
        else:
            k += 1
    return loop
