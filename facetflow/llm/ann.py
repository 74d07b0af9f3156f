"""Approximate nearest neighbours by robust-pruned directed graphs, one a shard.

Vectors are dealt over shards by a hash of their id. A shard's graph is built in two passes over its vectors: a greedy search
from the medoid proposes neighbours, and robust pruning keeps one only if no nearer neighbour kept is much nearer to it
(by the factor alpha: 1, then 1.2); edges are added in both directions and pruned again where there are too many. Equal
vectors of a shard are one node. Queries go to every shard in blocks, where a beam search finds candidates; a shard's best
are scored in double precision on the original vectors and the shards' lists are merged.

Searches run on single-precision copies, scaled by a shard's largest component; scores on the components as they are.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, neither do rows with a
null vec_id; vectors of each length have shards of their own, and a query finds those of its length only; of rows that repeat
a vec_id each is a query and a candidate, but no query finds its own id; fewer candidates than k give fewer rows; an empty
table gives none. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetflow.llm.common import map_arrow, write_table
from facetflow.llm.vectors import binary_rows, from_binary, kind_of, matrices

SHARD = 8192
DEGREE = 40
BUILD_BEAM = 80
QUERY_BEAM = 400
ALPHAS = (1.0, 1.2)
#: Queries of a block, and blocks that one task searches with one copy of a shard's graph.
BLOCK, BLOCKS = 256, 64


def _squares(rows: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", rows, rows)


class Graph:
    """Neighbours of each node, -1 where there are fewer."""

    def __init__(self, rows: np.ndarray, edges: np.ndarray, entry: int):
        self.rows, self.edges, self.entry, self.squares = rows, edges, entry, _squares(rows)

    def beam(self, queries: np.ndarray, width: int, ahead: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest nodes that a greedy search meets for each query, nearest first; -1 and inf where fewer.

        All queries take a step together: each expands its ``ahead`` nearest nodes not yet expanded.
        """
        n, m = len(self.rows), len(queries)
        width = min(width, n)
        row = np.arange(m)[:, None]
        norm = _squares(queries)
        ids = np.full((m, width), -1)
        far = np.full((m, width), np.inf, np.float32)
        done = np.ones((m, width), bool)
        seen = np.zeros((m, n + 1), bool)
        seen[:, n] = True  # where -1 points
        ids[:, 0], done[:, 0], seen[:, self.entry] = self.entry, False, True
        far[:, 0] = self.squares[self.entry] - 2 * queries @ self.rows[self.entry] + norm
        live = np.arange(m)
        while len(live):
            waiting = np.where(done[live], np.inf, far[live])
            step = min(ahead, width)
            pick = np.argpartition(waiting, step - 1, axis=1)[:, :step]
            ready = np.isfinite(np.take_along_axis(waiting, pick, 1))
            some = ready.any(1)
            live, pick, ready = live[some], pick[some], ready[some]
            if not len(live):
                break
            at = row[: len(live)]
            done[live[:, None], pick] |= ready
            nodes = np.where(ready, ids[live[:, None], pick], -1)
            new = np.where(nodes[:, :, None] >= 0, self.edges[nodes], -1).reshape(len(live), -1)
            new.sort(axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            new[seen[live[:, None], new]] = -1
            most = int((new >= 0).sum(1).max(initial=0))
            if not most:
                continue
            new = -np.sort(-new, axis=1)[:, :most]
            seen[live[:, None], new] = True
            dist = self.squares[new] - 2 * np.einsum("ijk,ik->ij", self.rows[new], queries[live]) + norm[live][:, None]
            dist = np.where(new >= 0, dist, np.inf).astype(np.float32)
            every_id, every_far = np.concatenate([ids[live], new], 1), np.concatenate([far[live], dist], 1)
            every_done = np.concatenate([done[live], new < 0], 1)
            best = np.argpartition(every_far, width - 1, axis=1)[:, :width]
            ids[live], far[live], done[live] = every_id[at, best], every_far[at, best], every_done[at, best]
        order = far.argsort(1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)

    def prune(self, nodes: np.ndarray, near: np.ndarray, alpha: float, degree: int) -> np.ndarray:
        """Robust pruning of candidate lists ``near`` (-1: none) of ``nodes``."""
        near = np.where(near == nodes[:, None], -1, near)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        rows = self.rows[near]
        dist = self.squares[near] - 2 * np.einsum("ijk,ik->ij", rows, self.rows[nodes]) + self.squares[nodes][:, None]
        dist = np.where(near >= 0, np.maximum(dist, 0), np.inf)
        order = dist.argsort(1, kind="stable")
        near, dist, rows = np.take_along_axis(near, order, 1), np.take_along_axis(dist, order, 1), np.take_along_axis(rows, order[:, :, None], 1)
        apart = self.squares[near][:, :, None] + self.squares[near][:, None, :] - 2 * rows @ rows.transpose(0, 2, 1)
        alive, kept, at = np.isfinite(dist), np.full((len(nodes), degree), -1), np.arange(len(nodes))
        for k in range(degree):
            some = alive.any(1)
            if not some.any():
                break
            first = alive.argmax(1)
            kept[some, k] = near[at, first][some]
            alive &= alpha * alpha * apart[at, first] > dist
            alive[at, first] = False
        return kept


def build_graph(rows: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alphas: tuple[float, ...] = ALPHAS, seed: int = 3) -> Graph:
    n = len(rows)
    rng = np.random.default_rng(seed)
    edges = np.full((n, degree), -1)
    if n > 1:
        start = min(degree, n - 1, 16)
        edges[:, :start] = (np.arange(n)[:, None] + rng.integers(1, n, (n, start))) % n
    graph = Graph(rows, edges, int(((rows - rows.mean(0)) ** 2).sum(1).argmin()))
    for alpha in alphas:
        order = rng.permutation(n)
        for low in range(0, n, 256):
            nodes = order[low : low + 256]
            near, _ = graph.beam(rows[nodes], beam)
            edges[nodes] = graph.prune(nodes, np.concatenate([near, edges[nodes]], 1), alpha, degree)
            to = edges[nodes].ravel()
            source = np.repeat(nodes, degree)[to >= 0]
            to = to[to >= 0]
            by = np.argsort(to, kind="stable")
            to, source = to[by], source[by]
            target, first, count = np.unique(to, return_index=True, return_counts=True)
            more = np.full((len(target), int(count.max(initial=0))), -1)
            more[np.repeat(np.arange(len(target)), count), np.arange(len(to)) - np.repeat(first, count)] = source
            both = np.concatenate([edges[target], more], 1)
            both.sort(axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            full = (both >= 0).sum(1) > degree
            both = -np.sort(-both, axis=1)
            edges[target[~full]] = both[~full][:, :degree]
            for part in np.array_split(np.flatnonzero(full), max(1, -(-int(full.sum()) // 256))):
                if len(part):
                    edges[target[part]] = graph.prune(target[part], both[part], alpha, degree)
    return graph


_INDEX = "shard int, ids binary, begin binary, rows binary, edges binary, width int, entry int"


def _scaled(rows: np.ndarray, scale: float) -> np.ndarray:
    return np.ascontiguousarray(np.clip(rows.astype(np.float64) / scale, -1e9, 1e9).astype(np.float32))


def _built(degree: int, beam: int, kind: type):
    """A task's vectors in, a graph per shard out; a shard is in memory at a time."""

    def graph_of(shard: int, tables: list) -> pa.RecordBatch:
        table = pa.Table.from_batches(tables)
        ids, rows = table.column("vec_id").to_numpy(), from_binary(table.column("vector").combine_chunks(), kind)
        order = np.lexsort(ids[None])
        ids, rows = ids[order], rows[order]
        _, first, node = np.unique(rows.view(f"V{rows.shape[1] * rows.itemsize}").ravel(), return_index=True, return_inverse=True)
        by = np.argsort(node, kind="stable")
        begin = np.concatenate([[0], np.cumsum(np.bincount(node))])
        rows = np.ascontiguousarray(rows[first])
        graph = build_graph(_scaled(rows, float(np.abs(rows).max())), degree, beam)
        values = [shard, ids[by].tobytes(), begin.astype(np.int64).tobytes(), rows.tobytes(), graph.edges.astype(np.int32).tobytes(), rows.shape[1], graph.entry]
        kinds = [pa.int32(), *[pa.binary()] * 4, pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[x.split()[0] for x in _INDEX.split(", ")])

    def build(batches):
        now, held = None, []
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if high == low:
                    continue
                if held and shards[low] != now:
                    yield graph_of(now, held)
                    held = []
                now = int(shards[low])
                held.append(batch.slice(low, high - low))
        if held:
            yield graph_of(now, held)

    return build


def _usable(kind: type):
    def rows_of(batches):
        for batch in batches:
            for rows, at in matrices(batch.column("embedding"), kind):
                ids = batch.column("vec_id").take(pa.array(at))
                known = ids.is_valid()
                width = pa.array(np.full(len(at), rows.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays([ids.filter(known), width.filter(known), binary_rows(rows).filter(known)], names=["vec_id", "width", "vector"])

    return rows_of


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, width, vector): components as they are in the column, floats or else doubles."""
    column = embeddings.schema["embedding"].dataType
    rows = embeddings.select(F.col("vec_id").cast("long"), "embedding").transform(map_arrow, _usable(kind_of(column)), "vec_id long, width int, vector binary")
    return rows.withMetadata("vector", {"kind": np.dtype(kind_of(column)).name})


def _kind(vectors: DataFrame) -> type:
    return np.dtype(vectors.schema["vector"].metadata["kind"]).type


def build_index(vectors: DataFrame, shard: int = SHARD, degree: int = DEGREE, beam: int = BUILD_BEAM) -> DataFrame:
    """One row a shard of ``vectors(vec_id, width, vector)``, written to the scratch folder: a shard is a task of its own."""
    widths, shards = [], 0
    for row in vectors.groupBy("width").count().orderBy("width").collect():  # one row a length
        here = math.ceil(row["count"] / shard)
        widths.append((row["width"], shards, here))
        shards += here
    spread = vectors.sparkSession.createDataFrame(widths, "width int, first int, shards int")
    dealt = vectors.join(F.broadcast(spread), "width").withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("shards"))).cast("int"))
    dealt = dealt.select("shard", "vec_id", "vector").repartitionById(max(1, shards), "shard").sortWithinPartitions("shard")
    return write_table(dealt.transform(map_arrow, _built(degree, beam, _kind(vectors)), _INDEX), compression="uncompressed")[0]


def _blocked(kind: type):
    """Queries of a length packed ``BLOCK`` to a row."""

    def packed(batches):
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths).tolist():
                some = batch.take(pa.array(np.flatnonzero(widths == width)))
                ids, rows = some.column("vec_id").to_numpy(), from_binary(some.column("vector"), kind)
                for low in range(0, len(ids), BLOCK):
                    columns = [pa.array([width], pa.int32()), *(pa.array([x[low : low + BLOCK].tobytes()], pa.binary()) for x in (ids, rows))]
                    yield pa.RecordBatch.from_arrays(columns, names=["width", "ids", "rows"])

    return packed


def search(index: DataFrame, queries: DataFrame, k: int = 10, beam: int = QUERY_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each of ``queries(vec_id, width, vector)``, its own id left out.

    A task holds one shard's graph and one block of queries. All queries meet all shards of their length, in blocks.
    """
    kind = _kind(queries)
    blocks = queries.transform(map_arrow, _blocked(kind), "width int, ids binary, rows binary").withColumn("hash", F.xxhash64("ids"))
    blocks, _ = write_table(blocks, compression="uncompressed")
    copies = max(1, math.ceil(blocks.count() / BLOCKS))
    null = lambda kind: F.lit(None).cast(kind)
    every = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), F.lit(0).alias("kind"), "ids", "begin", "rows", "edges", "width", "entry")
    asked = blocks.join(index.select("shard", "width"), "width").select("shard", F.pmod("hash", F.lit(copies)).cast("int").alias("copy"), F.lit(1).alias("kind"), "ids", null("binary").alias("begin"), "rows", null("binary").alias("edges"), "width", null("int").alias("entry"))
    tasks = every.unionByName(asked).repartition("shard", "copy").sortWithinPartitions("shard", "copy", "kind")

    def searched(batches):
        graph = ids = begin = whole = None
        scale = 1.0
        for batch in batches:
            for r in batch.to_pylist():
                width = r["width"]
                if r["kind"] == 0:
                    whole = np.frombuffer(r["rows"], kind).reshape(-1, width).astype(np.float64)
                    scale = float(np.abs(whole).max())
                    graph = Graph(_scaled(whole, scale), np.frombuffer(r["edges"], np.int32).reshape(len(whole), -1), r["entry"])
                    ids, begin = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["begin"], np.int64)
                    continue
                asked = np.frombuffer(r["ids"], np.int64)
                points = np.frombuffer(r["rows"], kind).reshape(len(asked), width).astype(np.float64)
                near, _ = graph.beam(_scaled(points, scale), beam, 8)
                near = near[:, : max(4 * k, 64)]
                total = np.zeros(near.shape)
                for d in range(width):  # in order of the components, so that equal vectors have equal scores anywhere
                    diff = whole[:, d][near] - points[:, d][:, None]
                    total += diff * diff
                score = np.where(near >= 0, np.sqrt(total), np.inf)
                query, spot = np.nonzero(np.isfinite(score))
                node, score = near[query, spot], score[query, spot]
                size = np.minimum(begin[node + 1] - begin[node], k + 1)  # the smallest ids of equal vectors
                at = np.repeat(begin[node] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                query, found, score = np.repeat(query, size), ids[at], np.repeat(score, size)
                other = found != asked[query]
                query, found, score = query[other], found[other], score[other]
                order = np.lexsort((found, score, query))
                query, found, score = query[order], found[order], score[order]
                top = np.arange(len(query)) - np.searchsorted(query, query) < k
                yield pa.RecordBatch.from_arrays([pa.array(asked[query[top]]), pa.array(found[top]), pa.array(score[top])], names=["query_id", "vec_id", "score"])

    found = tasks.transform(map_arrow, searched, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_pruned_graph_search(spark, sf_dir: str) -> DataFrame:
    vectors = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(build_index(vectors), vectors.where("vec_id % 100 = 0"))


#: The exact answer, which the search finds at sizes where a beam passes most of a shard.
SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, x: a + x)) AS score FROM v AS q JOIN v AS c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
