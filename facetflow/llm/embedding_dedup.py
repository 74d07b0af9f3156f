"""Near-duplicate embeddings by an inverted multi-index.

Unit vectors are split in two halves, each with a codebook of its own; a pair of codes is a cell of the product grid. Every
vector is kept in its cell and looks for partners in the cells that a multi-sequence traversal meets, nearest first: in
order of the squared distances to the two half cells' bounding planes, summed. Pairs found are verified in double precision.

The traversal goes on until the target recall is met, by default 1: it stops at the summed distance 2 - 2 * similarity, which no
link exceeds, so that every link is met whatever the vectors are like. How fine the codebooks are decides only what that costs:
a cell has about ``CELL`` classes of the largest label, but no more cells are made than leave a sampled vector ``COPIES`` others to look
into on average, so that copies of vectors stay proportional to the rows where vectors are spread over many dimensions.

With a target below 1 the stop is measured: ``QUERIES`` classes, chosen by hash, are compared with all classes of their label in
blocks, and for each link found so the traversal's distance at which it is met is counted, by similarity, into a table of
fixed size. The stop is the distance that meets the target of these links, of every range of similarity on its own, and of the copies
at the very threshold that are made of the sample in random directions. Links unlike the sampled ones can be lost then.

Equal vectors of a label are one class first, a node with a number of its own. Of two cells the one with the smaller number looks
into the other, so that a pair is met once. A cell's vectors are compared in blocks; links are counted where they are found and
only a spanning forest of each block's links leaves it, so groups of any size emit a few rows a vector.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label or a null
vec_id, link with nothing and are components of their own; vectors of different lengths don't link, each length has an index
of its own (one without a sampled vector: one cell); repeated rows are vectors of their own, rows with one vec_id and other
vectors or labels are nodes of their own; an empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetflow.llm.common import components, map_arrow, write_table
from facetflow.llm.vectors import from_binary, kind_of, matrices, unit

SIMILARITY = 0.98
#: Share of links that the traversal has to meet; 1: all, by a bound.
RECALL = 1.0
#: Classes of the largest label in a cell, cells besides its own that a vector looks into on average, and codes of a half at most.
CELL, COPIES, CODES = 256, 8, 1024
#: Rows that the codebooks are trained on, at most about twice as many, and those compared with all to place a measured stop.
SAMPLE, QUERIES = 8192, 2048
#: Ranges of similarity and steps of distance in the table of links.
RANGES, STEPS = 8, 512
#: Classes of a cell that are held as one block; classes that look into the cell stream past it in blocks ``STREAMED`` times as large.
BLOCK, STREAMED = 1024, 8


def train_codebook(rows: np.ndarray, size: int, seed: int, steps: int = 12) -> np.ndarray:
    """k-means; fewer codes where there are fewer rows."""
    rng = np.random.default_rng(seed)
    codes = np.unique(rows[rng.permutation(len(rows))[: min(size, len(rows))]], axis=0)
    for _ in range(steps):
        near = ((codes**2).sum(1) - 2 * rows @ codes.T).argmin(1)
        total = np.zeros_like(codes)
        np.add.at(total, near, rows)
        count = np.bincount(near, minlength=len(codes))
        codes[count > 0] = total[count > 0] / count[count > 0, None]
    return codes


def plane_distances(rows: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's code, and its distance to the planes that bound the other codes' cells: 0 for its own."""
    squares = (rows**2).sum(1)[:, None] + (codes**2).sum(1) - 2 * rows @ codes.T
    own = squares.argmin(1)
    apart = np.sqrt(np.maximum((codes**2).sum(1)[:, None] + (codes**2).sum(1) - 2 * codes @ codes.T, 0))
    gap = squares - squares[np.arange(len(rows)), own][:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        bound = np.where(gap > 0, gap / (2 * apart[own]), 0.0)
    return own, np.maximum(bound, 0)


class MultiIndex:
    """Two codebooks and the summed squared distance at which the traversal stops: at first that which no link exceeds."""

    def __init__(self, rows: np.ndarray, size: int, similarity: float, seed: int = 5):
        self.half, self.width = rows.shape[1] // 2, rows.shape[1]
        self.books = [train_codebook(x, size, seed + k) for k, x in enumerate(self._halves(rows))]
        self.stop = 2 - 2 * similarity + 1e-9  # for rounding

    def _halves(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return rows[:, : self.half], rows[:, self.half :]

    def distances(self, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each row's cell, and of each half the squared distances to the other codes' cells."""
        (own1, far1), (own2, far2) = (plane_distances(x, codes) for x, codes in zip(self._halves(rows), self.books, strict=True))
        return own1 * len(self.books[1]) + own2, [far1**2, far2**2]

    def to_cells(self, far: list[np.ndarray], cells: np.ndarray) -> np.ndarray:
        """Summed distances of each row to each of ``cells``."""
        return far[0][:, cells // len(self.books[1])] + far[1][:, cells % len(self.books[1])]

    def cells(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each row's own cell; row numbers and cells of the traversals, nearest first, own cells left out."""
        own, (far1, far2) = self.distances(rows)
        wide = len(self.books[1])
        order1, order2 = far1.argsort(1, kind="stable"), far2.argsort(1, kind="stable")
        far1, far2 = np.take_along_axis(far1, order1, 1), np.take_along_axis(far2, order2, 1)
        found = []
        for i in range(far1.shape[1]):  # the two sorted sequences: a staircase of pairs under the stop
            for j in range(far2.shape[1]):
                total = far1[:, i] + far2[:, j]
                row = np.flatnonzero(total <= self.stop)
                if not len(row):
                    break
                found.append((row, order1[row, i] * wide + order2[row, j], total[row]))
            if not (far1[:, i] <= self.stop).any():
                break
        row, cell, total = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        by = np.lexsort((total, row))
        row, cell = row[by], cell[by]
        other = cell != own[row]
        return own, row[other], cell[other]


def _index(rows: np.ndarray, size: int, similarity: float, copies: float = COPIES) -> MultiIndex:
    """An index with ``size`` codes of a half, or as many fewer as keep the sampled vectors' visits to other cells to ``copies``."""
    while True:
        index = MultiIndex(rows, size, similarity)
        some = rows[:1024]
        if size == 1 or len(index.cells(some)[1]) / 2 <= copies * len(some):  # of two cells one looks into the other
            return index
        size = size * 2 // 3


def _stop(classes: DataFrame, indexes: dict[int, MultiIndex], queries: dict, kind: type, similarity: float, recall: float) -> dict[int, float]:
    """Of each index the distance at which the traversal meets ``recall`` of the links between ``queries`` and all classes.

    ``queries``: by (label, width) the nodes and vectors of the sampled classes. The driver gets at most RANGES * STEPS
    counts an index.
    """
    exact = 2 - 2 * similarity
    prepared = {k: (nodes, unit(rows), *indexes[k[1]].distances(unit(rows))) for k, (nodes, rows) in queries.items()}

    def counted(batches):
        total: dict[int, np.ndarray] = {}
        for batch in (source.slice(low, 1024) for source in batches for low in range(0, len(source), 1024)):
            label, node, data = batch.column("label").to_numpy(), batch.column("node").to_numpy(), batch.column("vector")
            width = _widths(data, kind)
            for of, wide in {*zip(label.tolist(), width.tolist(), strict=True)} & {*prepared}:
                asked, points, home, far = prepared[of, wide]
                some = np.flatnonzero((label == of) & (width == wide))
                rows, index = unit(from_binary(data.take(pa.array(some)), kind)), indexes[wide]
                cosine = rows @ points.T
                i, q = np.nonzero((cosine >= similarity) & (node[some][:, None] != asked))
                if not len(i):
                    continue
                cell, away = index.distances(rows)
                smaller = cell[i] < home[q]  # the cell that looks into the other
                distance = np.where(smaller, away[0][i, home[q] // len(index.books[1])] + away[1][i, home[q] % len(index.books[1])], far[0][q, cell[i] // len(index.books[1])] + far[1][q, cell[i] % len(index.books[1])])
                distance[cell[i] == home[q]] = 0
                spot = np.minimum((cosine[i, q] - similarity) / max(1 - similarity, 1e-12) * RANGES, RANGES - 1).astype(int) * STEPS
                spot += np.clip(np.ceil(distance / exact * (STEPS - 1)), 0, STEPS - 1).astype(int)
                total[wide] = total.get(wide, 0) + np.bincount(spot, minlength=RANGES * STEPS)
        for wide, counts in total.items():
            spot = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(spot), wide)), pa.array(spot), pa.array(counts[spot])], names=["width", "spot", "links"])

    rows = classes.select("label", "node", "vector").transform(map_arrow, counted, "width long, spot long, links long")
    table = {wide: np.zeros((RANGES, STEPS)) for wide in indexes}
    for wide, spot, links in rows.groupBy("width", "spot").agg(F.sum("links")).collect():
        table[wide][spot // STEPS, spot % STEPS] = links
    stops = {}
    rng = np.random.default_rng(17)
    for wide, index in indexes.items():
        reach = [(np.searchsorted(np.cumsum(row), recall * row.sum() - 1e-9)) / (STEPS - 1) * exact for row in table[wide] if row.any()]
        points = np.concatenate([unit(rows) for (_, w), (_, rows) in queries.items() if w == wide] or [np.empty((0, wide))])
        if len(points):  # copies at the threshold, in random directions
            aside = rng.standard_normal(points.shape)
            aside = unit(aside - (aside * points).sum(1, keepdims=True) * points)
            copies = similarity * points + np.sqrt(1 - similarity**2) * aside
            (cell, _), (_, far) = index.distances(copies), index.distances(points)
            distance = far[0][np.arange(len(points)), cell // len(index.books[1])] + far[1][np.arange(len(points)), cell % len(index.books[1])]
            reach.append(float(np.quantile(distance, recall, method="higher")))
        stops[wide] = min(exact, max(reach, default=exact)) + 1e-9
    return stops


def _classes(embeddings: DataFrame) -> tuple[DataFrame, DataFrame, type]:
    """(vec_id, label, key) of all rows, key null where the row takes no part; the classes of equal vectors; the components' type."""
    kind = kind_of(embeddings.schema["embedding"].dataType)

    def keyed(batches):
        for batch in batches:
            label, vec_id = batch.column("label"), batch.column("vec_id")
            known = label.is_valid().to_numpy(zero_copy_only=False) & vec_id.is_valid().to_numpy(zero_copy_only=False)
            key, vector = np.full(len(batch), None, object), np.full(len(batch), None, object)
            for rows, at in matrices(batch.column("embedding"), kind):
                for k, row in zip(at[known[at]].tolist(), rows[known[at]], strict=True):
                    vector[k] = row.tobytes()
                    key[k] = hashlib.blake2b(vector[k], digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([vec_id, label, pa.array(key, pa.binary()), pa.array(vector, pa.binary())], names=["vec_id", "label", "key", "vector"])

    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding").transform(map_arrow, keyed, "vec_id long, label long, key binary, vector binary")
    classes = rows.where("key is not null").groupBy("label", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.any_value("vector").alias("vector"))
    # numbers are unique, and fixed as soon as the table is written
    return rows.drop("vector"), write_table(classes.withColumn("node", F.monotonically_increasing_id()))[0], kind


def _widths(vectors: pa.Array, kind: type) -> np.ndarray:
    return pc.binary_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64) // np.dtype(kind).itemsize


def _links(similarity: float, kind: type):
    """Pairs of blocks in, (node, links, other) out: links counted with classes' sizes, and edges of a spanning forest.

    The left block's rows come first and are kept; those of the right one stream through. Components are merged as links
    show up, so each row gives at most an edge a batch.
    """

    def found(batches):
        now, ids, sizes, unit_rows, labels = None, None, None, None, None
        held: list[tuple] = []
        out: dict[str, list] = {"node": [], "links": [], "other": []}

        def add(node, links, other):
            out["node"].append(node), out["links"].append(links), out["other"].append(other)

        def count(node, links):
            add(node[links > 0], links[links > 0], np.full((links > 0).sum(), -1))

        def relabel(new):
            """Kept classes take smaller labels; each that does gives an edge."""
            nonlocal labels
            moved = new != labels
            add(ids[moved], np.zeros(moved.sum(), np.int64), new[moved])
            labels = new

        def close():
            """All kept rows are here; in a block's task with itself, links among them."""
            nonlocal ids, sizes, unit_rows, labels
            ids, sizes = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            unit_rows = unit(np.concatenate([h[2] for h in held]))
            held.clear()
            labels = ids.copy()
            if now[2] == now[3]:
                near = unit_rows @ unit_rows.T >= similarity
                np.fill_diagonal(near, False)
                count(ids, near @ sizes)
                relabel(_settle(near, near, labels, labels)[1])

        for batch in batches:
            key_columns = [batch.column(c).to_numpy() for c in ("label", "cell", "left", "right", "role")]
            cuts = np.flatnonzero(np.any([np.diff(x) != 0 for x in key_columns], axis=0)) + 1
            cuts = np.union1d(cuts, np.arange(BLOCK, len(batch), BLOCK))
            for low, high in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                if low == high:
                    continue
                *key, role = (int(x[low]) for x in key_columns)
                part = batch.slice(low, high - low)
                rep, n, rows = part.column("node").to_numpy(), part.column("n").to_numpy(), from_binary(part.column("vector"), kind)
                if key != now:
                    if held:
                        close()
                    now, unit_rows = key, None
                if role == 0:
                    held.append((rep, n, rows))
                    continue
                if held:
                    close()
                if unit_rows is None:
                    continue  # nothing is kept in this cell
                near = unit(rows) @ unit_rows.T >= similarity
                count(rep, near @ sizes)
                count(ids, near.T @ n)
                some = near.any(1)
                if some.any():
                    theirs, new = _settle(near[some], near[some].T, rep[some], labels)
                    add(rep[some], np.zeros(some.sum(), np.int64), theirs)
                    relabel(new)
            if sum(map(len, out["node"])) > 10_000:
                yield flush(out)
        if held:
            close()
        yield flush(out)

    def flush(out):
        columns = [np.concatenate(out[c]) if out[c] else np.empty(0, np.int64) for c in ("node", "links", "other")]
        for c in out.values():
            c.clear()
        other = pa.array(columns[2], pa.int64(), mask=columns[1] > 0)
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), other], names=["node", "links", "other"])

    return found


def _settle(near: np.ndarray, back: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest labels reachable over links between two sides: of the rows' side, whose own are ``rows``, and of the kept side."""
    highest = np.iinfo(np.int64).max
    theirs = rows
    while True:
        low = np.minimum(theirs, np.where(near, labels, highest).min(1))
        new = np.minimum(labels, np.where(back, low, highest).min(1))
        if (low == theirs).all() and (new == labels).all():
            return theirs, labels
        theirs, labels = low, new


def near_duplicates(embeddings: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK, codes: int | None = None, sample: int = SAMPLE, queries: int = QUERIES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of ``embeddings(vec_id, embedding, label)``."""
    rows, classes, kind = _classes(embeddings)
    count = classes.count()
    chance = F.pmod(F.xxhash64("label", "key"), F.lit(1 << 30))
    some = classes.where(chance < int((1 << 30) * min(1.0, sample / max(count, 1)))).select("label", "node", "vector", chance.alias("chance")).limit(2 * sample).collect()
    by_width: dict[int, list] = {}
    asked: dict[tuple[int, int], list] = {}
    for row in some:
        vector = np.frombuffer(row.vector, kind)
        by_width.setdefault(len(vector), []).append(vector)
        if row.chance < int((1 << 30) * min(1.0, queries / count)):
            asked.setdefault((row.label, len(vector)), []).append((row.node, vector))
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    size = int(np.clip(np.sqrt(largest / CELL), 1, CODES))
    build = (lambda rows: MultiIndex(rows, codes, similarity)) if codes else (lambda rows: _index(rows, size, similarity))
    indexes = {wide: build(unit(np.stack(found))) for wide, found in by_width.items() if wide > 1}
    asked = {k: found for k, found in asked.items() if k[1] in indexes}
    if recall < 1 and any(len(book) > 1 for index in indexes.values() for book in index.books):
        points = {k: (np.array([n for n, _ in found]), np.stack([v for _, v in found])) for k, found in asked.items()}
        for wide, stop in _stop(classes, indexes, points, kind, similarity, recall).items():
            indexes[wide].stop = stop

    def celled(batches):
        for batch in batches:
            width = _widths(batch.column("vector"), kind)
            for wide in np.unique(width).tolist():
                here = np.flatnonzero(width == wide)
                for some in (batch.take(pa.array(here[low : low + 1024])) for low in range(0, len(here), 1024)):
                    yield from visited(some, wide)

    def visited(some, wide):
        if wide in indexes:
            home, row, cell = indexes[wide].cells(unit(from_binary(some.column("vector"), kind)))
        else:  # no vector of this length in the sample: one cell
            home, row, cell = np.zeros(len(some), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        later = cell > home[row]
        at = np.concatenate([np.arange(len(some)), row[later]])
        cells, role = np.concatenate([home, cell[later]]) + (wide << 20), np.repeat([0, 1], [len(some), later.sum()])
        for low in range(0, len(at), 8192):
            part = some.take(pa.array(at[low : low + 8192]))
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(cells[low : low + 8192], pa.int64()), pa.array(role[low : low + 8192], pa.int32()), part.column("node"), part.column("n"), part.column("vector")], names=["label", "cell", "role", "node", "n", "vector"])

    columns = "label long, cell long, role int, node long, n long, vector binary"
    visits = classes.select("label", "node", "n", "vector").transform(map_arrow, celled, columns)
    visits, _ = write_table(visits)
    counts = visits.groupBy("label", "cell").agg(*[F.greatest(F.ceil(F.count_if(F.col("role") == k) / (block * of)), F.lit(1).cast("long")).alias(n) for k, n, of in ((0, "kept", 1), (1, "looking", STREAMED))])
    hot, _ = write_table(counts.where("kept > 1 OR looking > 1"))
    one = F.lit(1).cast("long")
    visits = visits.join(hot, ["label", "cell"], "left").withColumns({"kept": F.coalesce("kept", one), "looking": F.coalesce("looking", one)})
    # blocks of a cell's own classes are 0, 1, ..., those of classes that look into it follow; two blocks meet in a task of their own
    mine = F.when(F.col("role") == 0, F.pmod(F.xxhash64("node"), F.col("kept"))).otherwise(F.col("kept") + F.pmod(F.xxhash64("node"), F.col("looking")))
    to = F.sequence(F.lit(0).cast("long"), F.when(F.col("role") == 0, F.col("kept") + F.col("looking") - 1).otherwise(F.col("kept") - 1))
    visits = visits.withColumn("mine", mine).withColumn("other", F.explode(to))
    visits = visits.select("label", "cell", F.least("mine", "other").alias("left"), F.greatest("mine", "other").alias("right"), (F.col("mine") > F.col("other")).cast("int").alias("role"), "node", "n", "vector")
    visits = visits.repartition("label", "cell", "left", "right").sortWithinPartitions("label", "cell", "left", "right", "role")
    found, _ = write_table(visits.transform(map_arrow, _links(similarity, kind), "node long, links long, other long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked, _ = write_table(components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))))
    names = linked.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("low"))
    verdict = classes.select("label", "key", "node", "rep", "n").join(links, "node", "left").join(linked, "node", "left").join(names, "component", "left")
    verdict, _ = write_table(verdict.select("label", "key", F.coalesce("low", "rep").alias("low"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links")))
    result = rows.join(verdict, ["label", "key"], "left")
    component = F.coalesce("low", "vec_id")
    return result.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op4_multi_index_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH u AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
w AS (SELECT vec_id, label, v, sqrt(list_inner_product(v, v)) AS n FROM u),
p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM w AS a JOIN w AS b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.v, b.v) / (a.n * b.n) >= 0.98),
r AS (
  WITH RECURSIVE reach(a, b) AS (SELECT a, b FROM p UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a)
  SELECT a, min(b) AS low FROM reach GROUP BY a),
l AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT e.vec_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(r.low, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(r.low, e.vec_id)) AS kept
FROM embeddings AS e LEFT JOIN l ON l.a = e.vec_id LEFT JOIN r ON r.a = e.vec_id
"""
