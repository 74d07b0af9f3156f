"""Self-join of documents on the Jaccard similarity of their n-gram sets, by MinHash banding.

Words are runs of bytes other than ASCII white space; a document's set is that of its five-word shingles, as 64-bit hashes; one
of fewer words has a single shingle. Documents with equal words are one class, a node with a number of its own. Rows of a
band and bands are chosen for the target recall at the similarity: a class is shuffled by its band hashes, ids only. A
class lives in one block, with others that share its bands' smallest class; only blocks that share a band meet, each two
of them in one place. There every pair is verified on whole sets; links are counted where they are found and only a
spanning forest of them leaves the task.

Defined cases: a null text or one without words links with nothing, neither do rows with a null doc_id; each is a class of
its own; repeated rows are documents of their own, rows with one doc_id and other texts belong to the classes of their
texts; a class is named by the smallest doc_id that links reach, so that unrelated classes can have one name, but are
never merged; very long texts are hashed whole, one is in memory at a time beside its block; an empty table gives no rows.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetflow.llm.common import batches_by_bytes, column_bytes, components, drop_table, map_arrow, mix, shingles, word_hashes, word_spans, write_table

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.9999
#: The most hash functions that choosing bands may spend.
HASHES = 192
#: Classes, and words, of a block that is held in memory.
BLOCK, BLOCK_WORDS = 256, 500_000
#: Up to so many candidate classes (50 bytes each) are broadcast to the documents; beyond, they are joined by shuffle.
BROADCAST_ROWS = 200_000
_TEXT_BYTES = 1 << 20


def choose_bands(similarity: float, recall: float, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest false candidates, with which the hashes reach the recall."""
    best = (1, 1)
    for rows in range(1, hashes + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-(similarity**rows)))) if similarity < 1 else 1
        if bands * rows > hashes:
            break
        best = (bands, rows)
    return best


def _sets(text: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    buf, at = column_bytes(text)
    start, end, first = word_spans(buf, at)
    hashes = word_hashes(buf, start, end)
    return hashes, first, *shingles(hashes, first, words)


def _keys(hashes: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    data = memoryview(np.ascontiguousarray(hashes)).cast("B")
    return [hashlib.blake2b(data[8 * a : 8 * b], digest_size=16).digest() if b > a else None for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def band_hashes(grams: np.ndarray, begin: np.ndarray, bands: int, rows: int, seed: int = 11) -> np.ndarray:
    """A row per document with grams, in order: its bands' hashes, of the minima of ``rows`` functions each."""
    rng = np.random.default_rng(seed)
    factor = rng.integers(1, 1 << 32, (bands, rows), dtype=np.uint32) | np.uint32(1)
    shift = rng.integers(0, 1 << 32, (bands, rows), dtype=np.uint32)
    low = (grams >> np.uint64(32)).astype(np.uint32)
    some = begin[:-1][np.diff(begin) > 0]
    out = np.empty((len(some), bands), np.uint64)
    held = np.empty_like(low)
    for b in range(bands):
        band = np.full(len(some), b + 1, np.uint64)
        for r in range(rows):
            np.multiply(low ^ shift[b, r], factor[b, r], out=held)
            held ^= held >> np.uint32(15)
            band = mix(band ^ np.minimum.reduceat(held, some)) if len(some) else band
        out[:, b] = band
    return out


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, text_hash, key, words, bands): key and bands null where the document takes no part."""

    def signed(batches):
        for batch in batches:
            for low, high in batches_by_bytes(batch.column("text"), _TEXT_BYTES):
                some = batch.slice(low, high - low)
                hashes, first, grams, begin = _sets(some.column("text"), words)
                has = np.diff(begin) > 0
                values = band_hashes(grams, begin, bands, rows).view(np.int64)
                key = pa.array(_keys(hashes, first), pa.binary())
                offsets = np.concatenate([[0], np.cumsum(has * bands)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("text_hash"), key, pa.array(np.diff(first)), lists], names=["doc_id", "text_hash", "key", "words", "bands"])

    rows_in = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return rows_in.transform(map_arrow, signed, "doc_id long, text_hash long, key binary, words long, bands array<long>")


def _verified(words: int, similarity: float):
    """Pairs of blocks in, (node, links, other) out, like those of the embedding join; the left block's rows come first.

    The left block is kept and indexed; rows of the right one are compared as they come. Components among the kept classes
    are merged as links show up, so that a task's edges are fewer than its rows. A class comes once.
    """

    def found(batches):
        now, held, index, labels, links = None, {}, None, None, None
        ids, sizes = [], np.empty(0, np.int64)
        out: list[tuple[int, int, int | None]] = []

        def near(grams: np.ndarray) -> np.ndarray:
            """Kept classes that are similar to a set."""
            sorted_grams, owner, size = index
            low, high = np.searchsorted(sorted_grams, grams, "left"), np.searchsorted(sorted_grams, grams, "right")
            count = high - low
            at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
            inter = np.bincount(owner[at], minlength=len(size))
            return np.flatnonzero((inter / (size + len(grams) - inter)) >= similarity)

        def join(members: np.ndarray) -> int:
            """Makes kept classes one component; its first."""
            joined = np.unique(labels[members])
            out.extend((ids[k], 0, ids[joined[0]]) for k in joined[1:])
            if len(joined) > 1:
                labels[np.isin(labels, joined)] = joined[0]
            return joined[0]

        def close():
            """Indexes the kept classes; in a block's task with itself, links among them."""
            nonlocal index, labels, links, ids, sizes
            ids, sets = list(held), [s for _, s in held.values()]
            grams, owner = np.concatenate(sets), np.repeat(np.arange(len(ids)), [len(s) for s in sets])
            by = np.argsort(grams, kind="stable")
            index = grams[by], owner[by], np.array([len(s) for s in sets])
            sizes, labels, links = np.array([n for n, _ in held.values()]), np.arange(len(ids)), np.zeros(len(ids), np.int64)
            if now[0] == now[1]:
                for k, s in enumerate(sets):
                    other = near(s)
                    links[k] = sizes[other].sum() - sizes[k]
                    join(other)

        def end():
            """Both blocks were here: each kept class gives its links as one row."""
            if index is None:
                close()
            out.extend((node, int(links[k]), None) for k, node in enumerate(ids) if links[k])

        for batch in batches:
            for low, high in batches_by_bytes(batch.column("text"), _TEXT_BYTES):
                some = batch.slice(low, high - low)
                hashes, first, grams, begin = _sets(some.column("text"), words)
                columns = [some.column(c).to_pylist() for c in ("left", "right", "role", "node", "n")]
                for k, (left, right, role, node, n) in enumerate(zip(*columns, strict=True)):
                    grams_k = np.unique(grams[begin[k] : begin[k + 1]])
                    if (left, right) != now:
                        if held:
                            end()
                        now, held, index = (left, right), {}, None
                    if role == 0:
                        held[node] = (n, grams_k)
                        continue
                    if not held:
                        continue
                    if index is None:
                        close()
                    other = near(grams_k)
                    if len(other):
                        links[other] += n
                        out.append((node, int(sizes[other].sum()), None))
                        out.append((node, 0, ids[join(other)]))
                if len(out) > 20_000:
                    yield flush(out)
        if held:
            end()
        yield flush(out)

    def flush(out):
        columns = list(zip(*out, strict=True)) if out else [[], [], []]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["node", "links", "other"])

    return found


def _meetings(spark, classes: DataFrame, block: int) -> tuple[DataFrame, list[str]]:
    """(node, left, right, role): where each class that shares a band with another is compared; and tables to drop.

    Classes that share a band's smallest class are dealt into blocks; a block meets itself, and those others with which it
    shares a band. A pair of classes meets in one place, that of their two blocks.
    """
    shared = classes.select("node", F.explode("bands").alias("band"))
    low = shared.groupBy("band").agg(F.min("node").alias("low"), F.count("*").alias("c")).where("c > 1").drop("c")
    sharing, path_sharing = write_table(shared.join(low, "band"))
    member = sharing.groupBy("node").agg(F.min("low").alias("leader")).join(classes.select("node", "words"), "node")
    member, path_member = write_table(member)
    blocks = member.groupBy("leader").agg(F.ceil(F.count("*") / block + F.sum("words") / BLOCK_WORDS).alias("blocks"))
    placed, path_placed = write_table(member.join(blocks, "leader").select("node", F.xxhash64("leader", F.pmod(F.xxhash64("node"), "blocks")).alias("block")))
    houses = sharing.select("node", "band").join(placed, "node").select("band", "block").distinct()
    apart = houses.groupBy("band").agg(F.count("*").alias("c")).where("c > 1").select("band")
    houses, path_houses = write_table(houses.join(apart, "band"))
    pairs = houses.withColumnRenamed("block", "left").join(houses.withColumnRenamed("block", "right"), "band").where("left < right").select("left", "right").distinct()
    pairs, path_pairs = write_table(pairs)
    ends = pairs.select(F.col("left").alias("block"), "left", "right").union(pairs.select("right", "left", "right"))
    met = placed.join(ends, "block").select("node", "left", "right", (F.col("block") == F.col("right")).cast("int").alias("role"))
    meetings, path = write_table(met.union(placed.select("node", "block", "block", F.lit(0))))
    for old in (path_sharing, path_member, path_placed, path_houses, path_pairs):
        drop_table(spark, old)
    return meetings, [path]


def _classified(docs: DataFrame, words: int, similarity: float, recall: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, key) of all rows, key null where the row takes no part; and (key, n, links, component, doc_id, text_hash, class_id) of classes."""
    spark = docs.sparkSession
    bands, rows = choose_bands(similarity, recall)
    signed, _ = write_table(signatures(docs, words, bands, rows))
    takes_part = F.col("key").isNotNull() & F.col("doc_id").isNotNull()
    classes = signed.where(takes_part).groupBy("key").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count("*").alias("n"), F.max("words").alias("words"), F.any_value("bands").alias("bands"))
    # numbers are unique, and fixed as soon as the table is written
    classes, path_classes = write_table(classes.select(F.monotonically_increasing_id().alias("node"), "key", "first.*", "n", "words", "bands"))
    meetings, paths = _meetings(spark, classes, block)
    candidates, path_candidates = write_table(meetings.select("node").distinct().join(classes.select("node", "doc_id", "text_hash", "n"), "node"))
    many = candidates.count()
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    texts = texts.join(F.broadcast(candidates) if many <= BROADCAST_ROWS else candidates, ["doc_id", "text_hash"])
    texts = texts.groupBy("node").agg(F.any_value("n").alias("n"), F.any_value("text").alias("text"))  # rows that repeat whole give their text once
    met = texts.join(meetings, "node").repartition("left", "right").sortWithinPartitions("left", "right", "role")
    found, path_found = write_table(met.transform(map_arrow, _verified(words, similarity), "node long, links long, other long"))
    links, path_links = write_table(found.groupBy("node").agg(F.sum("links").alias("links")))
    linked, path_linked = write_table(components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))))
    verdict = classes.drop("bands", "words").join(links, "node", "left").join(linked, "node", "left")
    verdict = verdict.withColumn("component", F.coalesce("component", "node"))
    names = linked.join(classes.select("node", "doc_id"), "node").groupBy("component").agg(F.min("doc_id").alias("class_id"))
    verdict = verdict.join(names, "component", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    verdict, _ = write_table(verdict.drop("node"))
    for old in (path_found, path_candidates, path_links, path_linked, path_classes, *paths):
        drop_table(spark, old)
    return signed.select("doc_id", "text_hash", F.when(takes_part, F.col("key")).alias("key")), verdict


def similar_documents(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_hash, class_id, n_links): the smallest doc_id that links reach, and how many other documents are linked directly.

    What is shuffled: signatures once by key, 16 bytes a band and class twice by band, and the texts of candidate classes.
    """
    own, verdict = _classified(docs, words, similarity, recall, block)
    verdict = verdict.select("key", "class_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    result = own.join(verdict, "key", "left")
    return result.select("doc_id", "text_hash", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def without_similar(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row of each group of similar documents: of its rows one with the smallest (doc_id, hash of the text).

    Rows that link with nothing (null doc_id, null text, no words) all stay. Only where the row to keep is repeated whole,
    its repetitions are reduced to one by a shuffle.
    """
    own, verdict = _classified(docs, words, similarity, recall, block)
    first = verdict.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).select("component", "first.*")
    repeated = own.groupBy("doc_id", "text_hash").agg(F.count("*").alias("again")).where("again > 1")
    first = first.join(repeated, ["doc_id", "text_hash"], "left").withColumn("again", F.coalesce("again", F.lit(1)) > 1)
    wordless = F.col("doc_id").isNull() | F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    rows = docs.select(F.struct("*").alias("record"), F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), wordless.alias("wordless"))
    kept = rows.where("not wordless").join(first, ["doc_id", "text_hash"])
    once, again = kept.where("not again"), kept.where("again").dropDuplicates(["component"])
    return once.select("record").union(again.select("record")).union(rows.where("wordless").select("record")).select("record.*")


def op7_minhash_jaccard_join(spark, sf_dir: str) -> DataFrame:
    found = similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "class_id", "n_links", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
r AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
x AS (SELECT s.doc_id, s.g FROM s JOIN r USING (g)),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x AS a JOIN x AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
p AS (SELECT i.a, i.b FROM i JOIN c AS ca ON ca.doc_id = i.a JOIN c AS cb ON cb.doc_id = i.b WHERE i.n / (ca.n + cb.n - i.n) >= 0.8),
t AS (
  WITH RECURSIVE reach(a, b) AS (SELECT a, b FROM p UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a)
  SELECT a, min(b) AS low FROM reach GROUP BY a),
l AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT d.doc_id, least(d.doc_id, coalesce(t.low, d.doc_id)) AS class_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links,
  d.doc_id = least(d.doc_id, coalesce(t.low, d.doc_id)) AS kept
FROM documents AS d LEFT JOIN t ON t.a = d.doc_id LEFT JOIN l ON l.a = d.doc_id
"""
