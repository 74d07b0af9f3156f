"""Stupid-backoff language-model scores.

The n-grams of all documents, of every order up to ``ORDER``, are counted and each word of each document is scored by the
counts: f(w1..wn) / f(w1..wn-1) if the n-gram was seen ``LEAST`` times at least (else it was seen in its own document only),
otherwise 0.4 times the score of the shorter n-gram; a single word by f(w) / N. Scores are summed as logarithms per document.

The relations are packed: a row holds many n-grams. Documents are packed, in the order they are read, into blocks of bounded
size, one compressed row each; a block's distinct n-grams with their counts, exploded and reduced there, go to the partitions of
the count table by ranges of their hash; a partition adds up its part of the table, joins it to what each block sent and
answers with one number per n-gram in the order asked; a block joins the answers to its n-grams by position. A frequent
n-gram so is one entry a block, a row that repeats without end lies in as many blocks as it fills. The number of words is
the count of the empty n-gram.

A block sends a row to each part of the table that it has n-grams of: rows are at most blocks times parts, which grows with the
square of the input, and never more than the n-grams. With the defaults a row holds thousands of n-grams at 1 GB of text,
some ten at 1 TB; where it holds few they are stored plainly, so a row then costs what a plain row of a count table would.

N-grams are told apart by 64-bit hashes.

Words are runs of bytes other than ASCII white space. Defined cases: a null text or one without words has 0 words, the score
0 and no mean; repeated rows are documents of their own, and their words count again; an empty table gives no rows. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetflow.llm.common import batches_by_bytes, column_bytes, map_arrow, mix, next_gram, text_bytes, word_hashes, word_spans

ORDER = 3
ALPHA = 0.4
LEAST = 2
#: Bytes of text of a block, and n-grams of a part of the count table.
BLOCK_BYTES, PART_GRAMS = 8 << 20, 3_000_000
_HEAD = np.uint64(0x51ED270B7F4A7C15)


def _pack(numbers: np.ndarray) -> bytes:
    """Bytes of equal rank together: small numbers and small steps leave runs of zeros. Few numbers as they are, after an x."""
    import zstandard

    wide = numbers.dtype.itemsize
    if len(numbers) < 32:
        return b"x" + numbers.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, wide).T).tobytes())


def _unpack(data: bytes, kind: type) -> np.ndarray:
    import zstandard

    wide = np.dtype(kind).itemsize
    if data[:1] == b"x":  # a frame begins with another byte
        return np.frombuffer(data, kind, offset=1)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(wide, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


class Grams:
    """All n-grams of a block: one array of hashes per order, each word's place in its document, and the distinct hashes."""

    def __init__(self, text: pa.ChunkedArray, order: int):
        buf, at = column_bytes(text)
        start, end, self.first = word_spans(buf, at)
        words = word_hashes(buf, start, end)
        self.count = np.diff(self.first)
        self.place = np.arange(len(words)) - np.repeat(self.first[:-1], self.count)
        distinct, times, spots = [np.zeros(1, np.uint64)], [np.array([len(words)])], []  # the empty n-gram first
        gram, base = mix(words + _HEAD), 1
        for n in range(order):
            if n:
                gram = np.concatenate([gram[:1], next_gram(gram[:-1], words[1:])])  # ends where it stands
            whole = self.place >= n
            some, inverse, count = np.unique(mix(gram[whole] + np.uint64(n)), return_inverse=True, return_counts=True)
            spot = np.zeros(len(words), np.int32)
            spot[whole] = inverse + base
            distinct.append(some), times.append(count), spots.append(spot)
            base += len(some)
        grams = np.concatenate(distinct)
        by = np.argsort(grams, kind="stable")
        rank = np.empty(len(by), np.int32)
        rank[by] = np.arange(len(by), dtype=np.int32)
        self.grams, self.times = grams[by], np.concatenate(times)[by]
        self.none, self.at = rank[0], [rank[spot] for spot in spots]

    def cuts(self, parts: int) -> np.ndarray:
        """Where the count table's parts begin among the distinct hashes."""
        part = ((self.grams >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        return np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))

    def scores(self, total: np.ndarray, alpha: float, least: int) -> np.ndarray:
        """The sum of log scores of each document; ``total``: the corpus' counts of the distinct n-grams."""
        counts = [total[spot].astype(np.float64) for spot in self.at]
        with np.errstate(divide="ignore"):
            score = np.log(counts[0] / total[self.none]) + np.log(alpha) * np.minimum(self.place, len(counts) - 1)
        for n in range(1, len(counts)):
            seen = np.flatnonzero((self.place >= n) & (counts[n] >= least))
            steps = np.minimum(self.place[seen], len(counts) - 1) - n
            score[seen] = np.log(counts[n][seen] / counts[n - 1][seen - 1]) + np.log(alpha) * steps
        out = np.zeros(len(self.count))
        some = np.flatnonzero(self.count)
        out[some] = np.add.reduceat(score, self.first[some]) if len(some) else 0.0
        return out


def _frame(parts: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as stream:
        stream.write_table(pa.Table.from_batches(parts).combine_chunks())
    return sink.getvalue().to_pybytes()


def blocks_of(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, frame): documents in the order read, about ``block_bytes`` of text to a row, a longer text alone."""

    def packed(batches):
        block, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for low, high in batches_by_bytes(batch.column("text"), max(1, block_bytes // 4)):
                part = batch.slice(low, high - low)
                more = part.nbytes
                if held and size + more > block_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([_frame(held)], pa.binary())], names=["block", "frame"])
                    block, held, size = block + 1, [], 0
                held.append(part)
                size += more
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([_frame(held)], pa.binary())], names=["block", "frame"])

    return docs.select(F.col("doc_id").cast("long"), "text").transform(map_arrow, packed, "block long, frame binary")


def score_documents(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, least: int = LEAST, block_bytes: int = BLOCK_BYTES, part_grams: int = PART_GRAMS) -> DataFrame:
    """(doc_id, n_words, score): the sum of the words' natural log scores, with counts over all documents.

    Texts are shuffled once, as compressed blocks (both passes read the same exchange); n-grams cost some 6 bytes each, answers
    less than one. A task holds a block, or a part of the count table.
    """
    grams = max(1, text_bytes(docs) // 5 * order)
    parts = max(1, -(-grams // part_grams))
    dealt = blocks_of(docs, block_bytes)

    def texts(table: pa.Table) -> pa.Table:
        return pa.ipc.open_stream(table.column("frame")[0].as_buffer()).read_all()

    def asked(table: pa.Table) -> pa.Table:
        block, g = table.column("block")[0], Grams(texts(table).column("text"), order)
        cuts = g.cuts(parts)
        some = np.flatnonzero(np.diff(cuts))
        rows = [(_pack(np.diff(g.grams[a:b], prepend=np.uint64(0))), _pack(g.times[a:b].astype(np.uint32))) for a, b in zip(cuts[some].tolist(), cuts[some + 1].tolist(), strict=True)]
        columns = [pa.array(some, pa.int32()), pa.array([block.as_py()] * len(some), pa.int64()), *(pa.array(c, pa.binary()) for c in zip(*rows, strict=True))]
        return pa.table(columns, names=["part", "block", "grams", "times"])

    def counted(table: pa.Table) -> pa.Table:
        lists = [np.cumsum(_unpack(x, np.uint64), dtype=np.uint64) for x in table.column("grams").to_pylist()]
        times = np.concatenate([_unpack(x, np.uint32) for x in table.column("times").to_pylist()])
        found, inverse = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.bincount(inverse, weights=times, minlength=len(found)).astype(np.int64)[inverse]
        ends = np.cumsum([len(x) for x in lists])
        answers = [_pack(x) for x in np.split(total, ends[:-1])]
        return pa.table([table.column("part"), table.column("block"), pa.array(answers, pa.binary())], names=["part", "block", "total"])

    def scored(table: pa.Table, answers: pa.Table) -> pa.Table:
        docs = texts(table)
        g = Grams(docs.column("text"), order)
        by = np.argsort(answers.column("part").to_numpy())
        packed = answers.column("total").to_pylist()
        total = np.concatenate([_unpack(packed[k], np.int64) for k in by])
        return pa.table([docs.column("doc_id"), pa.array(g.count), pa.array(g.scores(total, alpha, least))], names=["doc_id", "n_words", "score"])

    requests = dealt.groupBy("block").applyInArrow(asked, "part int, block long, grams binary, times binary")
    answers = requests.groupBy("part").applyInArrow(counted, "part int, block long, total binary")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored, "doc_id long, n_words long, score double")


def op1_stupid_backoff(spark, sf_dir: str) -> DataFrame:
    scores = score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return scores.select("doc_id", "n_words", F.round("score", 4).alias("score"), F.when(F.col("n_words") > 0, F.round(F.col("score") / F.col("n_words"), 6)).alias("mean_score"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (
  SELECT doc_id, i, w[i] AS a, CASE WHEN i > 1 THEN w[i - 1] || ' ' || w[i] END AS b, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] END AS c
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
n AS (
  SELECT *, count(*) OVER (PARTITION BY a) AS ca, CASE WHEN i > 1 THEN count(*) OVER (PARTITION BY b) END AS cb,
    CASE WHEN i > 2 THEN count(*) OVER (PARTITION BY c) END AS cc, count(*) OVER () AS cn
  FROM t),
p AS (SELECT *, lag(ca) OVER o AS pa, lag(cb) OVER o AS pb FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (
  SELECT doc_id, sum(CASE WHEN cc >= 2 THEN ln(cc / pb) WHEN cb >= 2 THEN ln(cb / pa) + ln(0.4) * (CASE WHEN i > 2 THEN 1 ELSE 0 END)
    ELSE ln(ca / cn) + ln(0.4) * (CASE WHEN i > 2 THEN 2 ELSE i - 1 END) END) AS score
  FROM p GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(s.score, 0.0), 4) AS score, round(s.score / len(w), 6) AS mean_score
FROM d LEFT JOIN s USING (doc_id)
"""
