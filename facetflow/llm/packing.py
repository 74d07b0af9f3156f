"""Hierarchical multi-length packing of token ids into windows of powers of two.

A document's tail, what is left after whole windows of the largest tier, is routed to the smallest tier that holds it. Tiers
are packed from the longest down: the longest piece left opens a window of its tier, and the gap takes the longest pieces
that fit, from its own and all shorter tiers; when none fits, the shortest one is cut to the gap. So every window is full.
What a task has left at its end, less than one window, goes into windows of smaller powers of two.

Windows fill step groups of exactly ``STEP`` tokens: where less than a window is left of a step, smaller powers of two close
it. A task's last group is a rest; ``balanced`` puts the windows of all rests, longest first, into groups of a step
again, so that of all groups one at most is smaller.

A task packs what it reads: ids are never shuffled, and a task holds about ``FLUSH`` tokens and one document's ids. Of
``balanced`` one task orders the windows of the rests, some twenty a packing task.

Defined cases: a null or empty text is the end id alone; repeated rows are documents of their own, pieces of a null doc_id
have a null doc_id; an empty table gives no pieces; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetflow.llm.common import batches_by_bytes, map_arrow, write_table
from facetflow.llm.tokens import END, WordTokenizer, default_path

TIERS = (4096, 2048, 1024, 512, 256)
#: Tokens of a step group: a multiple of the largest tier.
STEP = 16 * 4096
#: Tokens gathered before windows are closed.
FLUSH = 1 << 20
TEXT_BYTES = 2 << 20
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, window int, step_group long"


class _Packer:
    """Pieces are (length, serial, start): serial names the document, also for ties."""

    def __init__(self, tiers: tuple[int, ...], step: int, task: int):
        self.tiers, self.step, self.task = tiers, step, task
        self.docs: dict[int, list] = {}
        self.serial = self.windows = self.tokens = self.filled = 0
        self.waiting: list[tuple[int, int, int]] = []
        self.out: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        serial, start = self.serial, 0
        self.serial += 1
        self.docs[serial] = [doc_id, ids]
        while len(ids) - start >= self.tiers[0]:
            window = self._window(self.tiers[0])
            self._close(window, [(window, serial, start)])
            start += window
        if tail := len(ids) - start:
            insort(self.waiting, (tail, serial, start))
            self.tokens += tail

    def _window(self, tier: int) -> int:
        """The tier, or the largest power of two that is left of the step."""
        left = self.step - self.filled % self.step
        return min(tier, 1 << (left.bit_length() - 1))

    def _take(self, most: int) -> tuple[int, int, int]:
        """The longest piece of at most ``most`` tokens, else the shortest one cut."""
        k = bisect_right(self.waiting, (most, self.serial, 0))
        if k:
            return self.waiting.pop(k - 1)
        length, serial, start = self.waiting.pop(0)
        insort(self.waiting, (length - most, serial, start + most))
        return most, serial, start

    def flush(self) -> None:
        """Closes full windows as long as the waiting pieces fill one of the longest piece's tier."""
        while self.waiting:
            length = self.waiting[-1][0]
            window = self._window(next(t for t in reversed(self.tiers) if t >= length))
            if self.tokens < window:
                break
            self._fill(window)

    def finish(self) -> None:
        self.flush()
        while self.tokens:
            self._fill(self._window(1 << (self.tokens.bit_length() - 1)))

    def _fill(self, window: int) -> None:
        pieces, gap = [], window
        while gap:
            pieces.append(self._take(gap))
            gap -= pieces[-1][0]
        self.tokens -= window
        self._close(window, pieces)

    def _close(self, window: int, pieces: list[tuple[int, int, int]]) -> None:
        sequence, group, offset = self.task << 33 | self.windows, self.task << 33 | self.filled // self.step, 0
        self.windows += 1
        self.filled += window
        for length, serial, start in pieces:
            doc_id, ids = self.docs[serial]
            self.out.append((doc_id, start, length, ids[start : start + length].tobytes(), len(ids), sequence, offset, window, group))
            offset += length

    def pieces(self) -> pa.RecordBatch:
        kept = {serial for _, serial, _ in self.waiting}
        self.docs = {k: v for k, v in self.docs.items() if k in kept}
        names = [x.split()[0] for x in PIECES.split(", ")]
        kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        columns = zip(*self.out, strict=True) if self.out else [[] for _ in names]
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split()[1]]) for c, x in zip(columns, PIECES.split(", "), strict=True)], names=names)


def pack(docs: DataFrame, tokenizer: str | None = None, tiers: tuple[int, ...] = TIERS, step: int = STEP, flush: int = FLUSH) -> DataFrame:
    """Pieces of ``docs(doc_id, text)``: ids as little-endian unsigned 32-bit numbers, with their sequence and offset there.

    ``window`` is the sequence's length, always filled; ``sequence_id`` and ``step_group`` carry the task that packed them.
    """
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(tiers, reverse=True) or step % tiers[0]:
        raise ValueError("tiers are powers of two, longest first; a step is a multiple of the longest")

    def packed(batches):
        words = WordTokenizer.at(tokenizer or default_path())
        packer = _Packer(tiers, step, TaskContext.get().partitionId())
        for batch in batches:
            doc_id, text = batch.column("doc_id").to_pylist(), batch.column("text")
            for low, high in batches_by_bytes(text, TEXT_BYTES):
                ids, begin = words.encode(text.slice(low, high - low))
                for k in range(low, high):
                    packer.add(doc_id[k], np.append(ids[begin[k - low] : begin[k - low + 1]], np.uint32(END)))
                if packer.tokens >= flush:
                    packer.flush()
                if len(packer.out) >= 1024:
                    yield packer.pieces()
        packer.finish()
        yield packer.pieces()

    return docs.select("doc_id", "text").transform(map_arrow, packed, PIECES)


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window", "step_group")


def balanced(pieces: DataFrame, step: int = STEP) -> DataFrame:
    """Written ``pieces`` or their digests, the windows of the tasks' last groups put together into groups of ``step`` tokens.

    Powers of two in order of size never lie across a multiple of a step, so all groups but the last are full.
    """
    rests = pieces.groupBy("step_group").agg(F.sum("length").alias("tokens")).where(F.col("tokens") < step).select("step_group")
    windows = pieces.join(rests, "step_group", "left_semi").select("sequence_id", "window").distinct()
    upto = F.sum("window").over(W.orderBy(F.desc("window"), "sequence_id").rowsBetween(W.unboundedPreceding, -1))
    windows = windows.select("sequence_id", (F.lit(1 << 62) + F.floor(F.coalesce(upto, F.lit(0)) / step)).alias("joint_group"))
    return pieces.join(windows, "sequence_id", "left").withColumn("step_group", F.coalesce("joint_group", "step_group")).select(*pieces.columns)


def packed_digests(docs: DataFrame, **parameters) -> DataFrame:
    """``digests`` of the pieces of ``docs``, step groups balanced over all tasks."""
    return balanced(write_table(digests(pack(docs, **parameters)))[0], parameters.get("step", STEP))


def op8_hierarchical_packing(spark, sf_dir: str) -> DataFrame:
    return packed_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
