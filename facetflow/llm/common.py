"""Shared helpers of the training-data operators: bounded batches, word hashing, shingles."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetflow.operators.graph import components
from facetflow.operators.tables import drop_table, scratch, write_table

__all__ = ["components", "drop_table", "scratch", "write_table"]

#: ASCII white space that separates words: space and 0x09 to 0x0D.
WHITE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_IS_WHITE = np.zeros(256, dtype=bool)
_IS_WHITE[list(WHITE)] = True
_LONG_WORD = 1024
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts; one column, one aggregate."""
    return docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0


#: Arrow batches to and from Python: a few of them are what a worker holds of its input.
BATCH_BYTES = "4m"


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with bounded batches; a worker gives memory back when its task is over."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("67108864", "67108864b", "64m"):
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def tidy(batches):
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return df.mapInArrow(tidy, schema)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> _S)) * _M1
    h = (h ^ (h >> _S)) * _M2
    return h ^ (h >> _S)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column without copying, and the int64 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


def word_spans(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the index of each row's first word (one more entry than rows)."""
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(at), np.int64)
    white = _IS_WHITE[buf]
    first = np.empty(len(buf), bool)
    first[0] = True
    first[1:] = white[:-1]
    inner = at[(at > 0) & (at < len(buf))]
    last = np.empty(len(buf), bool)
    last[-1] = True
    last[:-1] = white[1:]
    first[inner] = True
    last[inner - 1] = True
    dark = ~white
    start = np.flatnonzero(first & dark)
    end = np.flatnonzero(last & dark) + 1
    return start, end, np.searchsorted(start, at)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: its bytes, eight at a time; words over 1024 bytes by BLAKE2b."""
    n = end - start
    h = mix(n.astype(np.uint64) * _GOLD)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(buf) + 1,), (1,))
    todo = np.flatnonzero(n <= _LONG_WORD)
    at, left, k = start[todo], n[todo], 0
    while len(todo):
        got = eight[at + k]
        short = left < 8
        if short.any():
            keep = (np.uint64(1) << (np.minimum(left, 7) * 8).astype(np.uint64)) - np.uint64(1)
            got = np.where(short, got & keep, got)
        h[todo] = mix((h[todo] + _GOLD) ^ got)
        more = left > 8
        todo, at, left, k = todo[more], at[more], left[more] - 8, k + 8
    for i in np.flatnonzero(n > _LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def next_gram(gram: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of an n-gram and one word more."""
    return mix(gram * _M2 + word + _GOLD)


def shingles(words: np.ndarray, first: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's n-word shingles, and where each row's begin.

    A row of 1 to n - 1 words has one shingle, of all its words; a row without words has none.
    """
    count = np.diff(first)
    total = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    begin = np.concatenate([[0], np.cumsum(total)])
    if not len(words):
        return np.empty(0, np.uint64), begin
    row = np.repeat(np.arange(len(count)), total)
    at = np.arange(begin[-1]) - begin[row] + first[row]
    length = np.minimum(count[row], n)
    gram = words[at]
    for k in range(1, n):
        longer = length > k
        if longer.all():
            gram = next_gram(gram, words[at + k])
        else:
            gram[longer] = next_gram(gram[longer], words[at[longer] + k])
    return mix(gram + length.astype(np.uint64)), begin


def batches_by_bytes(column: pa.Array, most: int):
    """Ranges of rows with at most ``most`` bytes of text each; a longer row stands alone."""
    size = np.cumsum(np.concatenate([[0], np.nan_to_num(np.array(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=float)).astype(np.int64)]))
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(size, size[low] + most, side="right")) - 1)
        yield low, high
        low = high
