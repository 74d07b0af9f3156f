"""Token ids of whole columns of text, by the installed ``tokenizers`` library.

White space never joins two tokens of the word-end vocabulary, and neither does the place between an ASCII letter or digit and a
full stop or comma; so a text's ids are those of its pieces between these one after another. The vocabulary is of lower
case, so ASCII capitals are lowered first (unless a control token's "<|" occurs, which is told by case). Each distinct piece
is tokenized once per worker and kept, at some 40 bytes; texts are then assembled with numpy. Pieces are told apart by
64-bit hashes; among two million kept ones two agree with probability 1e-7.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from facetflow.llm.common import column_bytes, word_hashes, word_spans

END = 2
MOST_WORDS = 2_000_000
#: Words given to the library at once: its results hold far more than the ids.
_AT_ONCE = 4096


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_LOWER = np.array([b | 0x20 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)
_PLAIN = np.array([b < 0x80 and chr(b).isalnum() for b in range(256)])
_STOP = np.array([chr(b) in ".," for b in range(256)])


def pieces(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``word_spans``, cut also before full stops and commas that follow an ASCII letter or digit."""
    start, end, first = word_spans(buf, at)
    if not len(start):
        return start, end, first
    cut = np.zeros(len(buf), bool)
    cut[1:] = _STOP[buf[1:]] & _PLAIN[buf[:-1]]
    cut[at[at < len(buf)]] = False
    cut = np.flatnonzero(cut)
    start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    return start, end, np.searchsorted(start, at)


class WordTokenizer:
    _open: dict[str, WordTokenizer] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    @classmethod
    def at(cls, path: str) -> WordTokenizer:
        """One per path and worker process, which serves many tasks."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _forget(self) -> None:
        self.known, self.where = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.begin, self.ids = np.zeros(1, np.int64), np.empty(0, np.uint32)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        if len(self.known) + len(words) > MOST_WORDS:
            self._forget()
        got = [x.ids for k in range(0, len(words), _AT_ONCE) for x in self.tokenizer.encode_batch(words[k : k + _AT_ONCE], add_special_tokens=False)]
        new = len(self.begin) - 1 + np.arange(len(got))
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum([len(x) for x in got])])
        self.ids = np.concatenate([self.ids, np.fromiter((y for x in got for y in x), np.uint32)])
        at = np.searchsorted(self.known, hashes)
        self.known, self.where = np.insert(self.known, at, hashes), np.insert(self.where, at, new)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, and where each row's begin; null is empty."""
        buf, at = column_bytes(column)
        if b"<|" not in memoryview(buf).tobytes():
            buf = _LOWER[buf]
        start, end, first = pieces(buf, at)
        if not len(start):
            return np.empty(0, np.uint32), np.zeros(len(at), np.int64)
        hashes, example, word = np.unique(word_hashes(buf, start, end), return_index=True, return_inverse=True)
        spot = np.searchsorted(self.known, hashes)
        fresh = np.ones(len(hashes), bool)
        inside = spot < len(self.known)
        fresh[inside] = self.known[spot[inside]] != hashes[inside]
        if fresh.any():
            if len(self.known) + fresh.sum() > MOST_WORDS:
                self._forget()
                fresh[:] = True
            spans = example[fresh]
            self._learn(hashes[fresh], [buf[a:b].tobytes().decode() for a, b in zip(start[spans], end[spans], strict=True)])
            spot = np.searchsorted(self.known, hashes)
        entry = self.where[spot][word]
        count = self.begin[entry + 1] - self.begin[entry]
        upto = np.concatenate([[0], np.cumsum(count)])
        flat = np.repeat(self.begin[entry] - upto[:-1], count) + np.arange(upto[-1])
        return self.ids[flat], upto[first]
