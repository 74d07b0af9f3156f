"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

The last token of a prefix's encoding decides it: what stands before that token is the encoding of the shorter prefix. Of the
vocabulary's pieces that end at a place, exactly one may follow the last token of the prefix before it, and two pieces may
follow each other if the library encodes their joint text as these two. So count(prefix) is count(prefix before the last
token) + 1, and a character that no piece holds costs its UTF-8 bytes. Nothing is encoded but pairs of pieces, once a worker.

A text is cut where two neighbouring characters occur together in no piece, as no merge can cross such a place; the steps
of equal cuts are computed once a worker and put together with numpy. Of a text, the table keeps one step a character: how
many tokens more (or fewer: counts aren't monotone) the prefix has with it. Sums of steps answer questions about prefixes
without encoding again (``prefix_tokens``, ``longest_prefix``).

The model is a byte-fallback BPE for ``sentencepiece`` whose normaliser changes nothing but the leading space it puts in front
of a text that is not empty. Special strings inside texts are ordinary text, as is the library's default.

Defined cases: a null or empty text has no tokens and no steps; repeated rows and rows without doc_id are rows of their own;
a text of any length is one row, whole; an empty table gives an empty table; other columns are ignored, whatever their
names. Cuts are told apart by 64-bit hashes; among two million kept ones two agree with probability 1e-7.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetflow.llm.common import batches_by_bytes, column_bytes, map_arrow, word_hashes

LIMIT = 4096
#: Cuts remembered by a worker, of so many characters at most: some 50 bytes each.
MOST_CUTS, LONG_CUT = 2_000_000, 64
MOST_PAIRS = 2_000_000
TEXT_BYTES = 2 << 20
#: The space as the model's pieces write it.
_SPACE = "▁"
_UNKNOWN = -1
#: A character that no piece holds.
_ALONE = "\n"
PREFIXES = "doc_id long, n_chars long, n_bytes long, n_tokens long, width int, steps binary"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PrefixCounter:
    _open: dict[str, PrefixCounter] = {}

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.head = self.model.encode(_ALONE)
        kinds = (self.model.is_control, self.model.is_unknown, self.model.is_unused, self.model.is_byte)
        plain = [i for i in range(self.model.get_piece_size()) if not any(kind(i) for kind in kinds)]
        texts = [self.model.id_to_piece(i).replace(_SPACE, " ") for i in plain]
        self.pieces = {t: i for t, i in zip(texts, plain, strict=True) if self._encoded(t) == [i]}
        if any(_ALONE in t for t in texts):
            raise ValueError("a piece of the vocabulary holds a line feed")
        self.text = {i: t for t, i in self.pieces.items()}
        self.longest = max(map(len, self.pieces))
        joined = np.zeros(1 << 16, bool)
        for text in texts:
            raw = np.frombuffer(text.encode(), np.uint8).astype(np.uint16)
            joined[raw[:-1] << 8 | raw[1:]] = True
        # a byte inside a character never begins a cut
        joined |= (np.arange(1 << 16) & 0xC0) == 0x80
        self.joined = joined
        self.follow: dict[int, bool] = {}
        self._forget()

    @classmethod
    def at(cls, path: str) -> PrefixCounter:
        """One per path and worker process, which serves many tasks."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _forget(self) -> None:
        self.known, self.where = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.begin, self.flat = np.zeros(1, np.int64), np.empty(0, np.int32)

    def _encoded(self, text: str) -> list[int]:
        """Ids without the space that the library puts in front: it stands before a character that joins nothing."""
        return self.model.encode(_ALONE + text)[len(self.head) :]

    def _fits(self, left: int, right: int) -> bool:
        if len(self.follow) >= MOST_PAIRS:
            self.follow.clear()
        fits = self.follow[left << 32 | right] = self._encoded(self.text[left] + self.text[right]) == [left, right]
        return fits

    def counts(self, text: str, count: list[int] | None = None, last: list[int] | None = None) -> list[int]:
        """Tokens of each prefix of a text, of none of its characters to all; no space is put in front.

        ``count`` and ``last`` are what is known already of the text's first prefixes; they grow.
        """
        count, last = ([0], [_UNKNOWN]) if count is None else (count, last)
        find, follow, fits, longest = self.pieces.get, self.follow.get, self._fits, self.longest
        for end in range(len(count), len(text) + 1):
            if text[end - 1] not in self.pieces:
                count.append(count[-1] + len(text[end - 1].encode()))
                last.append(_UNKNOWN)
                continue
            for begin in range(max(0, end - longest), end):
                piece = find(text[begin:end])
                if piece is None:
                    continue
                left = last[begin]
                known = left == _UNKNOWN or follow(left << 32 | piece)
                if known or known is None and fits(left, piece):
                    count.append(count[begin] + 1)
                    last.append(piece)
                    break
            else:
                raise ValueError(f"no piece of the vocabulary ends {text[:end]!r}")
        return count

    def _steps_of(self, cuts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The length of each cut, and the steps of all one after another; a prefix shared with the cut before in order is kept."""
        size = np.array([len(x) for x in cuts], np.int64)
        upto = np.cumsum(size) - size
        steps = np.empty(size.sum(), np.int32)
        before, count, last = "", [0], [_UNKNOWN]
        for k in sorted(range(len(cuts)), key=cuts.__getitem__):
            text = cuts[k]
            same = 0
            for x, y in zip(before, text, strict=False):
                if x != y:
                    break
                same += 1
            del count[same + 1 :], last[same + 1 :]
            sums = self.counts(text, count, last)
            steps[upto[k] : upto[k] + size[k]] = [y - x for x, y in itertools.pairwise(sums)]
            before = text
        return size, steps

    def _learn(self, hashes: np.ndarray, cuts: list[str]) -> None:
        if len(self.known) + len(cuts) > MOST_CUTS:
            self._forget()
        size, flat = self._steps_of(cuts)
        new = len(self.begin) - 1 + np.arange(len(size))
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(size)])
        self.flat = np.concatenate([self.flat, flat])
        at = np.searchsorted(self.known, hashes)
        self.known, self.where = np.insert(self.known, at, hashes), np.insert(self.where, at, new)

    def steps(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The steps of all rows' characters, and where each row's begin; null is empty."""
        column = pc.replace_substring(column.cast(pa.large_string()).fill_null(""), _SPACE, " ")
        empty = pc.equal(pc.binary_length(column), 0)
        spaced = pc.if_else(empty, column, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string())))
        buf, at = column_bytes(spaced)
        if not len(buf):
            return np.empty(0, np.int32), np.zeros(len(at), np.int64)
        cut = np.ones(len(buf) + 1, bool)
        cut[1:-1] = ~self.joined[buf[:-1].astype(np.uint16) << 8 | buf[1:]]
        cut[at] = True
        edge = np.flatnonzero(cut)
        start, end = edge[:-1], edge[1:]
        hashes, example, kind = np.unique(word_hashes(buf, start, end), return_index=True, return_inverse=True)
        lengthy = (end - start)[example] > LONG_CUT
        decoded = lambda spans: [buf[start[k] : end[k]].tobytes().decode() for k in spans]
        short, spans = hashes[~lengthy], example[~lengthy]
        spot = np.searchsorted(self.known, short)
        fresh = np.ones(len(short), bool)
        inside = spot < len(self.known)
        fresh[inside] = self.known[spot[inside]] != short[inside]
        if fresh.any():
            if len(self.known) + fresh.sum() > MOST_CUTS:
                self._forget()
                fresh[:] = True
            self._learn(short[fresh], decoded(spans[fresh]))
            spot = np.searchsorted(self.known, short)
        flat, first, length = self.flat, np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int64)
        entry = self.where[spot]
        first[~lengthy], length[~lengthy] = self.begin[entry], self.begin[entry + 1] - self.begin[entry]
        if lengthy.any():  # long cuts are computed here and not kept
            size, own = self._steps_of(decoded(example[lengthy]))
            first[lengthy], length[lengthy] = len(flat) + np.cumsum(size) - size, size
            flat = np.concatenate([flat, own])
        size = length[kind]
        upto = np.concatenate([[0], np.cumsum(size)])
        out = flat[np.repeat(first[kind] - upto[:-1], size) + np.arange(upto[-1])]
        begin = upto[np.searchsorted(start, at)]
        # the space in front belongs to no prefix: its step is the first character's
        head = begin[:-1][np.diff(begin) > 0]
        out[head + 1] += out[head]
        keep = np.ones(len(out), bool)
        keep[head] = False
        return out[keep], begin - np.concatenate([[0], np.cumsum(np.diff(begin) > 0)])


def _stored(steps: np.ndarray) -> tuple[int, bytes]:
    """Little-endian numbers of the fewest bytes that hold all steps."""
    for width in (1, 2, 4):
        most = (1 << (8 * width - 1)) - 1
        if not len(steps) or (steps.max() <= most and steps.min() >= -most):
            break
    return width, steps.astype(f"<i{width}").tobytes()


def prefix_counts(docs: DataFrame, model: str | None = None) -> DataFrame:
    """For each row of ``docs(doc_id, text)``: characters, UTF-8 bytes, tokens, and the steps of all prefixes.

    ``steps`` holds a signed number of ``width`` bytes a character; the sum of the first k is the exact token count of the
    first k characters.
    """

    def counted(batches):
        counter = PrefixCounter.at(model or default_path())
        for batch in batches:
            doc_id, text = batch.column("doc_id").cast(pa.int64()), batch.column("text")
            for low, high in batches_by_bytes(text, TEXT_BYTES):
                part = text.slice(low, high - low)
                steps, begin = counter.steps(part)
                rows = [_stored(steps[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]
                upto = np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])
                size = pc.fill_null(pc.binary_length(part), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [doc_id.slice(low, high - low), pa.array(np.diff(begin)), size, pa.array(np.diff(upto[begin])), pa.array([w for w, _ in rows], pa.int32()), pa.array([s for _, s in rows], pa.binary())],
                    names=[x.split()[0] for x in PREFIXES.split(", ")],
                )

    return docs.select("doc_id", "text").transform(map_arrow, counted, PREFIXES)


def _read(width: int, steps: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(steps, f"<i{width}"), dtype=np.int64)


def _answered(prefixes: DataFrame, asked: DataFrame, column: str, answer, schema: str) -> DataFrame:
    """Joins questions by doc_id and answers them from the steps; equal neighbours read a text's steps once."""

    def answered(batches):
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            out, last, sums = [], None, None
            for doc_id, wanted, width, steps in zip(*(batch.column(k).to_pylist() for k in ("doc_id", column, "width", "steps")), strict=True):
                if sums is None or last is not steps and last != steps:
                    last, sums = steps, _read(width, steps)
                out.append((doc_id, wanted, *((None,) * (len(names) - 2) if wanted is None else answer(sums, wanted))))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[] for _ in names])], names=names)

    questions = asked.select("doc_id", F.col(column).cast("long").alias(column))
    return questions.join(prefixes.select("doc_id", "width", "steps"), "doc_id").select("doc_id", column, "width", "steps").transform(map_arrow, answered, schema)


def prefix_tokens(prefixes: DataFrame, asked: DataFrame) -> DataFrame:
    """For ``asked(doc_id, chars)``: the tokens of a document's first ``chars`` characters, of all if it has fewer."""
    return _answered(prefixes, asked, "chars", lambda sums, chars: (int(sums[min(chars, len(sums)) - 1]) if len(sums) and chars > 0 else 0,), "doc_id long, chars long, tokens long")


def longest_prefix(prefixes: DataFrame, asked: DataFrame) -> DataFrame:
    """For ``asked(doc_id, budget)``: the characters and tokens of a document's longest prefix of at most ``budget`` tokens."""

    def answer(sums, budget):
        within = np.flatnonzero(sums <= budget)
        return (int(within[-1]) + 1, int(sums[within[-1]])) if len(within) else (0, 0)

    return _answered(prefixes, asked, "budget", answer, "doc_id long, budget long, chars long, tokens long")


def token_counts(docs: DataFrame, limit: int = LIMIT, model: str | None = None) -> DataFrame:
    """Token count of each whole text, its longest prefix's, and whether it passes ``limit``."""
    return prefix_counts(docs, model).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op12_prefix_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
