"""Toxicity by a classifier chain of logistic models on words.

A chain predicts its categories one after another: each later model has, beside the words, the log-odds of all earlier
categories. In training these come from out-of-fold predictions, so that later models learn from probabilities as good as
those they will meet; in scoring from models of all folds' rows. The chain is fitted on a bounded, seeded sample of the
labelled documents (``SAMPLE`` rows at most twice over), and applied to every document's whole text. A category's threshold is
the one with the best F1 of the out-of-fold predictions, kept to ``LEAST`` at least.

Words are runs of ASCII letters and digits and of other bytes over 0x7F, in ASCII lower case. A feature is a word or a word
beginning of 4, 5, 6 or 8 bytes; its value is its share of the document's words, shrunk towards 0 in short ones. Those
``FEATURES`` are used that tell a category best by chi-squared of their presence in the sample.

Defined cases: a null or empty text has no words and gets the chain's intercepts; rows with a null label don't train; a document
labelled more than once trains with its worst labels; without labelled rows, or without both values of a category, its
probability is the share of its positives (0 where there are none) and nothing is rejected for it; repeated rows are scored
each; an empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetflow.llm.common import batches_by_bytes, column_bytes, map_arrow, mix, word_hashes, write_table

#: In order of prediction. The label table judges quality and toxicity.
CATEGORIES = ("low_quality", "toxic")
SAMPLE = 4000
#: Per category.
FEATURES = 192
PREFIXES = (4, 5, 6, 8)
#: Words added to a document's length, and the scale of a feature's share.
SHRINK, SCALE = 50, 100.0
FOLDS = 4
PENALTY = 1.0
LEAST = 0.2
_TEXT_BYTES = 1 << 20
_WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_LOWER = np.array([b | 0x20 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


class Bag:
    """Feature hashes of every word of a column, by kind of feature, with the words' rows."""

    def __init__(self, text: pa.Array):
        buf, at = column_bytes(text)
        self.rows = len(text)
        buf = _LOWER[buf]
        dark = np.concatenate([[False], _WORD[buf], [False]])
        edge = np.zeros(len(buf) + 1, bool)
        edge[at] = True
        start = np.flatnonzero(dark[1:-1] & (~dark[:-2] | edge[:-1]))
        end = np.flatnonzero(dark[1:-1] & (~dark[2:] | edge[1:])) + 1
        row = np.searchsorted(at, start, side="right") - 1
        self.words = np.bincount(row, minlength=self.rows)
        self.features = [(word_hashes(buf, start, end), row)]
        padded = np.concatenate([buf, np.zeros(8, np.uint8)])
        eight = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(buf) + 1,), (1,))
        for n in PREFIXES:
            long = end - start >= n
            head = eight[start[long]] & np.uint64((1 << 8 * n) - 1)
            self.features.append((mix(head + np.uint64(n)), row[long]))

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Row and feature, once each."""
        pairs = [_pairs(row, h) for h, row in self.features]
        return np.concatenate([r for r, _ in pairs]), np.concatenate([h for _, h in pairs])

    def shares(self, features: np.ndarray) -> np.ndarray:
        """A row per text, a column per feature of a sorted list."""
        out = np.zeros((self.rows, len(features)))
        if not len(features):
            return out
        likely = np.zeros(1 << 16, bool)
        likely[(features & np.uint64(0xFFFF)).astype(np.int64)] = True
        for h, row in self.features:
            some = np.flatnonzero(likely[(h & np.uint64(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(features, h[some]), len(features) - 1)
            hit = features[at] == h[some]
            out += np.bincount(row[some[hit]] * len(features) + at[hit], minlength=out.size).reshape(out.shape)
        return out * (SCALE / (self.words + SHRINK))[:, None]


def _pairs(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the last weight is the intercept, not penalised."""
    x = np.column_stack([x, np.ones(len(x), x.dtype)]).astype(np.float64)
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * w
        curve = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x
        curve[np.diag_indices_from(curve)] += ridge
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -12, 12)


@dataclass
class Chain:
    """features: sorted word hashes; per category a weight vector, or a constant log-odds, and a threshold."""

    features: np.ndarray
    weights: list[np.ndarray | float]
    thresholds: list[float]
    out_of_fold: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = []
        for w in self.weights:
            z = _odds(x, w) if isinstance(w, np.ndarray) else np.full(len(x), w)
            out.append(1 / (1 + np.exp(-z)))
            x = np.column_stack([x, z])
        return np.column_stack(out)


def fit_chain(features: np.ndarray, x: np.ndarray, labels: np.ndarray, folds: int = FOLDS, least: float = LEAST, seed: int = 23) -> Chain:
    """``x``: a row per document, a column per feature; ``labels``: a column of 0 and 1 per category, in the chain's order."""
    count = len(x)
    weights, thresholds, outs = [], [], []
    fold = np.random.default_rng(seed).permutation(count) % folds
    for y in labels.T:
        if not 0 < y.sum() < count:
            share = y.mean() if count else 0.0
            odds = float(np.clip(np.log(max(share, 1e-9) / max(1 - share, 1e-9)), -12, 12))
            weights.append(odds)
            thresholds.append(2.0)
            out = np.full(count, odds)
        else:
            out = np.zeros(count)
            for k in range(folds):
                if (fold == k).any():
                    out[fold == k] = _odds(x[fold == k], fit_logistic(x[fold != k], y[fold != k]))
            weights.append(fit_logistic(x, y))
            p = 1 / (1 + np.exp(-out))
            grid = np.linspace(least, 0.95, 16)
            f1 = [2 * (y * (p >= t)).sum() / max(y.sum() + (p >= t).sum(), 1) for t in grid]
            thresholds.append(float(grid[int(np.argmax(f1))]))
        outs.append(1 / (1 + np.exp(-out)))
        x = np.column_stack([x, out])
    return Chain(features, weights, thresholds, np.column_stack(outs) if outs else np.empty((count, 0)))


def _parts(batch: pa.RecordBatch, column: str):
    """Slices of a batch with a bounded number of bytes and rows."""
    for low, high in batches_by_bytes(batch.column(column), _TEXT_BYTES):
        for a in range(low, high, 1024):
            yield batch.slice(a, min(1024, high - a))


def choose_features(sample: DataFrame, categories: tuple[str, ...], features: int = FEATURES) -> np.ndarray:
    """The features that tell each category best: counts of documents, summed per batch before the shuffle."""
    names = [f"y{k}" for k in range(len(categories))]

    def counted(batches):
        for batch in batches:
            for some in _parts(batch, "text"):
                row, h = Bag(some.column("text")).distinct()
                found, which = np.unique(h, return_inverse=True)
                sums = [np.bincount(which, minlength=len(found)), *(np.bincount(which, weights=some.column(n).to_numpy()[row], minlength=len(found)) for n in names)]
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), *[pa.array(x.astype(np.float64)) for x in sums]], names=["feature", "df", *names])

    count, *positives = sample.agg(F.count("*"), *[F.sum(n) for n in names]).first()
    if not count:
        return np.empty(0, np.uint64)
    rows = sample.transform(map_arrow, counted, "feature long, df double, " + ", ".join(f"{n} double" for n in names))
    rows = rows.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("df", *names)]).where(F.col("df").between(3, count - 1))
    chosen: set[int] = set()
    for n, positive in zip(names, positives, strict=True):
        share = positive / count
        if not 0 < share < 1:
            continue
        expected = F.col("df") * share
        chi = (F.col(n) - expected) ** 2 / (expected * (1 - share) * (1 - F.col("df") / count))
        chosen |= {r[0] for r in rows.select("feature", chi.alias("chi")).orderBy(F.desc("chi"), "feature").limit(features).collect()}
    return np.sort(np.array(sorted(chosen), np.int64).view(np.uint64))


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, sample: int = SAMPLE) -> Chain:
    """``labels(doc_id, *categories)``: 0 or 1 each. The driver gets the chosen features' values of the sample.

    At most 2 * ``sample`` labelled documents; of rows that share a doc_id, the one whose text has the smallest hash.
    """
    names = [f"y{k}" for k in range(len(categories))]
    clean = labels.dropna(subset=["doc_id", *categories]).groupBy("doc_id").agg(*[F.max(F.col(c).cast("double")).alias(n) for c, n in zip(categories, names, strict=True)])
    share = min(1.0, sample / max(1, clean.count()))
    some = clean.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))).orderBy(F.xxhash64("doc_id")).limit(2 * sample)
    known = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", *names)
    rows, _ = write_table(known.agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("first")).select(*names, "first.text"))
    features = choose_features(rows, categories)

    def valued(batches):
        for batch in batches:
            for part in _parts(batch, "text"):
                x = Bag(part.column("text")).shares(features).astype(np.float32)
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array([r.tobytes() for r in x], pa.binary())], names=[*names, "x"])

    got = rows.transform(map_arrow, valued, ", ".join(f"{n} double" for n in names) + ", x binary").collect()
    got.sort(key=lambda r: (bytes(r[-1]), tuple(r[:-1])))
    x = np.array([np.frombuffer(r[-1], np.float32) for r in got], float).reshape(len(got), len(features))
    return fit_chain(features, x, np.array([r[:-1] for r in got], float).reshape(len(got), len(categories)))


def score(docs: DataFrame, chain: Chain, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """(doc_id, p_<category>..., <category>...): probabilities, and whether each reaches its threshold."""
    thresholds = np.array(chain.thresholds)

    def scored(batches):
        for batch in batches:
            for some in _parts(batch, "text"):
                p = chain.probabilities(Bag(some.column("text")).shares(chain.features))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), *[pa.array(c) for c in p.T], *[pa.array(c) for c in (p >= thresholds).T]], names=["doc_id", *[f"p_{c}" for c in categories], *categories])

    kind = "doc_id long, " + ", ".join([*[f"`p_{c}` double" for c in categories], *[f"`{c}` boolean" for c in categories]])
    return docs.select(F.col("doc_id").cast("long"), "text").transform(map_arrow, scored, kind)


def judged(labels: DataFrame) -> DataFrame:
    """The label table as the chain's categories."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the chain doesn't call toxic, in one pass over them."""
    chain = train(docs, judged(labels))
    threshold, names = chain.thresholds[-1], docs.columns

    def clean(batches):
        for batch in batches:
            for some in _parts(batch, "__text"):
                p = chain.probabilities(Bag(some.column("__text")).shares(chain.features))[:, -1]
                yield pa.RecordBatch.from_arrays(some.filter(pa.array(p < threshold)).columns[:1], names=["record"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("record"), F.col("text").alias("__text"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.transform(map_arrow, clean, f"record {kind}").select("record.*")


def op6_toxicity_chain(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chain = train(docs, judged(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score(docs, chain).drop("low_quality")
