"""Collocations by pattern growth over contiguous words: frequent phrases of up to four words and their scores.

Phrases grow to the right from frequent prefixes, as an occurrence of a phrase holds one of each of its parts:

1. Words are counted, by task before the shuffle; a word under ``least`` begins and continues nothing.
2. A word's projection is the corpus itself, so pairs of frequent words are counted in it, again by task first.
3. Each frequent pair is a prefix with a projected database: its occurrence pointers, of which a row carries what can still
   follow, at most two words, cut where a pair is rare or a piece ends. Rows are shuffled by prefix and sorted; a task walks
   its prefixes' projections depth first, which sorted rows are the order of, and counts every growth. A task holds no
   more than the path it is on.

A prefix with more than a 4096th of all pointers, or 2^24, is dealt over several tasks by the words that follow; its equal
pointers are counted before they are shuffled, and growths by one word are summed over its tasks. Such prefixes are 2^20 at
most, as the limit is never below a 2^20th of all pointers; so their list is broadcast.

Words are 64-bit hashes of language and word. Two words of one hash are found when words are counted, with their smallest
and largest spelling, and the run is repeated with another seed; so counts are exact. Sets of frequent words and pairs are
kept as bits at places given by hash in ``BITS`` bits, whatever the input's size; a place shared with a rare word
lets rows through that later counts remove. Texts are read three times and never shuffled.

Defined cases: a null or empty text has no words; a null language is ``und``, as is a language of that name; rows of equal
doc_id or text are documents of their own; a text of any length is read whole; an empty table gives no phrases; columns
but ``text`` and ``lang`` are ignored, whatever their names. Ranks tie by phrase in UTF-8 byte order, and no two phrases of a
language are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetflow.llm.common import batches_by_bytes, column_bytes, map_arrow, mix, word_hashes, write_table

LEAST = 30
TOP = 2000
#: Bits of the sets of frequent words and pairs: 16 MB a set.
BITS = 1 << 27
TEXT_BYTES = 2 << 20
#: Pointers of one prefix in one task: this share of all, this number at most, but never under the last share.
SHARE, PROJECTED, LEAST_SHARE = 1 << 12, 1 << 24, 1 << 20
_SPREAD = 256
_SOFT = np.zeros(256, bool)
_SOFT[[0x20, 0x09]] = True
_HARD = np.zeros(256, bool)
_HARD[[*map(ord, ".,;:!?"), *range(0x0A, 0x0E)]] = True
_LOWER = np.array([b | 0x20 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)
_H = ("h1", "h2", "h3", "h4")


class Words:
    """The words of a batch's texts, lowered: spans, hashes of language and word, and whether the next word follows in the same piece."""

    def __init__(self, text: pa.Array, lang: pa.Array, seed: int):
        buf, at = column_bytes(text)
        self.buf = _LOWER[buf]
        self.row = self.lang = self.start = self.end = np.empty(0, np.int64)
        self.hash, self.joined = np.empty(0, np.uint64), np.empty(0, bool)
        if not len(buf):
            return
        hard = _HARD[self.buf]
        white = hard | _SOFT[self.buf]
        edge = np.zeros(len(buf) + 1, bool)
        edge[at] = True
        first, last = ~white, ~white
        first[1:] &= white[:-1] | edge[1:-1]
        last[:-1] &= white[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row = np.searchsorted(at, self.start, side="right") - 1
        langs = lang.dictionary_encode()
        self.names = langs.dictionary.to_pylist()
        self.lang = np.asarray(langs.indices)[self.row]
        raw, spans = column_bytes(langs.dictionary)
        of_lang = word_hashes(raw, spans[:-1], spans[1:]) if len(raw) else np.zeros(len(self.names), np.uint64)
        with np.errstate(over="ignore"):
            self.salt = mix(of_lang + np.uint64(seed))
        self.hash = word_key(word_hashes(self.buf, self.start, self.end), self.salt[self.lang])
        breaks = np.cumsum(hard, dtype=np.int32)
        self.joined = np.zeros(len(self.start), bool)
        self.joined[:-1] = (self.row[1:] == self.row[:-1]) & (breaks[self.start[1:]] == breaks[self.start[:-1]])


def word_key(word: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Never 0, which stands for no word."""
    return np.maximum(mix(word ^ salt), np.uint64(1))


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return left ^ (right >> np.uint64(7))


def _batches(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[Words]:
    for batch in batches:
        lang, text = batch.column("lang").cast(pa.string()).fill_null("und"), batch.column("text")
        for low, high in batches_by_bytes(text, TEXT_BYTES):
            words = Words(text.slice(low, high - low), lang.slice(low, high - low), seed)
            if len(words.start):
                yield words


def _signed(*columns: np.ndarray) -> list[pa.Array]:
    return [pa.array(c.view(np.int64)) for c in columns]


class BitSet:
    """Places of a set of 64-bit keys in a table of ``bits`` bits, gathered by Spark in words of 64."""

    def __init__(self, keys: DataFrame, column: Column, bits: int):
        places = keys.select(column.bitwiseAND(F.lit(bits - 1)).alias("place"))
        words = places.selectExpr("shiftright(place, 6) as word", "shiftleft(1L, int(place & 63)) as bit").groupBy("word").agg(F.bit_or("bit").alias("bit"))
        found = words.toArrow()  # bits / 64 rows at most
        table = np.zeros(max(1, bits >> 6), np.int64)
        table[found.column("word").to_numpy()] = found.column("bit").to_numpy()
        self.bits, self.sent = bits, keys.sparkSession.sparkContext.broadcast(table)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        place = (keys & np.uint64(self.bits - 1)).astype(np.int64)
        return (self.sent.value[place >> 6] >> (place & 63)) & 1 == 1


def word_counts(docs: DataFrame, least: int = LEAST, seed: int = 0) -> DataFrame:
    """``h, lang, word, n, clash`` of words with ``n`` of ``least`` or more; a language's total has its ``h`` and no word."""

    def counted(batches):
        for w in _batches(batches, seed):
            hashes, example, n = np.unique(w.hash, return_index=True, return_counts=True)
            names = pa.array(w.names)
            spelled = pa.array([w.buf[a:b].tobytes().decode() for a, b in zip(w.start[example], w.end[example], strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*_signed(hashes), names.take(pa.array(w.lang[example])), spelled, pa.array(n)], names=["h", "lang", "word", "n"])
            total = np.bincount(w.lang, minlength=len(w.names))
            yield pa.RecordBatch.from_arrays([*_signed(w.salt), names, pa.nulls(len(names), pa.string()), pa.array(total)], names=["h", "lang", "word", "n"])

    rows = docs.select("text", "lang").transform(map_arrow, counted, "h long, lang string, word string, n long")
    spelling = F.struct("lang", "word")
    found = rows.groupBy("h").agg(F.sum("n").alias("n"), F.min(spelling).alias("spelling"), F.max(spelling).alias("other"))
    clash = ~F.col("spelling").eqNullSafe(F.col("other"))
    return found.where((F.col("n") >= least) | F.col("spelling.word").isNull() | clash).select("h", "spelling.lang", "spelling.word", "n", clash.alias("clash"))


def pair_counts(docs: DataFrame, words: BitSet, least: int = LEAST, seed: int = 0) -> DataFrame:
    """``h1, h2, n`` of neighbours, each frequent by itself."""

    def counted(batches):
        for w in _batches(batches, seed):
            k = np.flatnonzero(w.joined)
            kept = words.holds(w.hash)
            k = k[kept[k] & kept[k + 1]]
            left, right = w.hash[k], w.hash[k + 1]
            order = np.lexsort((right, left))
            left, right = left[order], right[order]
            new = np.ones(len(k), bool)
            new[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
            at = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([*_signed(left[at], right[at]), pa.array(np.diff(at, append=len(k)))], names=["h1", "h2", "n"])

    rows = docs.select("text", "lang").transform(map_arrow, counted, "h1 long, h2 long, n long")
    return rows.groupBy("h1", "h2").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def grown(docs: DataFrame, pairs: DataFrame, frequent: BitSet, least: int = LEAST, seed: int = 0, share: int = SHARE) -> DataFrame:
    """``h1, h2, h3, h4, n`` of phrases of three words (``h4`` is 0) and four that begin with a frequent pair."""
    spark = docs.sparkSession
    total = pairs.agg(F.sum("n")).first()[0] or 0
    most = max(min(total // share, PROJECTED), total // LEAST_SHARE, 1)
    hot = pairs.where(F.col("n") > most).select("h1", "h2", F.ceil(F.col("n") / most).alias("parts")).toArrow()  # LEAST_SHARE rows at most
    keys = _pair(*(hot.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2")))
    order = np.argsort(keys)
    sent = spark.sparkContext.broadcast((keys[order], hot.column("parts").to_numpy()[order]))

    def pointers(batches):
        keys, parts = sent.value
        for w in _batches(batches, seed):
            h, size = w.hash, len(w.hash)
            pair = np.zeros(size, np.uint64)
            pair[:-1] = _pair(h[:-1], h[1:])
            held = w.joined & frequent.holds(pair)
            k = np.flatnonzero(held)
            k = k[k + 1 < size]
            k = k[held[k + 1]]
            more = k + 2 < size
            more[more] = held[k[more] + 2]
            fourth = np.where(more, h[np.minimum(k + 3, size - 1)], np.uint64(0))
            rows = np.stack([h[k], h[k + 1], h[k + 2], fourth], axis=1)
            part, n = np.full(len(k), -1, np.int32), np.ones(len(k), np.int64)
            if len(keys):
                spot = np.minimum(np.searchsorted(keys, pair[k]), len(keys) - 1)
                split = keys[spot] == pair[k]
                dealt = (mix(rows[:, 2] ^ (rows[:, 3] >> np.uint64(7))) % parts[spot].astype(np.uint64)).astype(np.int32)
                again, at, times = np.unique(rows[split], axis=0, return_index=True, return_counts=True)
                rows = np.concatenate([rows[~split], again])
                part = np.concatenate([part[~split], dealt[split][at]])
                n = np.concatenate([n[~split], times])
            yield pa.RecordBatch.from_arrays([*_signed(*np.ascontiguousarray(rows.T)), pa.array(part), pa.array(n)], names=[*_H, "part", "n"])

    def walked(batches):
        """Of each depth only the growth that the walk is in is held. Rare growths are left out where a task has them whole."""
        open_at = {3: None, 4: None}
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("h1", "h2", "part", "h3", "h4")], axis=1)
            for depth in open_at:
                done, open_at[depth] = _runs(rows[:, : depth + 1], batch.column("n").to_numpy(), open_at[depth])
                yield _growths(done, depth, least)
        for depth, path in open_at.items():
            if path is not None:
                yield _growths(path, depth, least)

    rows = docs.select("text", "lang").transform(map_arrow, pointers, "h1 long, h2 long, h3 long, h4 long, part int, n long")
    tasks = F.col("h1"), F.col("h2"), F.col("part")
    rows = rows.repartition(*tasks).sortWithinPartitions("h1", "h2", "part", "h3", "h4")
    growths = rows.transform(map_arrow, walked, "h1 long, h2 long, h3 long, h4 long, n long")
    return growths.groupBy(*_H).agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _runs(rows: np.ndarray, weight: np.ndarray, before: tuple[np.ndarray, np.ndarray] | None) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray] | None]:
    """Runs of equal rows and their weights: those that are over, and the last one, which may go on in the next batch."""
    if before is not None:
        rows, weight = np.concatenate([before[0], rows]), np.concatenate([before[1], weight])
    if not len(rows):
        return (rows, weight), before
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    rows, weight = rows[at], np.add.reduceat(weight, at)
    return (rows[:-1], weight[:-1]), (rows[-1:], weight[-1:])


def _growths(runs: tuple[np.ndarray, np.ndarray], depth: int, least: int) -> pa.RecordBatch:
    rows, n = runs
    keep = (n >= least) & (rows[:, 4] != 0) if depth == 4 else (n >= least) | (rows[:, 2] >= 0)
    rows, n = rows[keep], n[keep]
    fourth = rows[:, 4] if depth == 4 else np.zeros(len(rows), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (rows[:, 0], rows[:, 1], rows[:, 3], fourth, n)], names=[*_H, "n"])


def frequent_phrases(docs: DataFrame, least: int = LEAST, bits: int = BITS, share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """Words ``(h, lang, word, n)``, with languages' totals, and phrases of one to four words ``(key, n)``, ``key`` an array of hashes."""
    for seed in range(64):
        words, _ = write_table(word_counts(docs, least, seed))
        if words.where("clash").isEmpty():
            break
    else:
        raise ValueError("words share hashes under every seed")
    words = words.drop("clash")
    single = words.where("word is not null")
    pairs, _ = write_table(pair_counts(docs, BitSet(single, F.col("h"), bits), least, seed))
    frequent = BitSet(pairs, F.col("h1").bitwiseXOR(F.shiftrightunsigned("h2", 7)), bits)
    longer, _ = write_table(grown(docs, pairs, frequent, least, seed, share))
    keys = [single.select(F.array("h").alias("key"), "n"), pairs.select(F.array("h1", "h2").alias("key"), "n")]
    keys += [longer.where("h4 = 0").select(F.array("h1", "h2", "h3").alias("key"), "n"), longer.where("h4 <> 0").select(F.array(*_H).alias("key"), "n")]
    return words, keys[0].unionByName(keys[1]).unionByName(keys[2]).unionByName(keys[3])


def scored(phrases: DataFrame) -> DataFrame:
    """``key, a, l, r, score`` of phrases of two words and more, by the cut of the lowest score, without those held in a longer one."""
    phrases = phrases.withColumnRenamed("n", "a")
    longer = phrases.where("size(key) > 2").select("a", F.explode(F.expr("flatten(transform(sequence(2, size(key) - 1), k -> transform(sequence(1, size(key) - k + 1), i -> slice(key, i, k))))")).alias("key"))
    longer = longer.groupBy("key").agg(F.max("a").alias("longest"))
    # 100 f >= 80 a, in lowest terms
    kept = phrases.where("size(key) > 1").join(longer, "key", "left").where("longest is null or 5 * longest < 4 * a")
    cuts = kept.select("key", "a", F.explode(F.expr("sequence(1, size(key) - 1)")).alias("k"))
    cuts = cuts.select("key", "a", "k", F.expr("slice(key, 1, k)").alias("first"), F.expr("slice(key, k + 1, size(key) - k)").alias("rest"))
    cuts = cuts.join(phrases.select(F.col("key").alias("first"), F.col("a").alias("l")), "first").join(phrases.select(F.col("key").alias("rest"), F.col("a").alias("r")), "rest")
    cuts = cuts.select("key", "a", "k", "l", "r", F.expr("cast(a as decimal(19, 0)) * 2000000bd div (cast(l as decimal(19, 0)) + r)").alias("score"))
    return cuts.groupBy("key", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("key", "a", "cut.l", "cut.r", "cut.score")


def spelled(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """``phrases`` with ``lang`` and ``phrase`` in place of ``key``."""
    others = [c for c in phrases.columns if c != "key"]
    each = phrases.select("key", *others, F.posexplode("key").alias("at", "h")).join(words.where("word is not null").select("h", "lang", "word"), "h")
    found = each.groupBy("key", *others).agg(F.any_value("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("parts"))
    return found.select("lang", F.array_join("parts.word", " ").alias("phrase"), *others)


def best(phrases: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language with their ``rank``: first of each of 256 parts of a language, then of what these leave."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = lambda df, *by: df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    parts = ranked(phrases.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(_SPREAD))), "lang", "part")
    return ranked(parts.drop("part", "rank"), "lang").withColumn("rank", F.col("rank").cast("long"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, **parameters) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    words, phrases = frequent_phrases(docs, least, **parameters)
    totals = words.where("word is null").select("lang", "n")
    return best(spelled(scored(phrases), words), top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_CUTS = "(2, 1), (3, 1), (3, 2), (4, 1), (4, 2), (4, 3)"

SQL = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
s AS (SELECT lang, words, unnest(generate_series(1, len(words))) AS i FROM w WHERE len(words) > 0),
g AS (SELECT lang, k, words[i:i + k - 1] AS words, count(*) AS a FROM s, (VALUES (1), (2), (3), (4)) AS t(k) WHERE i + k - 1 <= len(words) GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, count(*) AS n FROM s GROUP BY lang),
h AS (SELECT DISTINCT g.lang, g.words[i:i + j - 1] AS words, max(g.a) OVER (PARTITION BY g.lang, g.words[i:i + j - 1]) AS longest
    FROM g, (VALUES (2), (3)) AS t(j), (VALUES (1), (2), (3)) AS u(i) WHERE j < g.k AND i + j - 1 <= g.k),
c AS (SELECT g.*, x.j, l.a AS l, r.a AS r, (2000000::HUGEINT * g.a) // (l.a + r.a) AS score
    FROM g JOIN (VALUES {_CUTS}) AS x(k, j) USING (k) LEFT JOIN h ON h.lang = g.lang AND h.words = g.words
    JOIN g l ON l.lang = g.lang AND l.words = g.words[1:x.j] JOIN g r ON r.lang = g.lang AND r.words = g.words[x.j + 1:g.k]
    WHERE h.longest IS NULL OR 100::HUGEINT * h.longest < 80::HUGEINT * g.a),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, j) = 1),
o AS (SELECT lang, array_to_string(words, ' ') AS phrase, a, l, r, score FROM b),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT k.lang, k.rank, k.phrase, k.a, k.l, k.r, n.n, k.score::BIGINT AS score FROM k JOIN n ON n.lang = k.lang WHERE k.rank <= 2000
"""
