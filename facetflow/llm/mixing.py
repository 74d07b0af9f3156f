"""Mixing sources to target weights by pivotal dependent rounding; DataFrame and SQL functions only.

Each source's documents have the same fractional number of copies, its target over its size. The whole part is taken as it
is; the fractional part is rounded by the pivotal method with sizes as weights: of two documents one gives words of
probability to the other until one of them is certain, at random so that each one's expectation stays and the
pair's words stay the same. Buckets of about ``FAN`` documents are folded first; each leaves one undecided document, and
these meet in a tree of the same fan. At the root at most one document a source is left, rounded by a seeded coin, so a
source misses its target by less than one document.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; documents of size 0 and
sources of size 0 take 0 words; rows that repeat in doc_id, source and text are documents of their own; an empty
table gives no rows. Other columns are ignored, whatever their names. A document's identity has the hash of its text, so that rows of
one doc_id, or without one, spread over tasks; only rows that repeat whole meet in one, which spills.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetflow.llm.common import write_table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
FAN = 256
_RUN = 1 << 12
SEED = 7_151
#: Up to so many sources, a row of 40 bytes each, their targets are broadcast; beyond, they are joined by shuffle.
BROADCAST_SOURCES = 100_000


def size(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds weight and target to (source, source_size): shares by weight, none above ``most`` times its size.

    Sources in order of the share at which they are full: each one's level is what is left over the weights left; from
    the first that isn't full at its level, all take that level. One row a source passes through one task.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("weight"))
    by_full = W.orderBy("full_at", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_full.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_full.rowsBetween(0, W.unboundedFollowing))
    rows = rows.withColumn("level", (F.lit(share) * F.sum("source_size").over(by_full.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) - before) / left)
    rows = rows.withColumn("full", F.col("full_at") <= F.col("level"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(by_full.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return rows.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(level * F.col("weight"))).drop("cap", "full_at", "level", "full")


#: One step of the fold. held: the undecided document, with ``m`` of its ``size`` words certain; x: the next one.
#: ``up``: the words that held can take, ``down``: those it can give; it takes with probability down / (up + down).
_STEP = """
aggregate(
  slice(items, 2, greatest(size(items) - 1, 0)),
  named_struct('at', 1, 'm', items[0].m, 'next', 2, 'done', cast(array() as array<int>)),
  (s, x) -> named_struct(
    'at', if(({take}) and items[s.at - 1].size - s.m > x.m or not ({take}) and s.m > x.size - x.m, s.at, s.next),
    'm', if({take},
            if(items[s.at - 1].size - s.m <= x.m, x.m - (items[s.at - 1].size - s.m), s.m + x.m),
            if(s.m <= x.size - x.m, x.m + s.m, s.m - (x.size - x.m))),
    'next', s.next + 1,
    'done', array_append(s.done, if({take},
            if(items[s.at - 1].size - s.m <= x.m, 2 * s.at + 1, 2 * s.next),
            if(s.m <= x.size - x.m, 2 * s.at, 2 * s.next + 1)))))
"""
_TAKE = "x.coin * (least(items[s.at - 1].size - s.m, x.m) + least(s.m, x.size - x.m)) < least(s.m, x.size - x.m)"


def _coin(*parts: Column | str) -> Column:
    """A seeded number in [0, 1)."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / float(1 << 53)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, fan: int = FAN) -> DataFrame:
    """(doc_id, digest, source, size, copy, source_size, target, copies): how many times the mix takes each document.

    ``digest`` is a 64-bit hash of the text; ``copy`` numbers rows that repeat in doc_id, digest, source and size from 1. Sizes are counted
    once and written; what follows moves some 70 bytes a document. Source totals are summed before the shuffle, a hot
    source is dealt over its buckets.
    """
    identity = ["doc_id", "digest", "size", "copy"]
    counted = docs.select("doc_id", F.xxhash64("text").alias("digest"), "source", size().alias("size")).groupBy("doc_id", "digest", "source", "size").agg(F.count("*").alias("n"))
    base, _ = write_table(counted)
    sources = base.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    sources, _ = write_table(source_targets(sources, weights, share, most).withColumnRenamed("source", "of"))
    many, largest = sources.agg(F.count("*"), F.max("docs")).first()
    right = F.broadcast(sources) if many <= BROADCAST_SOURCES else sources
    # in two steps, so that no array grows with the number of copies but by its root
    rows = base.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(_RUN).cast("long"))))
    rows = rows.select("doc_id", "digest", "source", "size", F.explode(F.sequence(F.col("from") + 1, F.least(F.col("from") + _RUN, "n"))).alias("copy"))
    rows = rows.join(right, rows.source.eqNullSafe(right.of)).drop("of", "weight")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(ratio)).withColumn("m", (ratio - F.floor(ratio)) * F.col("size"))
    fixed = ["doc_id", "digest", "source", "size", "copy", "source_size", "target", "whole"]
    certain = (F.col("m") <= 0) | (F.col("size") == 0)
    decided = rows.where(certain).select(*fixed, F.lit(0).alias("up"))
    todo = rows.where(~certain)
    nodes = F.ceil(F.col("docs") / fan)
    todo = todo.select(*fixed, "m", nodes.alias("nodes"), F.pmod(F.xxhash64(F.lit(seed), *identity), nodes).alias("node"))
    keys = ["source", "source_size", "target", "whole"]
    for level in range(max(1, math.ceil(math.log(max(largest or 1, 2), fan) + 1e-9))):
        item = F.struct(F.xxhash64(F.lit(seed + 1 + level), *identity).alias("h"), *identity, "m", _coin(F.lit(seed - 1 - level), *identity).alias("coin"))
        folded = todo.groupBy(*keys, "nodes", "node").agg(F.sort_array(F.collect_list(item)).alias("items"))
        folded, _ = write_table(folded.withColumn("fold", F.expr(_STEP.format(take=_TAKE))))
        one = folded.select(*keys, "items", F.explode("fold.done").alias("code")).select(*keys, F.expr("items[shiftright(code, 1) - 1]").alias("x"), (F.col("code") % 2).alias("up"))
        decided = decided.unionByName(one.select("x.doc_id", "x.digest", "source", "x.size", "x.copy", "source_size", "target", "whole", "up"))
        left = F.expr("items[fold.at - 1]")
        fewer = F.ceil(F.col("nodes") / fan)
        todo = folded.select(*keys, left.alias("x"), F.col("fold.m").alias("m"), fewer.alias("nodes"), F.floor(F.col("node") / fan).alias("node"))
        todo = todo.select("x.doc_id", "x.digest", "source", "x.size", "x.copy", "source_size", "target", "whole", "m", "nodes", "node")
    last = todo.select(*fixed, (_coin(F.lit(seed), *identity) * F.col("size") < F.col("m")).cast("int").alias("up"))
    return decided.unionByName(last).select("doc_id", "digest", "source", "size", "copy", "source_size", "target", (F.col("whole") + F.col("up")).alias("copies"))


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it (0 to 2 with the defaults).

    Texts are shuffled once, by doc_id, source, size and the text's hash. Of rows that repeat in these, the first take the
    larger numbers of copies. A row travels whole in a struct, so that its column names clash with nothing; columns may be of any type.
    """

    def key(digest: str) -> Column:
        part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
        return F.concat_ws(",", F.col(digest).cast("string"), F.col("size").cast("string"), part("doc_id"), part("source")).alias("key")

    taken = mix(docs, **parameters).groupBy(key("digest"))
    taken = taken.agg(F.min("copies").alias("low"), (F.sum("copies") - F.count("*") * F.min("copies")).alias("more"))
    rows = docs.select(F.struct("*").alias("record"), "doc_id", "source", F.xxhash64("text").alias("digest"), size().alias("size"))
    rows = rows.select("record", key("digest"), "size")
    rows = rows.select("record", "key", F.row_number().over(W.partitionBy("key").orderBy("size")).alias("k"))
    copies = F.col("low") + F.when(F.col("k") <= F.col("more"), 1).otherwise(0)
    rows = rows.join(taken, "key").select("record", copies.alias("copies")).where("copies > 0")
    return rows.select("record", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("record.*")


def op2_pivotal_mixing(spark, sf_dir: str) -> DataFrame:
    taken = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
