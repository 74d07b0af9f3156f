"""Interaction of filters: every order of five filters, by depth-first execution of a trie of permutations.

A state is the set of filters applied so far; its survivors are a persisted DataFrame of verdicts, filtered from those of the
state it is reached from. The trie of the 120 orders has 206 nodes below its root but only 32 states, as survivors don't
depend on the order: a state is executed when the depth-first walk first meets it, and its counts are kept for all orders that
come by again. A state's job counts, of its actual survivors in each part, what each filter that is left removes: all edges
out of the state. At most five states are persisted at a time; a lost executor's blocks are computed again from the written
table of verdicts. Counts go to a table in the scratch folder, 80 edges and 32 states a part, and never to the driver.

Verdicts are computed in one pass over whole texts and written, a row a document and no text: equal texts are told by
SHA-256, and the smallest doc_id of a digest is aggregated before it is shuffled.

Defined cases: a null text is empty; an empty text fails A only, and E where a smaller doc_id has an empty or null text too;
rows without doc_id don't fail E and make no other row fail it, and have no labels; of repeated rows with one doc_id none is
smaller than another, so they pass E by themselves; a null part is the empty string; several labels of a doc_id count as
1 if any of them does; an empty table has no parts and so no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetflow.llm.common import scratch, write_table

WHITE = r"[\x20\x09-\x0D]+"
LEAST_WORDS = 50


def failures(text: Column) -> dict[str, Column]:
    """Conditions of filters A to D on a text; E is about the whole table."""
    words = F.filter(F.split(text, WHITE), lambda w: w != "")
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 65 * F.size(words).cast("long"),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 5 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def verdicts(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """A row a document: ``part``, booleans A to E, and ``good`` and ``toxic`` by label; written."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    rows = rows.select("doc_id", "part", F.sha2("text", 256).alias("digest"), *[c.alias(k) for k, c in failures(F.col("text")).items()])
    rows, _ = write_table(rows)
    copied = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first")
    judged = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    found = rows.join(copied, "digest", "left").join(judged, "doc_id", "left")
    later = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    return write_table(found.select("part", "A", "B", "C", "D", later.alias("E"), F.coalesce(F.col("good") == 1, F.lit(False)).alias("good"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic")))[0]


def trie(judged: DataFrame, names: str) -> DataFrame:
    """Executes the filters ``names`` over ``judged`` in all orders: a row for each part, state and filter not yet applied.

    ``state`` is the set of filters applied before, a bit each; ``survivors`` is what they leave, ``removed`` what the filter
    takes of it. A part without survivors in a state has no rows there.
    """
    path = f"{scratch(judged.sparkSession)}/{uuid.uuid4().hex}.parquet"
    bits = {name: 1 << k for k, name in enumerate(names)}
    done: set[int] = set()

    counts = [
        F.struct(F.lit(name).alias("filter"), F.count_if(name).alias("removed"), F.count_if(F.col(name) & F.col("good")).alias("good_lost"), F.count_if(F.col(name) & F.col("toxic")).alias("toxic_lost")).alias(name)
        for name in names
    ]

    def walk(state: int, survivors: DataFrame) -> None:
        done.add(state)
        left = [name for name in names if not state & bits[name]]
        edges = survivors.groupBy("part").agg(F.count("*").alias("survivors"), *counts)
        edges.select("part", F.lit(state).alias("state"), "survivors", F.inline(F.array(*left))).write.mode("append").parquet(path)
        for name in left:
            after = state | bits[name]
            # met before, or no filter is left to remove anything
            if after in done or len(left) == 1:
                continue
            kept = survivors.where(~F.col(name))
            further = any(after | bits[x] not in done for x in left if x != name) and len(left) > 2
            if further:
                kept = kept.persist(StorageLevel.MEMORY_AND_DISK)
            walk(after, kept)
            if further:
                kept.unpersist()

    root = judged.persist(StorageLevel.MEMORY_AND_DISK)
    walk(0, root)
    root.unpersist()
    return judged.sparkSession.read.schema("part string, state int, survivors long, filter string, removed long, good_lost long, toxic_lost long").parquet(path)


def report(edges: DataFrame, names: str) -> DataFrame:
    """The edges along every order, a row for each part, order and step; a part's edges are a map of fixed size."""
    n = len(names)
    bit = lambda name: F.lit(1 << names.index(name))
    key = lambda state, name: F.concat_ws(" ", state.cast("string"), name)
    weights = F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)).cast("long") for k in range(n)])
    shares = F.sum(F.col("removed") * F.element_at(weights, F.bit_count("state") + 1))
    of_filter = edges.groupBy("part", "filter").agg(F.map_from_entries(F.collect_list(F.struct("state", F.struct("survivors", "removed", "good_lost", "toxic_lost")))).alias("at"), shares.alias("shapley"))
    parts = of_filter.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("filter", F.struct("at", "shapley")))).alias("filters"))
    orders = " ".join("".join(x) for x in permutations(names))
    rows = parts.select("part", "filters", F.explode(F.split(F.lit(orders), " ")).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    rows = rows.select("*", F.substring("filter_order", F.col("step"), F.lit(1)).alias("filter"))
    before = sum((F.when(F.instr("filter_order", F.lit(x)) < F.col("step"), bit(x)).otherwise(0) for x in names), F.lit(0))
    others = F.lit((1 << n) - 1) - sum((F.when(F.col("filter") == x, bit(x)).otherwise(0) for x in names), F.lit(0))
    rows = rows.select("part", "filter_order", "step", F.col("filters")[F.col("filter")].alias("own"), before.alias("state"), others.alias("others"))
    here = lambda field, state="state": F.coalesce(F.col("own.at")[F.col(state)][field], F.lit(0).cast("long"))
    everything = F.coalesce(F.col("own.at")[F.lit(0)]["removed"], F.lit(0).cast("long"))
    return rows.select(
        "part", "filter_order", "step", (here("survivors") - here("removed")).alias("kept"), here("removed").alias("removed"), (everything - here("removed")).alias("redundant"),
        here("removed", "others").alias("unique_fails"), here("good_lost").alias("good_lost"), here("toxic_lost").alias("toxic_lost"), F.col("own.shapley").alias("shapley"),
    )


FILTERS = "ABCDE"


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """What each filter removes at each step of each order, in each part."""
    return report(trie(verdicts(docs, labels, part), FILTERS), FILTERS)


def op11_filter_trie_audit(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_LETTERS = "SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit"

SQL = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
v AS (SELECT w.*, len(words) < 50 AS a, 100 * list_unique(words) < 65 * len(words) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false) AS e FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
    FROM v LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS ({_LETTERS}),
o AS (SELECT f1.f || f2.f || f3.f || f4.f || f5.f AS filter_order, unnest([1, 2, 3, 4, 5]) AS step, unnest([f1.bit, f2.bit, f3.bit, f4.bit, f5.bit]) AS bit,
    unnest([0, f1.bit, f1.bit + f2.bit, f1.bit + f2.bit + f3.bit, 31 - f5.bit]) AS state
    FROM f f1, f f2, f f3, f f4, f f5 WHERE f1.bit + f2.bit + f3.bit + f4.bit + f5.bit = 31 AND len(list_distinct([f1.f, f2.f, f3.f, f4.f, f5.f])) = 5),
r AS (SELECT part, filter_order, step, bit,
    sum(n) FILTER (WHERE mask & (state | bit) = 0) AS kept, sum(n) FILTER (WHERE mask & state = 0 AND mask & bit > 0) AS removed,
    sum(n) FILTER (WHERE mask & state > 0 AND mask & bit > 0) AS redundant, sum(n) FILTER (WHERE mask = bit) AS unique_fails,
    sum(good) FILTER (WHERE mask & state = 0 AND mask & bit > 0) AS good_lost, sum(toxic) FILTER (WHERE mask & state = 0 AND mask & bit > 0) AS toxic_lost
    FROM m, o GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
    coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
    (sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""
