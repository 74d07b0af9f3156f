"""Sets of ids as tables: a row a member, any number of sets told apart by key columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right).distinct()


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Members of the left sets that the right ones of equal key don't have."""
    return left.distinct().join(right, left.columns, "left_anti")


def common(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.distinct().join(right, left.columns, "left_semi")


def members(rows: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose ids are in the sets."""
    return rows.join(ids, on, "left_semi")


def relations(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """(key, overlaps, contains): whether a left set and the right one of equal key have a member in common, and whether all of the right one's
    are in the left one (equal sets and an empty right set included). A row for each key of either side.

    Two aggregates with partial sums, no join: a set with most of the members is spread by member.
    """
    flags = lambda rows, a, b: rows.select("*", F.lit(a).alias("l"), F.lit(b).alias("r"))
    both = flags(left, 1, 0).unionByName(flags(right, 0, 1)).groupBy(*left.columns).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return both.groupBy(*key).agg((F.max(F.col("l") * F.col("r")) == 1).alias("overlaps"), (F.max(F.col("r") * (1 - F.col("l"))) == 0).alias("contains"))
