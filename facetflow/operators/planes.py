"""Centroids, best-fit planes and deviations of groups of points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetflow.functions.vec import V3


def moments(points: DataFrame, key: str) -> DataFrame:
    """Count, centroid and central second moments of ``points(key, x, y, z)``: what a plane fit needs, by one aggregate."""
    rows = points.groupBy(key).agg(
        F.count("*").alias("n"), *[F.avg(n).alias(f"c{n}") for n in "xyz"],
        *[(F.covar_pop(a, b) * F.count("*")).alias(f"m{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")],
    )
    return rows


_FIT = T.StructType([T.StructField(n, T.DoubleType()) for n in ("nx", "ny", "nz", "smallest")])


@F.pandas_udf(_FIT)
def _normal(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
    m = np.empty((len(xx), 3, 3))
    for (i, j), s in zip(((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)), (xx, xy, xz, yy, yz, zz), strict=True):
        m[:, i, j] = m[:, j, i] = s
    values, vectors = np.linalg.eigh(np.nan_to_num(m))
    normal = vectors[:, :, 0]
    lead = np.take_along_axis(normal, np.abs(normal).argmax(1)[:, None], 1)
    normal = normal * np.where(lead < 0, -1, 1)
    return pd.DataFrame({"nx": normal[:, 0], "ny": normal[:, 1], "nz": normal[:, 2], "smallest": np.maximum(values[:, 0], 0)})


def best_fit_planes(points: DataFrame, key: str) -> DataFrame:
    """(key, n, cx, cy, cz, nx, ny, nz, rms_error, rms): the normal's largest component is positive.

    ``rms_error`` is the root of the sum of squared distances, ``rms`` that of their mean.
    """
    rows = moments(points, key).withColumn("fit", _normal(*[F.col(f"m{ab}") for ab in ("xx", "xy", "xz", "yy", "yz", "zz")]))
    return rows.select(key, "n", "cx", "cy", "cz", "fit.nx", "fit.ny", "fit.nz", F.sqrt("fit.smallest").alias("rms_error"), F.sqrt(F.col("fit.smallest") / F.col("n")).alias("rms"))


def deviations(points: DataFrame, planes: DataFrame, key: str) -> DataFrame:
    """Points with their signed distance to their group's plane, and where they lie on it (px, py, pz)."""
    d = (V3.of() - V3.of("c")).dot(V3.of("n"))
    on = V3.of() - V3.of("n") * F.col("deviation")
    return points.join(planes.select(key, *[f"{p}{n}" for p in "cn" for n in "xyz"]), key).withColumn("deviation", d).select(*points.columns, "deviation", *on.columns("p"))


def deviation_stats(rows: DataFrame, key: str, column: str = "deviation") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(column).alias("total"), F.min(column).alias("low"), F.max(column).alias("high"), F.stddev_pop(column).alias("stddev"))


def polyline_length(points: DataFrame, key: str, position: str, closed: bool = True) -> DataFrame:
    """(key, n, length) of ordered points."""
    w = W.partitionBy(key).orderBy(position)
    nxt = V3(*(F.lead(n).over(w) for n in "xyz"))
    if closed:
        first = V3(*(F.first(n).over(w.rowsBetween(W.unboundedPreceding, 0)) for n in "xyz"))
        nxt = V3(*(F.coalesce(a, b) for a, b in zip(nxt.parts(), first.parts(), strict=True)))
    return points.withColumn("step", (nxt - V3.of()).length()).groupBy(key).agg(F.count("*").alias("n"), F.sum("step").alias("length"))
