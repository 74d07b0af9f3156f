"""Statistics of meshes as their files arrive in a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from facetflow.operators import stats
from facetflow.sources.derived import MeshFrame
from facetflow.sources.off import _ROWS, _rows


def watch(spark: SparkSession, folder: str, sink: Callable[[DataFrame, int], None], checkpoint: str, dedup: bool = False) -> StreamingQuery:
    """Calls ``sink`` with the geometric statistics of each micro-batch of new files; bad files are left out.

    Each file is its own group, so nothing is kept between batches; the checkpoint remembers which files were seen.
    """
    import pandas as pd

    names = [x.split()[0] for x in _ROWS.split(", ")]

    def parsed(parts):
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                got = list(_rows(path, content.decode("utf-8", "replace"), dedup, True))
                yield pd.DataFrame(got, columns=names).astype({n: "Int64" for n in ("id", "a", "b", "c")})

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.mapInPandas(parsed, _ROWS)
        vertices = rows.where("kind = 'vertex'").select("mesh_id", F.col("id").alias("vid"), "x", "y", "z")
        triangles = rows.where("kind = 'triangle'").select("mesh_id", F.col("id").alias("tid"), "a", "b", "c")
        sink(stats.geometric_statistics(MeshFrame(vertices, triangles)), number)

    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).load(folder).select("path", "content")
    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and sum of events per window and type; late ones are waited for as long as the watermark says."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
