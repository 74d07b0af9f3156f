"""Scratch tables: where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, GroupedData, SparkSession


def scratch(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a folder of our own only where the session names none."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="scratch-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def write_table(df: DataFrame, **options: str) -> tuple[DataFrame, str]:
    """Cuts lineage: writes ``df`` as Parquet into the scratch folder; returns it as read again, and its path.

    The files survive lost executors, unlike blocks that executors keep.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}.parquet"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def dealt_groups(rows: DataFrame, key: list[str]) -> GroupedData:
    """Groups of ``rows`` over as many tasks as the session shuffles to: their work is far more than their bytes, by which adaptive execution would put many in one."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key).groupBy(*key)


def drop_table(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
