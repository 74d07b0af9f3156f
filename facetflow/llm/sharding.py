"""Two-pass external shuffle into shards.

Pass one scatters records over memory-sized buckets by a seeded hash of the id and the text; pass two shuffles each bucket by
Fisher-Yates and writes it. The buckets one after another are one random order of all records, of which each shard is
an equal slice (law ``rows``).

Defined cases: an empty table gives no rows; a null text has no bytes; rows with one doc_id are dealt by their texts, a null
doc_id is an id like others; rows that repeat whole are dealt to one bucket, which is shuffled in pieces; a very long text
is in memory alone. The record travels whole in a struct, so that its column names clash with nothing; columns may be of any type,
but ties of rows that agree in all columns but maps are broken in no fixed order.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from facetflow.llm.common import map_arrow, scratch, text_bytes, write_table

SHARDS = 24
SEED = 20_240_611
BUCKET_BYTES = 16 << 20
#: At most so many tasks, each with a run of buckets; and buckets whose counts are added up to one number for the driver.
TASKS, RUN = 65_536, 4096


def _first_places(counts: DataFrame) -> tuple[DataFrame, int]:
    """(bucket, first): how many records the buckets before hold; and the number of all.

    The driver gets a number per ``RUN`` buckets, 64 GB of text; a task adds up one run.
    """
    runs = counts.groupBy(F.floor(F.col("bucket") / RUN).alias("run")).agg(F.sum("count").alias("count")).orderBy("run").collect()
    ends = np.cumsum([r["count"] for r in runs]).tolist()
    before = counts.sparkSession.createDataFrame([(r["run"], end - r["count"]) for r, end in zip(runs, ends, strict=True)], "run long, before long")
    inner = F.sum("count").over(W.partitionBy("run").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    placed = counts.withColumn("run", F.floor(F.col("bucket") / RUN)).withColumn("inner", F.coalesce(inner, F.lit(0)))
    return placed.join(F.broadcast(before), "run").select("bucket", (F.col("before") + F.col("inner")).alias("first")), ends[-1] if ends else 0


def shuffle_into_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(record struct, shard int, slot long): a uniform order, cut into ``shards`` slices whose counts are at most one apart.

    A bucket's first place comes to its task as a row before its records. A task holds at most ``bucket_bytes`` (or one
    record) at a time: a larger bucket, as of one row that repeats without end, is shuffled in pieces, which its seeded
    sort has dealt already.
    """
    buckets = max(1, -(-text_bytes(docs) // bucket_bytes))
    tasks = min(buckets, TASKS)
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), F.lit(buckets)).cast("long")
    counts, _ = write_table(docs.groupBy(bucket.alias("bucket")).count())
    places, total = _first_places(counts)

    def shuffled(batches):
        held, nbytes, at, done, first = [], 0, None, 0, 0

        def flush():
            nonlocal held, nbytes, done
            table = pa.Table.from_batches(held).combine_chunks()
            order = np.random.Generator(np.random.PCG64([seed, at, done])).permutation(len(table))  # Fisher-Yates
            # the record placed at i is order[i]
            position = first + done + np.arange(len(table), dtype=np.int64)
            # products beyond 64 bits are not met below 2**63 / shards records
            shard = position * shards // total
            slot = position - -(-shard * total // shards)
            done += len(table)
            held, nbytes = [], 0
            for low in range(0, len(table), 2048):
                part = pa.array(order[low : low + 2048])
                record = table.column("record").combine_chunks().take(part)
                yield pa.RecordBatch.from_arrays([record, pa.array(shard[low : low + 2048], pa.int32()), pa.array(slot[low : low + 2048], pa.int64())], names=["record", "shard", "slot"])

        for batch in batches:
            of = batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if high == low:
                    continue
                if held and (of[low] != at or nbytes >= bucket_bytes):
                    yield from flush()
                if of[low] != at:
                    at, done, first = int(of[low]), 0, batch.column("first")[low].as_py()
                    low += 1  # the row that says so
                if high > low:
                    held.append(batch.slice(low, high - low))
                    nbytes += held[-1].get_total_buffer_size() if high - low == len(of) else held[-1].nbytes
        if held:
            yield from flush()

    rows = docs.select(F.struct("*").alias("record"), bucket.alias("bucket"), F.lit(None).cast("long").alias("first"), F.xxhash64(F.lit(seed + 1), "doc_id").alias("by"))
    kind = rows.schema["record"].dataType
    hashed = [F.col("record")[f.name] for f in kind if "map<" not in f.dataType.simpleString()]  # Spark hashes no maps
    heads = places.select(F.lit(None).cast(kind).alias("record"), "bucket", "first", F.lit(None).cast("long").alias("by"))
    scattered = heads.union(rows).withColumn("task", F.floor(F.col("bucket") * tasks / buckets).cast("int")).repartitionById(tasks, "task")
    scattered = scattered.sortWithinPartitions("bucket", F.col("first").isNull(), "by", F.xxhash64(*hashed)).select("record", "bucket", "first")
    return scattered.transform(map_arrow, shuffled, f"record {kind.simpleString()}, shard int, slot long")


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Writes each shard into a folder of its own: (record struct, slot), slots in order within each file."""
    shuffled.select("record", "slot", "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def read_shards(docs: DataFrame, path: str) -> DataFrame:
    """What ``write_shards`` wrote of ``docs``: (record struct, slot long, shard int)."""
    kind = StructType([StructField("record", docs.schema), StructField("slot", LongType()), StructField("shard", IntegerType())])
    return docs.sparkSession.read.schema(kind).parquet(path)


def op9_external_shuffle(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = f"{scratch(spark)}/{uuid.uuid4().hex}.shards"
    write_shards(shuffle_into_shards(docs), path)
    text = F.col("record.text")
    return read_shards(docs, path).select(
        "record.doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.encode(F.coalesce(text, F.lit("")), "utf-8")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
