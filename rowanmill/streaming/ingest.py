"""Streams into the same tables: new records arrive as files, each batch is resolved against what is stored.

An addition to the batch jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.resolve import upsert
from ..sources.tables import Table, changed


def read_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def upsert_stream(spark: SparkSession, stream: DataFrame, seed: DataFrame, table: Table, checkpoint: str) -> StreamingQuery:
    """Run all files that are there and stop; each batch is one version of ``table``, which rewrites the buckets of its records only.

    A new table starts with ``seed``.  The number of the batch is kept with the version, so a batch that is run again changes nothing.
    """
    if not table.number:
        table.replace(seed)

    def merge(batch: DataFrame, n: int) -> None:
        if table.notes.get("batch", -1) < n:
            stored = table.read()
            done = upsert(stored, batch.select(*stored.columns)).select(*stored.columns)
            table.merge(changed(stored, done), {"batch": n})

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and tumbling window; for a stream rows later than the watermark are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    marked = timed.withWatermark("ts", late) if events.isStreaming else timed
    counts = marked.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
