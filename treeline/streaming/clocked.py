"""Structured Streaming over log events, and incremental loading of files as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stored import FileStore


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours", ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """Tumbling windows by kind: ``start, kind, n, total``; events later than ``late`` are dropped."""
    w = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), F.col(kind).alias("kind"))
    return w.agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("total")).select(F.col("w.start").alias("start"), "kind", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", ts: str = "ts", key: str = "user_id") -> DataFrame:
    """Session windows by key: ``key, start, end, n``."""
    w = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), F.col(key).alias("key"))
    return w.agg(F.count("*").alias("n")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_available(spark: SparkSession, stream: DataFrame, folder: str) -> DataFrame:
    """Process what is there now and return the result as a table. State and output are in
    ``folder``, so that a run that breaks off is taken up where it was. Windows the watermark
    hasn't closed are written by a later run."""
    out = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def follow_files(spark: SparkSession, pattern: str, load, folder: str):
    """New outline files as they come: each batch of ``path, content, mod_time, hash`` goes to ``load(batch,
    batch_id)``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).load(pattern)
    rows = files.select("path", F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("mod_time"), F.md5("content").alias("hash"))
    return rows.writeStream.foreachBatch(load).option("checkpointLocation", folder).trigger(availableNow=True).start()


def sync_files(stream: DataFrame, store: FileStore, name: str, checkpoint: str):
    """A query that takes a stream of ``path, content, mod_time, hash`` into a store, batch by batch. A batch that is
    delivered again, after a failure between the store and the checkpoint, changes nothing: the store's ledger has it under
    ``name``."""
    take = lambda batch, n: store.update(batch, (name, n)) and None
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
