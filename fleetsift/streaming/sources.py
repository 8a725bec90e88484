"""Streams of lines and stored rows, resumed from a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.times import as_timestamp, clamp_ts, ns_to_ts
from ..schema import EVENT

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, path: str, schema, glob: str | None = None,
                files_per_trigger: int | None = None, fmt: str = "parquet") -> DataFrame:
    """Files under path as they arrive; the checkpoint remembers which were read."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.format(fmt).load(path)


def event_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """Stored log rows as a stream."""
    return file_stream(spark, path, EVENT, **options)


def kafka_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Lines of a topic as (value, timestamp); needs the Kafka connector on the classpath."""
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
           .option("subscribe", topic).load())
    return raw.select(F.col("value").cast("string").alias("value"), "timestamp")


def timed(stream: DataFrame, column: str = "timestamp", as_of=None, delay: str = "10 minutes") -> DataFrame:
    """Stream with its event time clamped, then watermarked.

    The clamp comes first: one clock in the future would otherwise carry the
    watermark along and make every honest row late. A clamped row is kept with
    the time of its arrival, and `suspect` holds what it claimed.
    """
    now = as_timestamp(as_of) if as_of is not None else F.current_timestamp()
    clamped = clamp_ts(F.col(column).cast("timestamp"), now)
    return (stream.withColumn("_t", clamped)
            .withColumn(column, F.coalesce("_t.ts", now)).withColumn("suspect", F.col("_t.suspect"))
            .drop("_t").withWatermark(column, delay))


def dedup_entries(entries: DataFrame, as_of=None, overlap: str = "30 seconds") -> DataFrame:
    """Log-stream entries (labels, ts_ns, line) of overlapping reads, each once.

    The same line at another time is another entry. An entry is remembered while
    the watermark, `overlap` behind, has not passed it.
    """
    keyed = (entries.withColumn("timestamp", ns_to_ts(F.col("ts_ns")))
             .withColumn("line_hash", F.sha2("line", 256)))
    return timed(keyed, as_of=as_of, delay=overlap).dropDuplicatesWithinWatermark(["ts_ns", "line_hash"])


def finish(query) -> None:
    """Wait for a query started with availableNow."""
    query.awaitTermination()
