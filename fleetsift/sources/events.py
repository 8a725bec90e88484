"""The stored log table: writing, accounting, retention."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.times import as_timestamp, retention_window, seconds
from ..session import scratch_path

NO_FIELDS = "cast(map() as map<string,string>)"


def stored_rows(df: DataFrame, ingested_at=None) -> DataFrame:
    """Rows as stored: the event's own time or the ingest time, no null maps.

    instance and source are promoted to columns and event_date derived, so scans
    can skip files and partitions on them.
    """
    now = as_timestamp(ingested_at) if ingested_at is not None else F.current_timestamp()
    own = F.col("ts") if "ts" in df.columns else F.col("timestamp")
    rows = df.withColumn("timestamp", F.coalesce(own, now))
    for name in ("labels", "kv"):
        rows = rows.withColumn(name, F.coalesce(name, F.expr(NO_FIELDS)))
    return (rows.withColumn("instance", F.try_element_at("labels", F.lit("instance")))
            .withColumn("source", F.try_element_at("labels", F.lit("source")))
            .withColumn("event_date", F.to_date("timestamp")))


def write_events(df: DataFrame, path: str, ingested_at=None, mode: str = "append") -> None:
    """Append to the table at path, one folder per day, rows in a file by event and time.

    Rows are rebalanced by day first: small days come from one task each, and a day
    that holds most rows is split over many.
    """
    (stored_rows(df, ingested_at).hint("rebalance", "event_date").sortWithinPartitions("event_date", "event", "timestamp")
     .write.mode(mode).partitionBy("event_date").parquet(path))


def ingest_accounting(df: DataFrame) -> DataFrame:
    """Counts of rows with a `status` (matched, unstructured, structured, filtered,
    rejected) and an optional `suspect` time; hit rate in percent of the total."""
    of = lambda s: F.count_if(F.col("status") == s)
    total = F.count_if(F.col("status").isin("matched", "unstructured", "structured"))
    clamped = F.count("suspect") if "suspect" in df.columns else F.lit(0).cast("long")
    counts = df.agg(total.alias("total"), of("matched").alias("matched"),
                    of("unstructured").alias("unstructured"), of("structured").alias("structured"),
                    of("filtered").alias("filtered"), of("rejected").alias("rejected"),
                    clamped.alias("ts_clamped"))
    return counts.withColumn("hit_rate", F.when(F.col("total") > 0, F.col("matched") / F.col("total") * 100)
                             .otherwise(0.0))


def within_retention(df: DataFrame, as_of, spec: str | None = None, column: str = "timestamp") -> DataFrame:
    """Rows inside the window; everything when retention is off. A bad spec raises."""
    window = retention_window(spec)
    return df if window is None else df.filter(F.col(column) >= as_timestamp(as_of) - seconds(window))


def retention_report(df: DataFrame, as_of, spec: str | None = None) -> DataFrame:
    """Per day: rows kept and rows to delete."""
    window = retention_window(spec)
    keep = F.lit(True) if window is None else F.col("timestamp") >= as_timestamp(as_of) - seconds(window)
    return (df.groupBy(F.to_date("timestamp").alias("event_date"))
            .agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("deleted")))


def apply_retention(spark: SparkSession, path: str, as_of, spec: str | None = None) -> int:
    """Delete rows of the table at path older than the window; returns how many.

    Only the day the boundary falls in is rewritten, through a copy in the shared
    folder and by replacing its folder; days wholly outside go as folders after
    that. Run again after a failure, it finishes what is left.
    """
    window = retention_window(spec)
    if window is None:
        return 0
    cut = as_timestamp(as_of) - seconds(window)
    bounds = spark.range(1).select(cut.alias("cut"), cut.cast("date").cast("string").alias("day")).first()
    table = spark.read.parquet(path)
    old = table.filter(F.col("timestamp") < F.lit(bounds.cut)).filter(F.col("event_date") <= F.lit(bounds.day))
    deleted = old.count()
    if not deleted:
        return 0
    boundary = table.filter(F.col("event_date") == F.lit(bounds.day))
    copy = scratch_path(spark, "retention")
    boundary.filter(F.col("timestamp") >= F.lit(bounds.cut)).write.parquet(copy)
    kept = spark.read.schema(boundary.schema).parquet(copy)
    gone = bounds.day
    if kept.limit(1).count():
        (kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("event_date").parquet(path))
        gone = (date.fromisoformat(bounds.day) - timedelta(days=1)).isoformat()
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("event_date=") and name.split("=", 1)[1] <= gone:
            fs.delete(status.getPath(), True)
    return deleted
