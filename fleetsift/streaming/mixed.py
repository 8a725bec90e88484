"""Every kind of input into one table, batch or stream, rows and rejects in one write.

Each micro-batch is one transaction, named by its stream and number. Its rows and its rejects are written by
one job into folders of that name, so a batch that is run again replaces what it wrote before, and neither sink
can be ahead of the other. Counts are observed while the rows pass and kept with the transaction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..operators.templates import Rule
from ..plans.ingest import ingest_feed
from ..sources.events import stored_rows
from .upkeep import _run_id

STORED = ["id", "timestamp", "event", "labels", "kv", "kv_v", "latency_us", "raw", "instance", "source"]
OUTCOMES = ("matched", "unstructured", "structured", "filtered", "rejected")


def write_outcomes(feed: DataFrame, rules: list[Rule], path: str, txn: str, as_of=None, kind: str | None = None) -> dict:
    """One transaction: stored rows to <path>/sink=rows, refused ones to <path>/sink=rejects; returns the counts by outcome."""
    now = F.current_timestamp() if as_of is None else as_of
    feed, seen = feed.persist(), Observation()
    ingested = ingest_feed(feed, rules, now, kind).observe(
        seen, *[F.count_if(F.col("status") == s).alias(s) for s in OUTCOMES], F.count("suspect").alias("ts_clamped"))
    sink = F.when(F.col("status") == "rejected", "rejects").when(F.col("status") != "filtered", "rows")
    rows = stored_rows(ingested, as_of).withColumn("sink", sink).withColumn("txn", F.lit(txn))
    # Refused rows carry no log fields, stored ones no body.
    out = rows.where("sink IS NOT NULL").select(*STORED, "kind", "reason", "body", "sink", "txn", "event_date")
    (out.sortWithinPartitions("sink", "event_date", "event", "timestamp").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("sink", "txn", "event_date").parquet(path))
    counts = seen.get
    feed.unpersist()
    feed.sparkSession.createDataFrame([(txn, *[int(counts[s]) for s in (*OUTCOMES, "ts_clamped")])],
                                      "txn string, " + ", ".join(f"{s} long" for s in (*OUTCOMES, "ts_clamped"))
                                      ).coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}-accounts/of={txn}")
    return counts


def mixed_writer(rules: list[Rule], path: str, name: str, as_of=None, run: str | None = None, kind: str | None = None):
    """A foreachBatch function for the feed called name; kind, if the feed has one only, saves the steps of the others."""
    def write(feed: DataFrame, batch_id: int) -> None:
        write_outcomes(feed, rules, path, f"{name}-{run or _run_id(feed.sparkSession)}-{batch_id}", as_of, kind)
    return write


def stored_log(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows of all transactions. A log-stream entry that came in several transactions is one row."""
    rows = spark.read.parquet(path).where("sink = 'rows'").drop("sink", "txn", "reason", "body")
    again = rows.where("kind = 'streams'").dropDuplicates(["id", "timestamp"])
    return rows.where("kind <> 'streams'").unionByName(again).drop("kind")


def rejects(spark: SparkSession, path: str) -> DataFrame:
    """(id, kind, reason, body) of what was refused."""
    return spark.read.parquet(path).where("sink = 'rejects'").select("id", "kind", "reason", "body")


def accounts(spark: SparkSession, path: str) -> DataFrame:
    """Counts of all transactions together, as ingest_accounting gives them."""
    sums = spark.read.parquet(f"{path.rstrip('/')}-accounts").agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in (*OUTCOMES, "ts_clamped")])
    total = F.col("matched") + F.col("unstructured") + F.col("structured")
    return sums.withColumn("total", total).withColumn("hit_rate", F.when(total > 0, F.col("matched") / total * 100).otherwise(0.0))
