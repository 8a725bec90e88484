"""Micro-batches that bring a table up to date: findings, edges and their shifts.

Findings are a table in versions (versions.py). Edges write version <batch id + 1> from the
version before it, so a batch that is run again after a failure writes the same files again.
"""

from __future__ import annotations

import math
from datetime import timedelta

from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as V
from ..functions.times import as_timestamp, seconds
from ..operators import findings as N, graph as G
from ..operators.flows import observe_flows
from ..operators.findings import split_verdicts
from ..plans.threat_view import sweep
from ..schema import FINDING
from ..sources.topology import Topology
from .versions import VersionedTable

BUCKET_SECONDS = V.EVALUATION_SECONDS


def _version(path: str, n: int) -> str:
    return f"{path.rstrip('/')}/v={n}"


def _run_id(spark) -> str:
    """The id of the running stream, which its checkpoint keeps over restarts."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"


def findings_table(spark, path: str) -> VersionedTable:
    return VersionedTable(spark, path, FINDING)


def findings_sweeper(log_path: str, findings_path: str, topology: Topology | None = None, owners: DataFrame | None = None,
                     rdns: DataFrame | None = None, verdicts_path: str | None = None, run: str | None = None,
                     window_s: int = 3600, presence_window_s: int = 3600):
    """A foreachBatch function: after each batch of stored rows, verdicts and then one sweep over the log.

    The clock is the newest row so far. A sweep looks back over its window, and further if the sweep before it is longer
    ago, so that no row between two sweeps is left out; a batch without newer rows was swept before and makes no
    version. Verdicts (fingerprint, verdict, rationale, reviewer, severity, recommended_action, at) under verdicts_path
    are applied once, the last of each finding, if they came after the last one that was applied. What a version
    stands for is in the table itself, so a stream started anew with another checkpoint goes on from it.
    """
    def sweep_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        table, me = findings_table(spark, findings_path), run or _run_id(spark)
        newest = batch.agg(F.max("timestamp")).first()[0]
        last = table.latest()
        if newest is None or (last["clock"] is not None and newest <= last["clock"]) or table.made_by(me, batch_id):
            return
        start = lambda window: min(x for x in (newest - timedelta(seconds=window), last["clock"]) if x is not None)
        now, found, until = newest.isoformat(" "), table.read(last["n"]), last["judged_until"]
        if verdicts_path is not None:
            given = spark.read.parquet(verdicts_path)
            fresh = given.where(F.col("at") > F.lit(until)) if until is not None else given
            until = fresh.agg(F.max("at")).first()[0] or until
            judged = split_verdicts(fresh)[0].groupBy("fingerprint").agg(F.max_by(F.struct(*[c for c in given.columns if c != "fingerprint"]), "at").alias("v"))
            found = N.apply_verdicts(found, judged.select("fingerprint", "v.*"), now)
        log = spark.read.parquet(log_path).filter(F.col("timestamp") <= F.lit(newest))
        back = lambda window: math.ceil((newest - start(window)).total_seconds())
        swept = sweep(log, found, now, topology, owners, rdns, window_s=back(window_s), presence_window_s=back(presence_window_s))
        table.commit(swept, last, me, batch_id, newest, start(window_s), until)
    return sweep_batch


def edge_buckets(flows: DataFrame) -> DataFrame:
    """Flows counted per edge and evaluation interval."""
    start = F.timestamp_seconds(F.floor(F.unix_seconds("timestamp") / BUCKET_SECONDS) * BUCKET_SECONDS)
    return flows.groupBy("source", "target", "protocol", "channel", "port", start.alias("bucket")).agg(
        F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"))


def shift_watcher(state_path: str, shifts_path: str, topology: Topology, **limits):
    """A foreachBatch function: edges kept as counts per interval, judged after each batch.

    Intervals older than the window are folded into one per edge, so the state
    grows with the edges and not with the traffic.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = batch.agg(F.max("timestamp").cast("string")).first()[0]
        fresh = edge_buckets(observe_flows(batch, topology))
        if batch_id > 0:
            fresh = spark.read.parquet(_version(state_path, batch_id)).unionByName(fresh)
        cut = as_timestamp(now) - seconds(V.WINDOW_SECONDS) if now else F.lit(None).cast("timestamp")
        old = F.timestamp_seconds(F.lit(0))
        folded = fresh.withColumn("bucket", F.when(F.col("bucket") < cut, old).otherwise(F.col("bucket")))
        state = folded.groupBy("source", "target", "protocol", "channel", "port", "bucket").agg(
            F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"))
        state.write.mode("overwrite").parquet(_version(state_path, batch_id + 1))
        if now is None:
            return
        kept = spark.read.parquet(_version(state_path, batch_id + 1))
        judged = G.topology_shifts(_edges(kept, topology, now), now, **limits)
        (judged.withColumn("as_of", as_timestamp(now)).write.mode("overwrite")
         .parquet(_version(shifts_path, batch_id + 1)))
    return run


def _edges(state: DataFrame, topology: Topology, now: str) -> DataFrame:
    """Edge table out of the kept counts; the last minute is the last four intervals."""
    at = lambda s: F.col("bucket") > as_timestamp(now) - seconds(s)
    total = lambda c, s: F.coalesce(F.sum(F.when(at(s), F.col(c))), F.lit(0))
    rates = state.groupBy("source", "target", "protocol").agg(
        F.sum("n").alias("total_volume"), F.sum("bytes").alias("total_bytes"), F.max("last_seen").alias("last_seen"),
        F.min("first_seen").alias("first_seen"), total("n", 60).alias("rate_1m"),
        F.round(total("n", V.WINDOW_SECONDS) / 15.0, 2).alias("baseline_15m"))
    both = G.declared_edges(topology).join(rates, ["source", "target", "protocol"], "full_outer")
    zero = lambda c, t: F.coalesce(c, F.lit(0).cast(t)).alias(c)
    return both.select(
        G.edge_id(F.col("source"), F.col("target"), F.col("protocol")).alias("edge_id"), "source", "target", "protocol",
        F.coalesce("is_declared", F.lit(False)).alias("is_declared"), zero("expected_min_rate", "double"),
        zero("total_volume", "long"), zero("rate_1m", "long"), zero("baseline_15m", "double"), "last_seen")
