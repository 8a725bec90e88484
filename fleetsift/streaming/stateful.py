"""Keyed state: anomaly hysteresis, alert cooldowns, open skeleton buckets.

What reaches a key is reduced before: anomalies arrive as one row per key and
tick, alert candidates as one row per key and second.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import fixed_values as V
from ..operators.mining import skeleton

TICK = "kind string, instance string, event string, tick timestamp, n long, measure double, active boolean"
SENT = "key string, second long"
CLUSTER = "skeleton string, salt int, samples array<string>"


def tick_counts(events: DataFrame, tick: str = "1 minute") -> DataFrame:
    """(kind, instance, event, tick, n, total) of a watermarked stream, one row per key and tick."""
    instance = F.coalesce(F.try_element_at("labels", F.lit("instance")), F.lit("unknown"))
    one = lambda c: c.cast("long")
    both = F.array(
        F.struct(F.lit("rate_spike").alias("kind"), F.col("event").alias("event"), one(F.lit(1)).alias("n"),
                 one(F.lit(1)).alias("total")),
        F.struct(F.lit("unstructured_surge").alias("kind"), F.lit("unstructured_surge").alias("event"),
                 one(F.col("event") == "unstructured").alias("n"), one(F.lit(1)).alias("total")))
    rows = events.select("timestamp", instance.alias("instance"), F.explode(both).alias("k")).select(
        "timestamp", "instance", "k.*")
    return (rows.groupBy(F.window("timestamp", tick), "kind", "instance", "event")
            .agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
            .select("kind", "instance", "event", F.col("window.end").alias("tick"), "n", "total"))


class Hysteresis(StatefulProcessor):
    """Raised high, cleared low, held in between; keeps the ticks of the last window."""

    def __init__(self, limits: dict):
        self.limits = dict(raise_z=4.0, clear_z=2.0, min_count=30, min_buckets=5, min_ratio=2.5, raise_share=20.0,
                           clear_share=8.0, min_total=50, min_surge=20, window_s=V.WINDOW_SECONDS) | limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.memory = handle.getValueState("memory", "body string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kind, instance, event = key
        batch = pd.concat(list(rows)).sort_values("tick")
        saved = json.loads(self.memory.get()[0]) if self.memory.exists() else {"ticks": [], "active": False}
        out = []
        for tick, n, total in zip(batch["tick"], batch["n"], batch["total"]):
            at = int(tick.timestamp())
            if saved["ticks"] and at - saved["ticks"][-1][0] > self.limits["window_s"]:
                saved["active"] = False  # aged out
            saved["ticks"] = [t for t in saved["ticks"] if t[0] > at - self.limits["window_s"]] + [[at, int(n)]]
            measure, turn = self._judge(kind, saved["ticks"], int(n), int(total))
            saved["active"] = saved["active"] if turn is None else turn
            out.append((kind, instance, event, tick, int(n), measure, saved["active"]))
        self.memory.update((json.dumps(saved),))
        yield pd.DataFrame(out, columns=["kind", "instance", "event", "tick", "n", "measure", "active"])

    def _judge(self, kind, ticks, n, total):
        lim = self.limits
        if kind == "rate_spike":
            average = sum(t[1] for t in ticks) * (60.0 / lim["window_s"])
            z = (n - average) / max(math.sqrt(average), 1.0)
            if len(ticks) < lim["min_buckets"]:
                return z, None
            if n >= lim["min_count"] and z >= lim["raise_z"] and n >= average * lim["min_ratio"]:
                return z, True
            return z, (False if z < lim["clear_z"] else None)
        share = n / total * 100
        if total < lim["min_total"]:
            return share, None
        if share > lim["raise_share"] and n >= lim["min_surge"]:
            return share, True
        return share, (False if share < lim["clear_share"] else None)

    def close(self) -> None:
        pass


def anomaly_stream(events: DataFrame, **limits) -> DataFrame:
    """Anomaly state of every key at every tick of a watermarked stream of rows."""
    return tick_counts(events).groupBy("kind", "instance", "event").transformWithStateInPandas(
        Hysteresis(limits), outputStructType=TICK, outputMode="Append", timeMode="None")


class Cooldown(StatefulProcessor):
    """Sends the first of a key, then the next at least the cooldown later."""

    def __init__(self, cooldown_s: int):
        self.cooldown_s = cooldown_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "second long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        sent = []
        for second in sorted(set(pd.concat(list(rows))["second"])):
            if last is None or second - last >= self.cooldown_s:
                last = int(second)
                sent.append((key[0], last))
        if last is not None:
            self.last.update((last,))
        yield pd.DataFrame(sent, columns=["key", "second"])

    def close(self) -> None:
        pass


def cooldown_stream(candidates: DataFrame, cooldown_s: int = V.ALERT_COOLDOWN_SECONDS) -> DataFrame:
    """Alerts (key, second) of a watermarked stream of candidates (key, timestamp)."""
    seconds = candidates.withColumn("second", F.unix_seconds("timestamp")).dropDuplicatesWithinWatermark(["key", "second"])
    return seconds.select("key", "second").groupBy("key").transformWithStateInPandas(
        Cooldown(cooldown_s), outputStructType=SENT, outputMode="Append", timeMode="None")


class Buckets(StatefulProcessor):
    """Open skeleton buckets: emitted and emptied at the threshold, forgotten when idle."""

    def __init__(self, threshold: int, ttl_ms: int | None):
        self.threshold, self.ttl_ms = threshold, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lines = handle.getValueState("lines", "body string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = json.loads(self.lines.get()[0]) if self.lines.exists() else []
        full = []
        for batch in rows:
            for line in batch.sort_values(["timestamp", "id"])["raw"]:
                held.append(line)
                if len(held) == self.threshold:
                    full.append((key[0], int(key[1]), held))
                    held = []
        self.lines.update((json.dumps(held),))
        yield pd.DataFrame(full, columns=["skeleton", "salt", "samples"])

    def close(self) -> None:
        pass


def skeleton_stream(lines: DataFrame, threshold: int = V.CLUSTER_THRESHOLD, salts: int = 1,
                    ttl_ms: int | None = None) -> DataFrame:
    """Full clusters (skeleton, salt, samples) of a stream of unmatched lines (id, timestamp, raw).

    One skeleton may be most of a stream: with salts above one its lines fill that
    many buckets side by side, on as many tasks. Rules made from any of them are
    the same rule, and the rules table keeps one per pattern.
    """
    salt = F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")
    keyed = lines.select("id", "timestamp", "raw", skeleton(F.col("raw")).alias("skeleton"), salt.alias("salt"))
    return keyed.groupBy("skeleton", "salt").transformWithStateInPandas(
        Buckets(threshold, ttl_ms), outputStructType=CLUSTER, outputMode="Append",
        timeMode="None" if ttl_ms is None else "ProcessingTime")
