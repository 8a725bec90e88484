"""Which detections are sent: cooldowns per key, failed units, critical lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as V
from ..functions.lines import is_critical, parse_logfmt
from ..functions.times import as_timestamp


def failed_units(events: DataFrame) -> DataFrame:
    """(id, timestamp, instance, unit, key) of reports of a failed unit."""
    reported = events.filter(F.col("raw").contains("unitwatch ") & F.col("raw").contains("active=failed"))
    fields = reported.withColumn("fields", parse_logfmt(F.col("raw")))
    get = lambda k: F.try_element_at("fields", F.lit(k))
    instance = F.coalesce(F.nullif(get("instance"), F.lit("")),
                          F.nullif(F.try_element_at("labels", F.lit("instance")), F.lit("")), F.lit("unknown"))
    return (fields.filter(get("unit") != "").select("id", "timestamp", instance.alias("instance"),
                                                    get("unit").alias("unit"))
            .withColumn("key", F.concat_ws("|", "instance", "unit")))


def critical_lines(events: DataFrame) -> DataFrame:
    """Kernel and hardware alarms; these are sent every time."""
    return events.filter(is_critical(F.col("raw"))).select(
        "id", "timestamp", F.coalesce(F.try_element_at("labels", F.lit("instance")),
                                      F.lit("unknown")).alias("instance"), "event", "raw")


def _greedy(cooldown_s: int):
    def pick(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        seconds = np.sort(pdf["second"].to_numpy())
        chosen, at = [], 0
        while at < len(seconds):
            chosen.append(seconds[at])
            at = int(np.searchsorted(seconds, seconds[at] + cooldown_s, side="left"))
        return pd.DataFrame({"key": key[0], "second": chosen})
    return pick


def with_cooldown(candidates: DataFrame, cooldown_s: int = V.ALERT_COOLDOWN_SECONDS) -> DataFrame:
    """(key, second) of the candidates (key, timestamp) that are sent.

    The first of a key is sent, then the next one at least cooldown_s later.
    Candidates collapse to one per key and second before they meet, so a group is
    bounded by the seconds it spans, however many rows the key has.
    """
    seconds = candidates.select("key", F.unix_seconds("timestamp").alias("second")).distinct()
    return (seconds.groupBy("key").applyInPandas(_greedy(cooldown_s), "key string, second long"))


def anomaly_alerts(ticks: DataFrame, started, warmup_s: int = V.WARMUP_SECONDS,
                   cooldown_s: int = V.ALERT_COOLDOWN_SECONDS) -> DataFrame:
    """Alarming ticks that are sent: only once armed, and once per cooldown and key."""
    armed = F.unix_seconds("tick") >= F.unix_seconds(as_timestamp(started)) + warmup_s
    ready = ticks.filter(F.col("active") & armed).select(
        F.concat_ws(":", "instance", "event").alias("key"), F.col("tick").alias("timestamp"))
    return with_cooldown(ready, cooldown_s)
