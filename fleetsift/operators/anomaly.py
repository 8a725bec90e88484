"""Rate spikes and surges of lines nobody has a rule for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as V
from ..functions.times import as_timestamp, int_div, seconds


def _instance() -> Column:
    return F.coalesce(F.try_element_at("labels", F.lit("instance")), F.lit("unknown"))


def _window(events: DataFrame, as_of, window_s: int) -> DataFrame:
    now = as_timestamp(as_of)
    return events.filter((F.col("timestamp") >= now - seconds(window_s)) & (F.col("timestamp") <= now))


def z_score(count: Column, average: Column) -> Column:
    return (count - average) / F.greatest(F.sqrt(average), F.lit(1.0))


def rate_windows(events: DataFrame, as_of, window_s: int = V.WINDOW_SECONDS,
                 window_minutes: float = 15.0) -> DataFrame:
    """Per (instance, event): counts of the window and the last minute, and the z-score.

    Counted per minute first: a key with a third of all rows leaves each task as
    at most sixteen rows.
    """
    now = as_timestamp(as_of)
    minute = F.date_trunc("minute", "timestamp")
    counted = (_window(events, as_of, window_s)
               .groupBy(_instance().alias("instance"), "event", minute.alias("minute"))
               .agg(F.count("*").alias("n"),
                    F.count_if(F.col("timestamp") >= now - seconds(60)).alias("last")))
    per_key = counted.groupBy("instance", "event").agg(
        F.sum("n").alias("total"), F.sum("last").alias("count_1m"), F.count("*").alias("minutes"))
    average = F.col("total") / F.lit(float(window_minutes))
    return per_key.withColumn("avg_1m", average).withColumn(
        "z_score", z_score(F.col("count_1m"), F.col("avg_1m")))


def rate_spikes(events: DataFrame, as_of, min_minutes: int = 5, min_count: int = 30,
                min_z: float = 4.0, min_ratio: float = 2.5, **window) -> DataFrame:
    return rate_windows(events, as_of, **window).filter(
        (F.col("minutes") >= min_minutes) & (F.col("count_1m") >= min_count)
        & (F.col("z_score") >= min_z) & (F.col("count_1m") >= F.col("avg_1m") * min_ratio))


def rate_series(events: DataFrame) -> DataFrame:
    """The spike measure at the end of every minute that has rows, over fifteen minutes."""
    minutes = (events.groupBy(_instance().alias("instance"), "event",
                              F.date_trunc("minute", "timestamp").alias("minute"))
               .agg(F.count("*").alias("count_1m"))
               .withColumn("m", F.unix_seconds("minute")))
    back = Window.partitionBy("instance", "event").orderBy("m").rangeBetween(-14 * 60, 0)
    series = (minutes.withColumn("total", F.sum("count_1m").over(back))
              .withColumn("minutes", F.count("*").over(back))
              .withColumn("avg_1m", F.col("total") / F.lit(15.0)))
    return series.withColumn("z_score", z_score(F.col("count_1m"), F.col("avg_1m"))).drop("m")


def unstructured_rates(events: DataFrame, as_of) -> DataFrame:
    """Per instance: lines of the last minute, and the share without a rule."""
    return (_window(events, as_of, 60).groupBy(_instance().alias("instance"))
            .agg(F.count("*").alias("total_1m"),
                 F.count_if(F.col("event") == "unstructured").alias("count_1m"))
            .withColumn("ratio", F.col("count_1m") / F.col("total_1m") * 100))


def unstructured_surges(events: DataFrame, as_of, min_total: int = 50, min_ratio: float = 20.0,
                        min_count: int = 20) -> DataFrame:
    return unstructured_rates(events, as_of).filter(
        (F.col("total_1m") >= min_total) & (F.col("ratio") > min_ratio) & (F.col("count_1m") >= min_count))


def anomaly_ticks(events: DataFrame, tick_s: int = 60, window_s: int = V.WINDOW_SECONDS) -> DataFrame:
    """Both measures for every key at every tick: the input of the hysteresis fold.

    Each key's events are counted per tick, named by its end, then each tick looks
    back over the window; `kind` tells rate from surge. Quiet keys do not appear.
    """
    tick = F.timestamp_seconds((int_div(F.unix_micros("timestamp"), tick_s * 1_000_000) + 1) * tick_s)
    base = events.select(_instance().alias("instance"), "event", tick.alias("tick"))
    counts = base.groupBy("instance", "event", "tick").agg(F.count("*").alias("n"))
    at = F.unix_seconds("tick")
    long = Window.partitionBy("instance", "event").orderBy(at).rangeBetween(-window_s + tick_s, 0)
    rate = (counts.withColumn("total", F.sum("n").over(long)).withColumn("buckets", F.count("*").over(long))
            .withColumn("avg_1m", F.col("total") * (60.0 / window_s))
            .select("instance", "event", "tick", F.lit("rate_spike").alias("kind"), "n", "buckets",
                    z_score(F.col("n"), F.col("avg_1m")).alias("measure"), "avg_1m"))
    surge = (counts.groupBy("instance", "tick").agg(
        F.sum("n").alias("total"), F.sum(F.when(F.col("event") == "unstructured", F.col("n"))
                                         .otherwise(0)).alias("n"))
             .select("instance", F.lit("unstructured_surge").alias("event"), "tick",
                     F.lit("unstructured_surge").alias("kind"), "n", F.col("total").alias("buckets"),
                     (F.col("n") / F.col("total") * 100).alias("measure"), F.lit(None).cast("double").alias("avg_1m")))
    return rate.unionByName(surge)


def hysteresis(ticks: DataFrame, raise_z: float = 4.0, clear_z: float = 2.0, min_count: int = 30,
               min_buckets: int = 5, min_ratio: float = 2.5, raise_share: float = 20.0,
               clear_share: float = 8.0, min_total: int = 50, min_surge: int = 20,
               window_s: int = V.WINDOW_SECONDS) -> DataFrame:
    """Which keys are alarming at each tick: raised high, cleared low, held in between, and cleared
    as well once nothing was heard for longer than the window.

    The state after a tick is that of the last tick that either raised or cleared,
    so it is a running last value, not a loop.
    """
    spike = F.col("kind") == "rate_spike"
    judged_spike = F.col("buckets") >= min_buckets
    high = F.when(spike, judged_spike & (F.col("n") >= min_count) & (F.col("measure") >= raise_z)
                  & (F.col("n") >= F.col("avg_1m") * min_ratio)
                  ).otherwise((F.col("buckets") >= min_total) & (F.col("measure") > raise_share)
                              & (F.col("n") >= min_surge))
    low = F.when(spike, judged_spike & (F.col("measure") < clear_z)
                 ).otherwise((F.col("buckets") >= min_total) & (F.col("measure") < clear_share))
    so_far = Window.partitionBy("kind", "instance", "event").orderBy("tick").rowsBetween(
        Window.unboundedPreceding, 0)
    before = F.lag("tick").over(Window.partitionBy("kind", "instance", "event").orderBy("tick"))
    aged = F.unix_seconds("tick") - F.unix_seconds(before) > window_s
    turn = F.when(high, F.lit(True)).when(low | aged, F.lit(False))
    return (ticks.withColumn("turn", turn)
            .withColumn("active", F.coalesce(F.last("turn", ignorenulls=True).over(so_far), F.lit(False))))
