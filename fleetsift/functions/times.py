"""Timestamps and durations."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, functions as F

from .. import fixed_values as V

MICROS = 1_000_000


def as_timestamp(value) -> Column:
    """A Column, datetime or ISO string as a timestamp column."""
    if isinstance(value, Column):
        return value.cast("timestamp")
    if isinstance(value, datetime):
        return F.lit(value).cast("timestamp")
    return F.lit(str(value)).cast("timestamp")


def seconds(n) -> Column:
    return F.make_dt_interval(secs=F.lit(n) if not isinstance(n, Column) else n)


def parse_ts(c: Column) -> Column:
    """ISO-8601 text or a numeric epoch (above 1e11: milliseconds); else null."""
    text = F.trim(c.cast("string"))
    number = text.try_cast("double")
    micros = F.when(number > V.MILLISECOND_EPOCH_FLOOR, number * 1000).otherwise(number * MICROS)
    return (F.when(text.rlike(r"^[+-]?\d+(\.\d+)?([eE][+-]?\d+)?$"),
                   F.timestamp_micros(micros.try_cast("bigint")))
            .when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp")))


def ns_to_ts(c: Column) -> Column:
    """Nanoseconds since the epoch, as text or number; not positive or garbage is null."""
    ns = c.cast("string").try_cast("bigint")
    return F.when(ns > 0, F.timestamp_micros(int_div(ns, 1000)))


def int_div(c: Column, n: int) -> Column:
    """Integer quotient of a non-negative long, without a detour through doubles."""
    return F.call_function("div", c, F.lit(n)).cast("bigint")


def clamp_ts(ts: Column, as_of) -> Column:
    """struct(ts, suspect): the future and the years before 2000 are set aside."""
    bad = ((ts > as_timestamp(as_of) + seconds(V.MAX_FUTURE_SECONDS))
           | (ts < F.timestamp_seconds(F.lit(V.EPOCH_FLOOR_SECONDS))))
    return F.struct(F.when(~bad, ts).alias("ts"), F.when(bad, ts).alias("suspect"))


def clf_time(c: Column) -> Column:
    """'15/Sep/2026:06:04:42 +0000' as a timestamp; the offset is optional."""
    stamp = F.regexp_extract(c, V.CLF_STAMP, 1)
    offset = F.regexp_extract(c, V.CLF_STAMP, 2)
    base = F.try_to_timestamp(F.concat(stamp, F.lit(" +0000")),
                              F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
    minutes = (F.substring(offset, 2, 2).try_cast("int") * 60
               + F.substring(offset, 4, 2).try_cast("int"))
    shift = F.when(offset == "", F.lit(0)).when(offset.startswith("+"), minutes).otherwise(-minutes)
    return F.when(stamp != "", F.timestamp_micros(F.unix_micros(base) - shift.cast("bigint") * (60 * MICROS)))


# ---- durations are settings, not columns ------------------------------------

def search_window(spec: str | None) -> int | None:
    """'15m', '6h', '7d', '90s' or bare seconds; anything else is ignored."""
    m = re.fullmatch(r"\s*([+-]?\d+)\s*([mhds]?)", spec or "")
    if not m:
        return None
    return int(m.group(1)) * {"m": 60, "h": 3600, "d": 86400, "s": 1, "": 1}[m.group(2)]


def stream_window(spec: str | None, default: int = 900) -> int:
    """As search_window, but garbage raises and nothing means the default."""
    text = (spec or "").strip().lower()
    if not text:
        return default
    m = re.fullmatch(r"(\d+)([smhd]?)", text)
    if not m:
        raise ValueError(f"bad duration {spec!r}")
    return int(m.group(1)) * {"s": 1, "": 1, "m": 60, "h": 3600, "d": 86400}[m.group(2)]


def retention_window(spec: str | None = V.DEFAULT_RETENTION) -> int | None:
    """Seconds to keep, or None when switched off. Refuses a number without a unit."""
    text = "" if spec is None else str(spec).strip().lower()
    if text in V.RETENTION_OFF:
        return None
    m = re.fullmatch(r"(\d+)\s*([mhdw])", text)
    if not m:
        raise ValueError(f"retention {spec!r} needs a number with a unit: m, h, d or w")
    window = int(m.group(1)) * {"m": 60, "h": 3600, "d": 86400, "w": 604800}[m.group(2)]
    if window < V.MIN_RETENTION_SECONDS:
        raise ValueError(f"retention {spec!r} is under {V.MIN_RETENTION_SECONDS} seconds")
    return window
