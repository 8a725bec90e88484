"""Filtered search of the log table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..functions.times import as_timestamp, seconds


def _label(df: DataFrame, key: str) -> Column:
    """A promoted column where the table has one, so the scan can prune on it."""
    return F.col(key) if key in df.columns else F.try_element_at("labels", F.lit(key))


def _field(key: str) -> Column:
    return F.try_element_at("kv", F.lit(key))


def _contains(text: str) -> Column:
    """Case-insensitive substring; % and _ stay wildcards, a backslash makes one literal."""
    return F.col("raw").ilike(re.sub(r"\\(?![%_\\])", "", f"%{text}%"))


def _any_field(df: DataFrame, value: str) -> Column:
    """The value under any key; typed fields also match inside a list, never a number."""
    plain = F.exists(F.map_values("kv"), lambda v: v == value)
    if "kv_v" not in df.columns:
        return plain
    is_text = lambda v: F.schema_of_variant(v) == "STRING"
    same = lambda v: F.coalesce(is_text(v) & (v.cast("string") == value), F.lit(False))
    listed = lambda v: F.coalesce(F.exists(F.try_variant_get(v, "$", "array<variant>"), same), F.lit(False))
    typed = F.exists(F.map_values("kv_v"), lambda v: same(v) | listed(v))
    untyped = F.exists(F.map_entries("kv"), lambda e: (e["value"] == value)
                       & ~F.map_contains_key("kv_v", e["key"]))
    return F.when(F.col("kv_v").isNull(), plain).otherwise(typed | untyped)


def is_network() -> Column:
    source = F.coalesce(F.try_element_at("labels", F.lit("source")), F.lit(""))
    return (F.col("event").startswith("netsnap") | (source == "netsnap")
            | F.col("event").isin(V.NETWORK_EVENTS))


def log_filter(df: DataFrame, *, event=None, instance=None, source=None, q=None, value=None, kv=None,
               port=None, process=None, network_only=False, start_time=None, end_time=None,
               since_s=None, as_of=None) -> Column:
    """All given filters as one predicate, shared by rows and counts.

    Time bounds are repeated on event_date where the table has it, so whole
    partitions are skipped. A value with unsearchable characters raises.
    """
    keep = F.lit(True)
    if event:
        keep &= F.col("event") == event
    if instance:
        keep &= _label(df, "instance") == instance
    if source:
        keep &= _label(df, "source") == source
    if q:
        keep &= _contains(q)
    if network_only:
        keep &= is_network()
    if value:
        if not re.fullmatch(V.SAFE_VALUE, value):
            raise ValueError("value contains characters that are not searchable")
        keep &= _any_field(df, value)
    if kv:
        key, _, wanted = kv.partition(":")
        if not key or not wanted:
            raise ValueError("kv filter must be key:value")
        keep &= _field(key) == wanted
    if port is not None and str(port).strip():
        number = str(port).strip()
        keep &= (_field("local_port") == number) | (_field("peer_port") == number)
    if process:
        keep &= _field("process") == process
    lower = as_timestamp(start_time) if start_time is not None else None
    if lower is None and since_s:
        lower = as_timestamp(as_of) - seconds(since_s)
    dated = "event_date" in df.columns
    if lower is not None:
        keep &= F.col("timestamp") >= lower
        keep = keep & (F.col("event_date") >= lower.cast("date")) if dated else keep
    if end_time is not None:
        upper = as_timestamp(end_time)
        keep &= F.col("timestamp") <= upper
        keep = keep & (F.col("event_date") <= upper.cast("date")) if dated else keep
    return keep


def clamp_limit(limit: int, cap: int = V.HARD_ROW_CAP) -> int:
    """For callers that take limits from outside."""
    return max(1, min(int(limit), cap))


def search_logs(df: DataFrame, limit: int | None = V.DEFAULT_ROWS, **filters) -> DataFrame:
    """Newest first, ties by id; as many as asked for, all of them without a limit."""
    if limit is not None and limit < 1:
        raise ValueError("a limit is at least 1")
    found = df.filter(log_filter(df, **filters)).orderBy(F.desc("timestamp"), F.desc("id"))
    return found if limit is None else found.limit(int(limit))


def surface_search(df: DataFrame, limit: int = V.DEFAULT_ROWS, **filters) -> DataFrame:
    """search_logs with the cap of a request from outside."""
    return search_logs(df, clamp_limit(limit, V.SURFACE_ROW_CAP), **filters)


def count_logs(df: DataFrame, **filters) -> DataFrame:
    return df.filter(log_filter(df, **filters)).agg(F.count("*").alias("matched"))


def search_with_truncation(df: DataFrame, limit: int | None, **filters) -> DataFrame:
    """One row: how many rows match, how many a search returns, and whether it stops short."""
    shown = F.col("matched") if limit is None else F.least(F.col("matched"), F.lit(limit).cast("long"))
    cut = F.col("returned") < F.col("matched")
    return (count_logs(df, **filters).withColumn("returned", shown).withColumn("truncated", cut)
            .withColumn("note", F.when(F.col("truncated"), F.format_string(
                "showing the most recent %d of %d requests in this window; raise ?limit= to widen it",
                F.col("returned"), F.col("matched")))))


def recent(df: DataFrame, event: str | None = None, limit: int = V.DEFAULT_ROWS) -> DataFrame:
    return search_logs(df, limit, event=event)


def network_events(df: DataFrame, ip=None, protocol=None, limit: int = 1000, **filters) -> DataFrame:
    """Socket, ssh and resolver rows; a protocol pins the event."""
    return search_logs(df, limit, value=ip, event=V.PROTOCOL_EVENTS.get(protocol),
                       network_only=True, **filters)


def instances(df: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Hosts that logged anything in the window."""
    rows = df.filter(log_filter(df, since_s=days * 86400, as_of=as_of))
    return (rows.select(_label(df, "instance").alias("instance")).filter("instance != ''")
            .distinct().orderBy("instance"))


def auto_filter(term: str) -> dict:
    """The filter a search term is shaped like: an address, key:value, or text."""
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", term):
        return {"value": term}
    if re.fullmatch(r"(?i)[a-z_][a-z0-9_]*:\S+", term):
        return {"kv": term}
    return {"q": term}
