"""Lines from text, JSON bodies, log-stream payloads and socket snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import fixed_values as V
from ..functions.documents import is_object, text_of
from ..functions.lines import split_addr
from ..session import cut_lineage

DEFAULT_LABELS = {"protocol": "http"}


def _labels(labels: dict | None) -> Column:
    pairs = dict(DEFAULT_LABELS, **(labels or {}))
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def lines_of(df: DataFrame, labels: dict | None = None, column: str = "value") -> DataFrame:
    """(raw, labels) of every non-blank line, stripped."""
    return (df.select(F.trim(F.regexp_replace(column, r"^\s+|\s+$", "")).alias("raw"))
            .filter("raw != ''").withColumn("labels", _labels(labels)))


def read_lines(spark: SparkSession, path: str, labels: dict | None = None) -> DataFrame:
    return lines_of(spark.read.text(path), labels)


def json_lines_of(df: DataFrame, labels: dict | None = None, column: str = "value") -> DataFrame:
    """(raw, labels) of JSON bodies.

    A body is a list of strings or {line} objects, {labels, lines}, {line}, or
    else itself the line. Its labels override the defaults. Bodies that do not
    parse give no row.
    """
    body = F.try_parse_json(column)
    get = lambda path, kind="variant": F.try_variant_get("v", path, kind)
    parsed = df.select(F.col(column).alias("body"), body.alias("v")).filter("v is not null")
    items = F.coalesce(get("$", "array<variant>"), get("$.lines", "array<variant>"), F.array(F.col("v")))
    own = F.coalesce(get("$.labels", "map<string,string>"), F.expr("cast(map() as map<string,string>)"))
    rows = parsed.select(own.alias("own"), F.explode(items).alias("item"))
    line = F.coalesce(F.try_variant_get("item", "$.line", "string"),
                      F.when(is_object(F.col("item")), F.to_json("item")).otherwise(text_of(F.col("item"))))
    defaults = F.map_filter(_labels(labels), lambda k, _: ~F.map_contains_key("own", k))
    return (rows.select(F.trim(line).alias("raw"), F.map_concat(defaults, "own").alias("labels"))
            .filter("raw != ''"))


def rejected_bodies(df: DataFrame, column: str = "value") -> DataFrame:
    """One row: how many bodies there are, and how many of them are no JSON and so give no lines."""
    blank = F.trim(F.coalesce(column, F.lit(""))) == ""
    return df.agg(F.count_if(~blank).alias("bodies"), F.count_if(~blank & F.try_parse_json(column).isNull()).alias("rejected"))


def identified(lines: DataFrame, labels: dict | None = None) -> DataFrame:
    """Lines from any reader here as (id, ts, raw, labels), ready for ingest.

    Log-stream entries keep their time and get an id from time, labels and line, so that an entry read
    twice is the same row. Other lines have no time yet; their id comes from the line and its place in
    the reading.
    """
    if "ts_ns" in lines.columns:
        raw, ts, place = F.col("line"), F.timestamp_micros(F.call_function("div", F.col("ts_ns"), F.lit(1000))), F.col("ts_ns")
    else:
        raw, ts, place = F.col("raw"), F.lit(None).cast("timestamp"), F.monotonically_increasing_id()
    own = F.map_concat(_labels(labels), "labels") if labels else F.col("labels")
    key = F.array_join(F.transform(F.array_sort(F.map_entries(own)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return lines.select(F.xxhash64(place, key, raw).alias("id"), ts.alias("ts"), raw.alias("raw"), own.alias("labels"))


def read_json_lines(spark: SparkSession, path: str, labels: dict | None = None) -> DataFrame:
    return json_lines_of(spark.read.text(path, wholetext=True), labels)


def log_stream_entries(df: DataFrame, column: str = "value") -> DataFrame:
    """(labels, ts_ns, line) of log-stream payloads, push or query shape.

    Entries with fewer than two items or a stamp that is no integer are skipped.
    """
    streams = "array<struct<stream:map<string,string>,values:array<array<string>>>>"
    get = lambda path: F.try_variant_get(F.try_parse_json(column), path, "variant")
    body = F.coalesce(get("$.streams"), get("$.data.result"))
    entry = (df.select(F.from_json(F.to_json(body), streams).alias("streams"))
             .select(F.explode("streams").alias("s"))
             .select(F.coalesce("s.stream", F.expr("cast(map() as map<string,string>)")).alias("labels"),
                     F.explode("s.values").alias("e")))
    return (entry.filter(F.size("e") >= 2)
            .select("labels", F.get("e", F.lit(0)).try_cast("bigint").alias("ts_ns"),
                    F.get("e", F.lit(1)).alias("line")).filter("ts_ns is not null"))


def read_log_streams(df: DataFrame, column: str = "value") -> DataFrame:
    """log_stream_entries in time order."""
    return log_stream_entries(df, column).orderBy("ts_ns")


def regroup_streams(entries: DataFrame, extra_labels: dict | None = None,
                    block: str = "hour") -> DataFrame:
    """Entries back in streams: one row per label set and block of time, entries in order.

    One label set may hold most of a fleet's lines; its payload is cut by time so
    that no row, and no task, has to hold all of it.
    """
    extra = {k: v for k, v in (extra_labels or {}).items()}
    added = F.create_map(*[F.lit(x) for kv in extra.items() for x in kv]) if extra else None
    labels = F.col("labels")
    if added is not None:
        labels = F.map_concat(F.map_filter(labels, lambda k, _: ~F.map_contains_key(added, k)), added)
    start = F.date_trunc(block, F.timestamp_micros((F.col("ts_ns") / 1000).cast("bigint")))
    keyed = entries.withColumn("labels", labels).withColumn("block", start).withColumn(
        "key", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("labels")))))
    order = F.array_sort(F.collect_list(F.struct("ts_ns", "line")))
    return (keyed.groupBy("key", "block").agg(F.first("labels").alias("labels"), order.alias("entries")))


def chunk_streams(entries: DataFrame, lines: int = 1000) -> DataFrame:
    """Entries back in streams: (key, chunk, labels, entries), at most `lines` of them in a row, in order.

    Entries are cut into pieces by range of (labels, time, line), so one label set may fill many tasks. A line's place in
    its stream is its place in the piece plus what earlier pieces hold of that stream; only the last stream of
    a piece goes on in the next, so the carried counts are one row a piece. Null labels count as none.
    """
    labels = F.coalesce("labels", F.expr("cast(map() as map<string,string>)"))
    keyed = entries.withColumn("labels", labels).withColumn("key", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("labels")))))
    pieces = cut_lineage(keyed.repartitionByRange("key", "ts_ns", "line").withColumn("piece", F.spark_partition_id()))
    counts = pieces.groupBy("key", "piece").agg(F.count("*").alias("held"))
    edges = pieces.groupBy("piece").agg(F.min("key").alias("key"), F.max("key").alias("last"))
    tails = edges.select("piece", F.col("last").alias("key")).join(counts, ["key", "piece"]).withColumnRenamed("piece", "from")
    before = (edges.join(tails, "key").where(F.col("from") < F.col("piece")).groupBy("key", "piece").agg(F.sum("held").alias("before")))
    order = Window.partitionBy("key", "piece").orderBy("ts_ns", "line")
    placed = (pieces.withColumn("place", F.row_number().over(order) - 1).join(before, ["key", "piece"], "left")
              .withColumn("chunk", F.floor((F.col("place") + F.coalesce("before", F.lit(0))) / lines)))
    return placed.groupBy("key", "chunk").agg(F.first("labels").alias("labels"),
                                              F.array_sort(F.collect_list(F.struct("ts_ns", "line"))).alias("entries"))


def parse_socket_snapshot(df: DataFrame, with_state: bool = False, column: str = "value") -> DataFrame:
    """Rows of a captured socket list: proto, state, local, peer, process, pid.

    Listening captures carry a state column that established ones leave out.
    Loopback, link-local and wildcard peers are dropped; no user means '-'.
    """
    shift = 1 if with_state else 0
    words = F.split(F.trim(column), r"\s+")
    at = lambda i: F.get("words", F.lit(i))
    host = lambda c: F.substring_index(c["host"], "%", 1)
    user = lambda i: F.coalesce(F.nullif(F.regexp_extract(
        column, r'users:\(\("([^"]+)",pid=(\d+)', i), F.lit("")), F.lit("-"))
    rows = (df.select(column, words.alias("words")).filter(F.size("words") >= 5 + shift)
            .select(column, at(0).alias("proto"),
                    (at(1) if with_state else F.lit("established")).alias("state"),
                    split_addr(at(3 + shift)).alias("l"), split_addr(at(4 + shift)).alias("p")))
    out = rows.select("proto", "state", host(F.col("l")).alias("local"), F.col("l.port").alias("local_port"),
                      host(F.col("p")).alias("peer"), F.col("p.port").alias("peer_port"),
                      user(1).alias("process"), user(2).alias("pid"))
    return out.filter(~F.col("peer").rlike(V.SKIPPED_PEER) & (F.col("peer_port") != "")
                      & (F.col("peer_port") != "*"))
