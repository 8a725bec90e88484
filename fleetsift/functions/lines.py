"""Small readers of line fragments, addresses and keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as V

COLLECTOR_UNITS = ["fleetsift.service"]
COLLECTOR_IDENTIFIERS = ["fleetsift"]


def parse_stream_labels(c: Column) -> Column:
    """'{a="x",b="y"}' as a map; of a repeated label the last value stays."""
    pattern = '([a-zA-Z_0-9]+)="([^"]*)"'
    return _last_wins(F.regexp_extract_all(c, F.lit(pattern), 1),
                      F.regexp_extract_all(c, F.lit(pattern), 2))


def _last_wins(keys: Column, values: Column) -> Column:
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.array_contains(
        F.slice(keys, i + 2, F.size(keys)), p["k"]))
    return F.map_from_entries(last)


def parse_logfmt(c: Column) -> Column:
    """Whitespace separated key=value words as a map; the first spelling stays."""
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda w: w.contains("="))
    keys = F.transform(words, lambda w: F.substring_index(w, "=", 1))
    first = F.filter(words, lambda w, i: ~F.array_contains(
        F.slice(keys, F.lit(1), i), F.substring_index(w, "=", 1)))
    return F.map_from_entries(F.transform(first, lambda w: F.struct(
        F.substring_index(w, "=", 1).alias("k"),
        F.substr(w, F.length(F.substring_index(w, "=", 1)) + F.lit(2)).alias("v"))))


def merge_fields(kv: Column, more: Column) -> Column:
    """kv, plus the keys of more it does not have."""
    return F.map_concat(kv, F.map_filter(more, lambda k, _: ~F.map_contains_key(kv, k)))


def split_addr(c: Column) -> Column:
    """struct(host, port) of 'host:port' or '[v6]:port'; the last colon splits."""
    text = F.trim(c)
    port = F.substring_index(text, ":", -1)
    host = F.left(text, F.greatest(F.length(text) - F.length(port) - 1, F.lit(0)))
    bare = F.rtrim(F.ltrim(host, F.lit("[")), F.lit("]"))
    return F.struct(F.when(text.startswith("["), bare).otherwise(host).alias("host"),
                    port.alias("port"))


def edge_port(channel: Column, port: Column) -> Column:
    """Port of an edge: its own, else the channel's 'port_N' or digits, else 0."""
    own = F.nullif(port.try_cast("int"), F.lit(0))
    named = F.when(channel.startswith("port_"), F.substring(channel, 6, 20).try_cast("int"))
    digits = F.when(channel.rlike(r"^\d+$"), channel.try_cast("int"))
    return F.coalesce(own, named, digits, F.lit(0))


def is_noise(raw: Column, labels: Column, units=None, identifiers=None) -> Column:
    """The collector's own output coming back in."""
    units = V.NOISE_UNITS + (COLLECTOR_UNITS if units is None else units)
    identifiers = V.NOISE_IDENTIFIERS + (COLLECTOR_IDENTIFIERS if identifiers is None else identifiers)
    label = lambda k: F.coalesce(F.try_element_at(labels, F.lit(k)), F.lit(""))
    found = (label("unit").isin(units) | label("user_unit").isin(units)
             | label("syslog_identifier").isin(identifiers) | label("comm").isin(V.NOISE_COMMANDS))
    for prefix in V.NOISE_PREFIXES:
        found = found | raw.startswith(prefix)
    for part in V.NOISE_SUBSTRINGS:
        found = found | raw.contains(part)
    return F.coalesce(found, F.lit(False))


def is_critical(raw: Column) -> Column:
    """A kernel or hardware alarm."""
    return F.coalesce(raw.rlike(V.CRITICAL_LINE), F.lit(False))


def finding_key(kind: Column, subject: Column, instance: Column) -> Column:
    """What makes two detections the same finding: 32 hex digits."""
    part = lambda c: F.coalesce(c, F.lit(""))
    return F.substring(F.sha2(F.concat(part(kind), F.lit("|"), part(subject), F.lit("|"),
                                       part(instance)), 256), 1, 32)
