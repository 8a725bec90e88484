"""Shape of a value, and canonical field names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as V
from .staging import with_value


def classify_value(c: Column) -> Column:
    """Canonical type of a scalar by its shape, or null."""
    return _shape(F.trim(c.cast("string")))


def _shape(v: Column) -> Column:
    """classify_value of trimmed text. Characters that a shape cannot do without are asked for before its pattern is tried."""
    dot, colon, dash = v.contains("."), v.contains(":"), v.contains("-")
    colons = F.length(v) - F.length(F.replace(v, F.lit(":"), F.lit("")))
    return (F.when(v.isNull() | (v == ""), F.lit(None).cast("string"))
            .when(dot & v.rlike(V.IPV4), "ip")
            .when(dot & colon & v.rlike(V.IPV4_PORT), "ip_port")
            .when((colon | dash) & v.rlike(V.MAC), "mac")
            .when(dash & v.rlike(V.UUID), "uuid")
            .when(v.contains("://") & v.rlike(V.URL), "url")
            .when(v.startswith("/") & v.rlike(V.PATH), "path")
            .when(v.rlike(V.DURATION), "duration")
            .when(v.contains("B") & v.rlike(V.BYTES), "bytes")
            .when(colon & (colons >= 2) & v.rlike(V.IPV6), "ipv6")
            .when(dot & v.rlike(V.FQDN) & ~v.rlike(r"^[\d.]+$"), "host")
            .when((F.length(v) >= 6) & v.rlike(V.HEX), "hex")
            .when(v.rlike(V.INTEGER) | (dot & v.rlike(V.FLOAT)), "num")
            .when(v.rlike(V.HOSTNAME), "host_or_word"))


def _words(key: Column) -> Column:
    lower = F.when(key.rlike(r"[^\x00-\x40\x5B-\x7F]"), F.lower(key)).otherwise(key)  # most keys are lower-case already
    return F.filter(F.split(lower, V.KEY_SEPARATORS), lambda w: w != "")


def _described(entries: Column) -> Column:
    """key, value, type after the key has had its say, the name by type and role, and the parts of an address with a port, of every entry.

    Lambdas share no common parts, so what is needed more than once is a field of the step before.
    """
    read = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), F.trim(e["value"].cast("string")).alias("text"),
                                                   _words(e["key"]).alias("words")))
    shaped = F.transform(read, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), e["text"].alias("text"), e["words"].alias("words"),
                                                  _shape(e["text"]).alias("shape")))

    def describe(e):
        role = F.array_join(F.filter(e["words"], lambda w: ~w.isin(list(V.TYPE_WORDS) + V.UNTYPED_WORDS)), "_")
        first = F.get(F.filter(e["words"], lambda w: w.isin(list(V.TYPE_WORDS))), F.lit(0))
        names_host = F.coalesce(first.isin([w for w, kind in V.TYPE_WORDS.items() if kind == "host"]), F.lit(False)) | F.exists(
            e["words"], lambda w: w.isin(V.HOST_ROLE_WORDS))
        kind = (F.when(e["shape"].isin("host", "host_or_word"), F.when(names_host, F.lit("host")))
                .when(~e["shape"].isin("num", "hex"), e["shape"]))
        return F.struct(e["key"].alias("key"), e["value"].alias("value"), e["text"].alias("text"), kind.alias("kind"), role.alias("role"))

    def name(e):
        pair = lambda group: F.when(e["kind"] == "ip_port", F.regexp_extract(e["text"], V.IPV4_PORT, group))
        return F.struct(e["key"].alias("key"), e["value"].alias("value"), e["kind"].alias("kind"), _named(e["role"], e["kind"]).alias("name"),
                        _named(e["role"], "ip").alias("ip_name"), _named(e["role"], "port").alias("port_name"),
                        pair(1).alias("ip"), pair(2).alias("port"))

    return F.transform(F.transform(shaped, describe), name)


def _put(m: Column, key: Column, value: Column) -> Column:
    return F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(key, value))


def _named(role: Column, kind) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.when(role == "", kind).otherwise(F.concat_ws("_", role, kind))


def normalize_fields(kv: Column) -> Column:
    """Rename fields by the shape of their value, keeping the role in the key.

    Keys are taken in map order. A name already held by a different value leaves
    the later field under its own key. The first ip, host, port, path, user, url,
    mac and uuid seen also appear under the bare name.
    """
    empty = F.expr("cast(map() as map<string,string>)")
    fields = _described(F.map_entries(kv))

    def step(acc, f):
        out, first = acc["out"], acc["first"]
        held = F.try_element_at(out, f["name"])
        target = F.when(held.isNotNull() & (held != f["value"]), f["key"]).otherwise(f["name"])
        pair = F.map_filter(F.create_map(F.lit("ip"), f["ip"], F.lit("port"), f["port"]), lambda k, _: ~F.map_contains_key(first, k))
        split_pair = F.struct(
            F.map_concat(F.map_filter(out, lambda k, _: (k != f["ip_name"]) & (k != f["port_name"])),
                         F.create_map(f["ip_name"], f["ip"], f["port_name"], f["port"])).alias("out"),
            F.map_concat(first, pair).alias("first"))
        untyped = F.struct(_put(out, f["key"], f["value"]).alias("out"), first.alias("first"))
        typed = F.struct(
            with_value(target, lambda t: _put(out, t, f["value"])).alias("out"),
            F.when(F.map_contains_key(first, f["kind"]), first).otherwise(F.map_concat(first, F.create_map(f["kind"], f["value"]))).alias("first"))
        return F.when(f["kind"] == "ip_port", split_pair).when(f["kind"].isNull(), untyped).otherwise(typed)

    def finish(acc):
        extra = F.map_filter(acc["first"], lambda k, _: k.isin(V.BARE_ALIASES)
                             & ~F.map_contains_key(acc["out"], k))
        return F.map_concat(acc["out"], extra)

    start = F.struct(empty.alias("out"), empty.alias("first"))
    return F.when(F.size(kv) > 0, F.aggregate(fields, start, step, finish)).otherwise(kv)
