"""Access-log lines and structured requests as one request struct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from .documents import first_key

FIELDS = ["ip", "when", "method", "path", "proto", "status", "referer", "ua", "sport", "source"]
MARK = "\x01"


# Groups of each dialect by position.
UVICORN = (V.UVICORN_LINE, ["ip", "sport", "method", "path", "proto", "status"])
UVICORN_LOOSE = (V.UVICORN_LOOSE_LINE, ["ip", "sport", "method", "path", "status"])
COMBINED = (V.COMBINED_LINE, ["ip", "when", "method", "path", "proto", "status", "referer", "ua"])
DIALECTS = {"classifier": [("uvicorn", *UVICORN_LOOSE), ("nginx", *COMBINED)],
            "profiler": [("nginx", *COMBINED), ("uvicorn", *UVICORN)]}


def _parts(raw: Column, pattern: str, order: list[str]) -> Column:
    """Groups of the first match at 1..n from one pass of the regex; else one element."""
    clean = F.translate(F.coalesce(raw, F.lit("")), MARK, " ")
    wanted = MARK.join(f"${i}" for i in range(1, len(order) + 1))
    return F.split(F.regexp_replace(clean, rf"(?s)^.*?(?:{pattern}).*$", MARK + wanted), MARK)


def _field(name: str, parts: Column, order: list[str]) -> Column:
    null = F.lit(None).cast("string")
    return F.get(parts, F.lit(order.index(name) + 1)) if name in order else null


def parse_access(raw: Column, reader: str = "classifier") -> Column:
    """Request struct of an access line, or null.

    The classifier reads the uvicorn form first and does not need its protocol;
    the profiler reads the combined form first and the uvicorn form strictly.
    """
    found = []
    for source, pattern, order in DIALECTS[reader]:
        parts = _parts(raw, pattern, order)
        fields = [(F.lit(source) if f == "source" else _field(f, parts, order)).alias(f) for f in FIELDS]
        found.append(F.when(F.size(parts) > 1, F.struct(*fields)))
    return F.coalesce(*found)


def request_from_fields(kv: Column) -> Column:
    """Request struct from fields, only where ip, path and status are all there."""
    get = lambda k: F.try_element_at(kv, F.lit(k))
    filled = lambda k: F.when(get(k) != "", get(k))
    ip = first_key(kv, ["ip", "client_ip", "remote_ip"])
    path = first_key(kv, ["path", "url"])
    status = F.coalesce(filled("status"), get("code"))
    null = F.lit(None).cast("string")
    values = {"ip": ip, "when": null, "method": filled("method"), "path": path,
              "proto": filled("proto"), "status": status, "referer": filled("referer"),
              "ua": filled("ua"), "sport": filled("sport"), "source": F.lit("structured")}
    return F.when(ip.isNotNull() & path.isNotNull() & status.isNotNull(),
                  F.struct(*[values[f].alias(f) for f in FIELDS]))


def _with_lines(df: DataFrame, reader: str, skip: Column) -> DataFrame:
    """Adds _first and _second, the groups of the reader's two dialects.

    One projection per step: each regex runs once per row, and the second one
    only on lines the first did not match.
    """
    (_, p1, o1), (_, p2, o2) = DIALECTS[reader]
    return (df.withColumn("_first", F.when(~skip, _parts(F.col("raw"), p1, o1)))
            .withColumn("_second", F.when(F.size("_first") == 1, _parts(F.col("raw"), p2, o2))))


def with_hit(events: DataFrame) -> DataFrame:
    """Adds ip, path, method, status: the raw line wins, the fields fill in.

    A row that is no request is left with a null ip or path.
    """
    (_, _, o1), (_, _, o2) = DIALECTS["classifier"]
    lines = (_with_lines(events, "classifier", F.lit(False))
             .withColumn("_line", (F.size("_first") > 1) | (F.size("_second") > 1)))
    kv = F.col("kv")
    get = lambda k: F.try_element_at(kv, F.lit(k))
    other = {"ip": first_key(kv, ["client_ip", "remote_ip", "peer_ip", "ip"]),
             "path": first_key(kv, ["path", "url"]),
             "method": F.coalesce(first_key(kv, ["method"]), F.lit("GET")),
             "status": F.coalesce(first_key(kv, ["status", "code"]), F.lit(""))}
    for name, fallback in other.items():
        line = F.coalesce(_field(name, F.col("_first"), o1), _field(name, F.col("_second"), o2))
        lines = lines.withColumn(name, F.when(F.col("_line"), line).otherwise(fallback))
    return lines.drop("_first", "_second", "_line")


def with_request(events: DataFrame) -> DataFrame:
    """Adds the request fields: structured fields first, then the raw line.

    A row that is no request is left with a null ip.
    """
    (s1, _, o1), (s2, _, o2) = DIALECTS["profiler"]
    base = events.withColumn("_kv", request_from_fields(F.col("kv")))
    lines = _with_lines(base, "profiler", F.col("_kv").isNotNull())
    def pick(name):
        first = F.lit(s1) if name == "source" else _field(name, F.col("_first"), o1)
        second = F.lit(s2) if name == "source" else _field(name, F.col("_second"), o2)
        return (F.when(F.col("_kv").isNotNull(), F.col("_kv")[name])
                .when(F.size("_first") > 1, first).when(F.size("_second") > 1, second))
    for name in FIELDS:
        lines = lines.withColumn(name, pick(name))
    return lines.drop("_kv", "_first", "_second")
