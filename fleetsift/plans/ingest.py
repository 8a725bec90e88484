"""Raw lines and structured events to stored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.lines import is_noise
from ..functions.staging import only_where
from ..functions.times import clamp_ts
from ..operators.templates import Rule, match_templates
from ..sources.ecs import map_ecs


def ingest_lines(lines: DataFrame, rules: list[Rule], as_of, more: list[str] = ()) -> DataFrame:
    """Lines (id, raw, labels, ts) with event, kv, clamped time and what became of them.

    status is matched, unstructured or filtered (the collector's own output);
    `suspect` keeps a time that was set aside. Columns named in `more` come along.
    """
    text = lines.withColumn("raw", F.trim(F.regexp_replace("raw", r"^\s+|\s+$", ""))).filter("raw != ''")
    clamped = clamp_ts(F.col("ts"), as_of)
    rows = match_templates(text.withColumn("_t", clamped), rules)
    status = (F.when(is_noise(F.col("raw"), F.col("labels")), "filtered")
              .when(F.col("event") == "unstructured", "unstructured").otherwise("matched"))
    rows = rows.withColumns({"ts": F.col("_t.ts"), "suspect": F.col("_t.suspect"),
                             "latency_us": F.lit(0.0), "status": status})
    return only_where(rows, F.col("status").isNotNull(), ["event", "kv", "ts", "suspect", "status"],
                      ["id", "labels", "latency_us", "raw", *more])


def ingest_documents(documents: DataFrame, as_of, more: list[str] = ()) -> DataFrame:
    """ECS documents (doc, rejected) as stored rows; they pass by the rules entirely. Columns named in `more` come along."""
    mapped = map_ecs(documents, as_of)
    status = (F.when(F.col("rejected") | ~F.coalesce("stored", F.lit(False)), "rejected")
              .when(is_noise(F.col("raw"), F.col("labels")), "filtered").otherwise("structured"))
    suspect = F.try_element_at("kv", F.lit("_ts_suspect")).try_cast("timestamp")
    rows = mapped.withColumns({"suspect": suspect, "latency_us": F.lit(0.0), "status": status})
    return only_where(rows, F.col("status").isNotNull(),
                      ["ts", "suspect", "event", "labels", "kv", "kv_v", "latency_us", "raw", "status"], list(more))


def ingest_feed(feed: DataFrame, rules: list[Rule], as_of, kind: str | None = None) -> DataFrame:
    """Rows of a feed (sources/feed.py) with what became of them: lines by the rules, ECS documents past them.

    status is matched, unstructured, structured, filtered or rejected; refused rows keep their body and a reason, and a
    document that has neither a message nor a request is refused as `nothing to store`. Each part reads the
    feed again, so the caller keeps it; with the one kind that a feed holds, the other parts are left out.
    """
    none = lambda kind: F.lit(None).cast(kind)
    parts = [feed.where("reason IS NOT NULL").select(
        "id", "kind", none("timestamp").alias("ts"), none("timestamp").alias("suspect"), F.lit("rejected").alias("event"), "labels",
        none("map<string,string>").alias("kv"), none("map<string,variant>").alias("kv_v"), F.lit(0.0).alias("latency_us"),
        none("string").alias("raw"), F.lit("rejected").alias("status"), "reason", "body")]
    if kind != "ecs":
        lines = ingest_lines(feed.where("reason IS NULL AND doc IS NULL"), rules, as_of, ["kind"])
        parts.append(lines.withColumns({"kv_v": none("map<string,variant>"), "reason": none("string"), "body": none("string")}))
    if kind in (None, "ecs"):
        documents = feed.where("reason IS NULL AND doc IS NOT NULL").select("id", "kind", "doc", F.lit(False).alias("rejected"))
        mapped, empty = ingest_documents(documents, as_of, ["id", "kind"]), F.col("status") == "rejected"
        parts.append(mapped.withColumns({"reason": F.when(empty, "nothing to store"), "body": F.when(empty, F.to_json("kv"))}))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


def to_store(rows: DataFrame) -> DataFrame:
    """The rows that are stored."""
    return only_where(rows, F.col("status").isin("matched", "unstructured", "structured"),
                      [c for c in rows.columns if c not in ("status", "suspect")])
