"""Structured events (ECS documents): reading them and mapping them to log rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import fixed_values as V
from ..functions.documents import claimed_keys, deepest, first_key, flatten_json, is_object, text_of
from ..functions.times import clamp_ts, parse_ts


def decode_documents(df: DataFrame, column: str = "value", ndjson: bool = False) -> DataFrame:
    """(doc VARIANT, rejected) of bodies: an array, one object, or with ndjson a line each.

    A body that does not parse, and an element that is no object, is marked
    rejected instead of being stored or silently dropped. Blank lines are nothing.
    """
    text = df.select(F.col(column).alias("body"))
    if ndjson:
        text = text.select(F.explode(F.split("body", r"\r?\n")).alias("body"))
    parsed = (text.filter(F.trim("body") != "").select("body", F.try_parse_json("body").alias("v")))
    items = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    if ndjson:
        items = F.array("v")
    rows = parsed.select("body", F.explode(items).alias("doc"))
    return rows.withColumn("rejected", ~is_object(F.col("doc")))


def read_ecs(spark: SparkSession, path: str, ndjson: bool = False) -> DataFrame:
    """As decode_documents on files; compressed files are read as Spark reads them."""
    return decode_documents(spark.read.text(path, wholetext=not ndjson), ndjson=ndjson)


def rejected_count(documents: DataFrame) -> DataFrame:
    return documents.agg(F.count_if("rejected").alias("rejected"), F.count("*").alias("documents"))


def _combined_line(p: dict) -> Column:
    """A combined-format line that the access reader takes apart again."""
    def part(name, missing):
        return F.coalesce(p[name], F.lit(missing)) if name in p else F.lit(missing)
    return F.format_string('%s - - [-] "%s %s HTTP/%s" %s 0 "%s" "%s"', part("ip", "0.0.0.0"),
                           part("method", "GET"), part("path", "/"), part("proto", "1.1"),
                           part("status", "000"), part("referer", "-"), part("ua", "-"))


def map_ecs(documents: DataFrame, as_of, max_depth: int | None = None) -> DataFrame:
    """Log rows of ECS documents (doc), with `stored` false where nothing can be kept.

    Adds event, labels, kv (text of every value), kv_v (typed values), raw, ts and
    _ts_suspect inside kv. Each step is a projection of its own.
    """
    if max_depth is None:
        max_depth = 8 if documents.isStreaming else deepest(documents, "doc")
    typed = documents.withColumn("_typed", flatten_json(F.col("doc"), max_depth))
    flat = typed.withColumn("_flat", F.map_filter(
        F.transform_values("_typed", lambda _, v: text_of(v)), lambda _, v: v.isNotNull()))
    f = F.col("_flat")
    named = {"ip": V.ECS_IP, "path": V.ECS_PATH, "method": V.ECS_METHOD, "status": V.ECS_STATUS,
             "ua": V.ECS_AGENT, "sport": V.ECS_PORT, "referer": V.ECS_REFERER}
    found = F.struct(*[first_key(f, keys).alias(k) for k, keys in named.items()],
                     first_key(f, ["http.version"]).alias("proto"),
                     first_key(f, V.ECS_MESSAGE).alias("message"),
                     first_key(f, V.ECS_HOST).alias("host"), first_key(f, V.ECS_DATASET).alias("dataset"),
                     parse_ts(F.try_element_at(f, F.lit("@timestamp"))).alias("at"))
    staged = flat.withColumn("_f", found)
    is_request = F.col("_f.ip").isNotNull() & F.col("_f.path").isNotNull()
    staged = (staged.withColumn("_request", is_request)
              .withColumn("_clamped", clamp_ts(F.col("_f.at"), as_of)))
    claimed = claimed_keys()
    unclaimed = F.map_filter(f, lambda k, v: ~k.isin(claimed) & (v != ""))
    kept = ["ip", "path", "method", "status", "ua", "sport"]
    mapped = F.map_filter(F.create_map(*[x for k in kept for x in (F.lit(k), F.when(
        F.col("_request"), F.col(f"_f.{k}")))]), lambda _, v: v.isNotNull())
    suspect = F.map_filter(F.create_map(F.lit("_ts_suspect"), F.col("_clamped.suspect").cast("string")),
                           lambda _, v: v.isNotNull())
    rest = F.map_filter(unclaimed, lambda k, _: ~F.map_contains_key(mapped, k) & (k != "_ts_suspect"))
    labels = F.map_filter(F.create_map(F.lit("protocol"), F.lit("ecs"), F.lit("instance"), F.col("_f.host"),
                                       F.lit("source"), F.col("_f.dataset")), lambda _, v: v.isNotNull())
    line = _combined_line({k: F.col(f"_f.{k}") for k in
                           ("ip", "method", "path", "proto", "status", "referer", "ua")})
    return staged.select(
        *documents.columns,
        (F.col("_f.message").isNotNull() | F.col("_request")).alias("stored"),
        F.coalesce("_f.dataset", F.lit("unstructured")).alias("event"), labels.alias("labels"),
        F.map_concat(rest, mapped, suspect).alias("kv"),
        F.map_filter("_typed", lambda k, _: ~k.isin(claimed)).alias("kv_v"),
        F.coalesce("_f.message", F.when(F.col("_request"), line)).alias("raw"),
        F.col("_clamped.ts").alias("ts"))
