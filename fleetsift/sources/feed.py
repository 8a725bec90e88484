"""Bodies from files, batch or stream, with ids that hold: the same file gives the same rows however it is read.

A row's place is its file, the block of the file it was read from, and its number within that block. A block is
read by one task from its start, so the number needs no shuffle and is the same on a stream, in a batch and
after a restart. Rows of one body are told apart by their place in the body. Entries of a log stream carry their
own identity (time, labels, line), so that one that is delivered twice is the same row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.documents import is_object, text_of
from ..functions.times import ns_to_ts
from .lines import DEFAULT_LABELS

#: What a feed may hold: plain lines, JSON bodies with lines, log-stream payloads, ECS documents.
KINDS = ("text", "json", "streams", "ecs")
BODY = "file string, block long, place long, body string"


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each (file, block) numbered in the order in which they come."""
    last, n = None, 0
    for batch in batches:
        files, blocks = batch.column(0), batch.column(1)
        keys = list(zip(files.dictionary_encode().indices.to_pylist(), blocks.to_pylist()))
        edges = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]] + [len(keys)]
        places = np.empty(len(keys), np.int64)
        for a, b in zip(edges, edges[1:]):
            here = (files[a].as_py(), keys[a][1])
            n = n if here == last else 0
            places[a:b] = np.arange(n, n + b - a)
            last, n = here, n + b - a
        yield pa.RecordBatch.from_arrays([files, blocks, pa.array(places), batch.column(2)], ["file", "block", "place", "body"])


def read_bodies(spark: SparkSession, path: str, stream: bool = False, whole: bool = False, files_per_trigger: int | None = None) -> DataFrame:
    """(file, block, place, body) of the lines under path, or of its whole files. Compressed files are read as Spark reads them."""
    reader = spark.readStream if stream else spark.read
    if stream and files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    text = reader.option("wholetext", whole).format("text").load(path)
    return text.select(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), "value").mapInArrow(_number, BODY)


def _label_map(labels: dict | None) -> Column:
    pairs = DEFAULT_LABELS | (labels or {})
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _over(defaults: Column, own: Column) -> Column:
    return F.map_concat(F.map_filter(defaults, lambda k, _: ~F.map_contains_key(own, k)), own)


def _text_key(labels: Column) -> Column:
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(labels))))


def read_feed(bodies: DataFrame, kind: str, labels: dict | None = None) -> DataFrame:
    """(id, kind, ts, raw, doc, labels, reason, body) of bodies: lines with raw, ECS documents with doc, and what was refused.

    reason says why a body or an element gives nothing (`not JSON`, `no stream`, `short entry`, `no object`); body is
    kept for those only. Blank lines are nothing. Labels given here are defaults under a body's own.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {', '.join(KINDS)}")
    own, here = _label_map(labels), F.xxhash64("file", "block", "place")
    text = bodies.where(F.trim(F.regexp_replace(F.coalesce("body", F.lit("")), r"^\s+|\s+$", "")) != "")
    none = lambda t: F.lit(None).cast(t)

    def row(id, ts, raw, doc, labels, reason):
        return F.struct(id.alias("id"), ts.cast("timestamp").alias("ts"), raw.cast("string").alias("raw"), doc.alias("doc"),
                        labels.alias("labels"), reason.cast("string").alias("reason"))

    if kind == "text":
        return _rows(text, F.array(row(here, none("timestamp"), F.col("body"), none("variant"), own, none("string"))), kind)
    parsed = text.withColumn("v", F.try_parse_json("body")).withColumn("here", here)
    get = lambda path, t="variant": F.try_variant_get("v", path, t)
    refuse = lambda why: F.array(row(F.col("here"), none("timestamp"), none("string"), none("variant"), own, F.lit(why)))
    if kind == "json":
        items = F.coalesce(get("$", "array<variant>"), get("$.lines", "array<variant>"), F.array("v"))
        mine = _over(own, F.coalesce(get("$.labels", "map<string,string>"), F.expr("cast(map() AS map<string,string>)")))
        line = lambda v: F.coalesce(F.try_variant_get(v, "$.line", "string"), F.when(is_object(v), F.to_json(v)).otherwise(text_of(v)))
        rows = F.transform(F.col("items"), lambda v, k: row(F.xxhash64("here", k), none("timestamp"), line(v), none("variant"), F.col("mine"), none("string")))
        parsed = parsed.withColumn("items", items).withColumn("mine", mine)
    elif kind == "streams":
        shape = "array<struct<stream:map<string,string>,values:array<array<string>>>>"
        found = F.from_json(F.to_json(F.coalesce(get("$.streams"), get("$.data.result"))), shape)
        entry = lambda s, e: _entry(s, e, own, row, none)
        each = F.flatten(F.transform(F.col("found"), lambda s: F.transform(F.coalesce(s["values"], F.expr("array()").cast("array<array<string>>")), lambda e: entry(s, e))))
        parsed = parsed.withColumn("found", found)
        rows = F.when(F.col("found").isNull(), refuse("no stream")).otherwise(each)
    else:
        items = F.coalesce(get("$", "array<variant>"), F.array("v"))
        parsed = parsed.withColumn("items", items)
        rows = F.transform(F.col("items"), lambda v, k: row(F.xxhash64("here", k), none("timestamp"), none("string"), v, own,
                                                            F.when(~F.coalesce(is_object(v), F.lit(False)), "no object")))
    return _rows(parsed, F.when(F.col("v").isNull(), refuse("not JSON")).otherwise(rows), kind)


def _entry(stream: Column, entry: Column, own: Column, row, none) -> Column:
    labels = _over(own, F.coalesce(stream["stream"], F.expr("cast(map() AS map<string,string>)")))
    ns, line = F.get(entry, F.lit(0)).try_cast("bigint"), F.get(entry, F.lit(1))
    bad = F.when((F.size(entry) < 2) | ns.isNull(), "short entry")
    return row(F.xxhash64(ns, _text_key(labels), line), F.when(bad.isNull(), ns_to_ts(ns)), F.when(bad.isNull(), line), none("variant"), labels, bad)


def _rows(found: DataFrame, each: Column, kind: str) -> DataFrame:
    """Exploded where it is made: of a column made before, Spark would ask first whether it is empty, and make it twice."""
    rows = found.select("body", F.explode(each).alias("r")).select(F.lit(kind).alias("kind"), "r.*", "body")
    kept = rows.where(F.col("reason").isNotNull() | F.col("doc").isNotNull() | (F.trim(F.coalesce("raw", F.lit(""))) != ""))
    return kept.select("id", "kind", "ts", "raw", "doc", "labels", "reason", F.when(F.col("reason").isNotNull(), F.col("body")).alias("body"))
