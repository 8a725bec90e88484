"""Nested documents as flat maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V

OBJECT_AS_MAP = "map<string,variant>"


def is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", OBJECT_AS_MAP).isNotNull()


def nesting(v: Column) -> Column:
    """How deep the objects of a VARIANT lie in each other (an upper bound where lists hold objects)."""
    braces = F.regexp_replace(F.regexp_replace(v.cast("string"), r'"(\\.|[^"\\])*"', ""), "[^{}]", "")
    steps = F.aggregate(F.split(braces, ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda acc, c: F.struct(
        (acc["now"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("now"),
        F.greatest(acc["most"], acc["now"] + F.when(c == "{", 1).otherwise(0)).alias("most")))
    return F.coalesce(steps["most"], F.lit(0))


def deepest(documents: DataFrame, column: str) -> int:
    """The deepest nesting in a column of documents, at least 1: what flatten_json needs to open them all."""
    return max(1, documents.agg(F.max(nesting(F.col(column)))).first()[0] or 1)


def flatten_json(v: Column, max_depth: int = 8) -> Column:
    """A VARIANT object as MAP<STRING, VARIANT> with dotted keys.

    Lists and empty objects are values, keys that already hold dots pass through.
    Objects nested deeper than max_depth stay values; `deepest` tells how much is needed.
    """
    def describe(key, value):
        """key, value and what is inside it, so each value is opened once."""
        inside = F.map_entries(F.try_variant_get(value, "$", OBJECT_AS_MAP))
        return F.struct(key.alias("key"), value.alias("value"), inside.alias("inside"))

    def open_one(e):
        opened = F.transform(e["inside"], lambda i: describe(F.concat(e["key"], F.lit("."), i["key"]), i["value"]))
        return F.when(F.coalesce(F.size(e["inside"]), F.lit(0)) > 0, opened).otherwise(F.array(e))

    entries = F.transform(F.map_entries(F.try_variant_get(v, "$", OBJECT_AS_MAP)),
                          lambda e: describe(e["key"], e["value"]))
    for _ in range(max_depth - 1):
        entries = F.flatten(F.transform(entries, open_one))
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], e["value"])))


def text_of(v: Column) -> Column:
    """A variant as text: strings bare, everything else as JSON; null stays null."""
    return v.cast("string")


def first_nonempty(*cols: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in cols])


def first_key(m: Column, keys: list[str]) -> Column:
    """First non-empty value among the keys of a string map."""
    return first_nonempty(*[F.try_element_at(m, F.lit(k)) for k in keys])


def claimed_keys() -> list[str]:
    """Structured-event keys that are mapped by name and so leave the open map."""
    return (V.ECS_AGENT + V.ECS_IP + V.ECS_PATH + V.ECS_METHOD + V.ECS_STATUS + V.ECS_REFERER
            + V.ECS_PORT + V.ECS_HOST + V.ECS_DATASET + V.ECS_CLAIMED_ALSO)
