"""Rules from lines no rule knows: skeletons, clusters, synthesis, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as V
from ..functions.staging import only_where, with_value
from ..session import cut_lineage
from .templates import covers

# Word characters and digits count beyond ASCII, as in the rule language.
UNICODE = "(?U)"


def skeleton(raw: Column) -> Column:
    """The line with everything that varies masked, in fixed order."""
    for pattern, mask in V.SKELETON_MASKS:
        raw = _masked(raw, pattern, mask)
    return raw


#: Characters without which a mask's pattern finds nothing, by its start; other masks are always tried.
_NEEDED = {r"\b\d{4}-": "-", r"\[": "[", r"\b(?:\d{1,3}\.)": ".", r"\b(?:[0-9a-fA-F]{2}:)": ":", "(?:/": "/", '"[^"]*"|': "\"'",
           r"\b([A-Za-z_][A-Za-z0-9_]*)=": "="}


def _masked(raw: Column, pattern: str, mask: str) -> Column:
    needed = next((chars for start, chars in _NEEDED.items() if pattern.startswith(start)), None)
    if needed is None:
        return F.regexp_replace(raw, UNICODE + pattern, mask)

    def mask_where(line):
        found = line.contains(needed[0])
        for char in needed[1:]:
            found = found | line.contains(char)
        return F.when(found, F.regexp_replace(line, UNICODE + pattern, mask)).otherwise(line)

    return with_value(raw, mask_where)


def cluster_skeletons(lines: DataFrame, threshold: int = V.CLUSTER_THRESHOLD) -> DataFrame:
    """(skeleton, n, emitted, samples) of lines (id, timestamp, raw).

    A cluster is emitted each time it fills, so n div threshold times; samples are
    its first lines. They are picked by rank before the shuffle as well as after,
    so a skeleton shared by a third of all lines stays small. Lines are masked once and
    written to the shared folder, from where they are counted and picked.
    """
    masked = cut_lineage(lines.select("id", "timestamp", "raw", skeleton(F.col("raw")).alias("skeleton")))
    counts = masked.groupBy("skeleton").agg(F.count("*").alias("n")).filter(F.col("n") >= threshold)
    order = Window.partitionBy("skeleton").orderBy("timestamp", "id")
    first = masked.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= threshold)
    samples = first.groupBy("skeleton").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("place", "raw"))), lambda s: s["raw"]).alias("samples"))
    return (counts.join(samples, "skeleton")
            .withColumn("emitted", F.call_function("div", F.col("n"), F.lit(threshold))))


def _tokens(skel: Column) -> Column:
    return F.regexp_extract_all(skel, F.lit("(<[A-Z]+>|[^<]+|<)"), 1)


def _event_name(skel: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(skel, "<[A-Z]+>", ""), r"[^a-zA-Z0-9_\s]", " ")
    words = F.filter(F.split(F.trim(bare), r"\s+"), lambda w: (F.length(w) > 1) & ~w.rlike(r"^\d+$")
                     & ~F.lower(w).isin(V.UNINFORMATIVE_WORDS))
    tags = F.array_distinct(F.transform(F.regexp_extract_all(skel, F.lit("<([A-Z]+)>"), 1), F.lower))
    return (F.when(F.size(words) > 0, F.array_join(F.transform(F.slice(words, 1, 4), F.lower), "_"))
            .when(F.size(tags) > 0, F.concat(F.lit("shape_"), F.array_join(F.slice(tags, 1, 4), "_"))))


def _tag_regex(tag: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for t, p in V.SKELETON_TAGS.items()
                                           for x in (f"<{t}>", p)]), tag)


def _group_name(tokens: Column, tag: Column, i: Column) -> Column:
    before = F.size(F.filter(F.slice(tokens, F.lit(1), i + 1), lambda t: t == tag))
    base = F.lower(F.regexp_replace(tag, "[<>]", ""))
    return F.when(before > 1, F.concat_ws("_", base, before.cast("string"))).otherwise(base)


def _pattern(skel: Column) -> Column:
    tokens = _tokens(skel)
    escaped = lambda t: F.regexp_replace(t, r"([()\[\]{}?*+\-|^$\\.&~#\s])", r"\\$1")
    piece = lambda t, i: F.coalesce(
        F.concat(F.lit("(?P<"), _group_name(tokens, t, i), F.lit(">"), _tag_regex(t), F.lit(")")), escaped(t))
    return F.array_join(F.transform(tokens, piece), "")


def _fields(skel: Column) -> Column:
    tokens = _tokens(skel)
    names = F.transform(tokens, lambda t, i: F.when(_tag_regex(t).isNotNull(), _group_name(tokens, t, i)))
    return F.array_sort(F.array_compact(names))


def synthesize_rules(clusters: DataFrame) -> DataFrame:
    """Candidate rules (event, pattern, fields) of clusters (skeleton, samples).

    Literals are escaped and every tag becomes a named group; a skeleton that
    names nothing, or a pattern under five characters, gives no candidate.
    """
    skel = F.col("skeleton")
    made = (clusters.withColumn("event", _event_name(skel)).withColumn("pattern", _pattern(skel))
            .withColumn("fields", _fields(skel)))
    # A filter would be taken down to the lines below the clusters, and make a rule of each.
    return only_where(made, F.col("event").isNotNull() & (F.length(F.trim("pattern")) >= 5), ["event", "pattern", "fields"], clusters.columns)


def validate_rules(candidates: DataFrame, written_by_model: bool = False) -> DataFrame:
    """Candidates whose pattern covers all samples but at most one, and at least one.

    A pattern written by a model must also match neither negative control.
    """
    java = F.concat(F.lit(UNICODE), F.regexp_replace("pattern", r"\(\?P<\w+>", "("))  # word characters as in Python
    judged = candidates.withColumn("_java", java).withColumn(
        "matched", F.size(F.filter("samples", lambda s: covers(s, F.col("_java")))))
    keep = F.col("matched") >= F.greatest(F.lit(1), F.size("samples") - 1)
    if written_by_model:
        for control in V.NEGATIVE_CONTROLS:
            keep &= ~F.regexp_like(F.lit(control), F.col("_java"))
    return judged.filter(keep).drop("_java")
