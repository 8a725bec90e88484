"""Attack techniques: naming a path, scoring and naming an actor."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V

TACTICS = {name: tactic for name, tactic, _ in V.TECHNIQUE_RULES}
TECHNIQUES = list(TACTICS) + ["unknown"]


def _collapse_slashes(path: Column) -> Column:
    """Repeated slashes become one in the path, never in the query string."""
    head = F.substring_index(path, "?", 1)
    return F.concat(F.regexp_replace(head, "/{2,}", "/"),
                    F.substr(path, F.length(head) + F.lit(1)))


def technique_of(path: Column, benign: str = V.DEFAULT_BENIGN_PATHS) -> Column:
    """Technique of a request path: 'benign' and 'unknown' are answers too."""
    return _technique_of_clean(_collapse_slashes(path), benign)


def with_technique(df: DataFrame, benign: str = V.DEFAULT_BENIGN_PATHS) -> DataFrame:
    """Adds technique; the cleaned path is a projection of its own, computed once."""
    return (df.withColumn("_clean", _collapse_slashes(F.col("path")))
            .withColumn("technique", _technique_of_clean(F.col("_clean"), benign)).drop("_clean"))


def _technique_of_clean(clean: Column, benign: str) -> Column:
    chain = (F.when(clean.isNull() | (clean == ""), F.lit("unknown"))
             .when(clean.rlike(f"(?i){benign}") | clean.rlike(f"(?i){V.ALWAYS_BENIGN_PATHS}"),
                   F.lit("benign")))
    for name, _, pattern in V.TECHNIQUE_RULES:
        chain = chain.when(clean.rlike(f"(?i){pattern}"), F.lit(name))
    return chain.otherwise(F.lit("unknown"))


def tactic_of(technique: Column) -> Column:
    pairs = dict(TACTICS, benign="none", unknown="unknown")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), technique)


def classify_path(path: Column, benign: str = V.DEFAULT_BENIGN_PATHS) -> Column:
    """struct(technique, tactic)."""
    technique = technique_of(path, benign)
    return F.struct(technique.alias("technique"), tactic_of(technique).alias("tactic"))


def fingerprint(techniques: Column) -> Column:
    """Named techniques of a technique -> count map, sorted and joined with '+'."""
    return F.array_join(F.array_sort(F.filter(F.map_keys(techniques), lambda t: t != "unknown")), "+")


def threat_tier(names: Column) -> Column:
    have = lambda wanted: F.arrays_overlap(names, F.array(*[F.lit(t) for t in wanted]))
    return (F.when(have(V.CRITICAL_TIER), "CRITICAL")
            .when(have(V.HIGH_TIER), "HIGH")
            .when(F.exists(names, lambda t: t != "recon"), "ELEVATED")
            .otherwise("RECON"))


def actor_profile(mark: Column, techniques: Column) -> Column:
    """Stable identity of a technique fingerprint.

    struct(actor_id, codename, emoji, full_name, threat_tier, tags); the tier is
    taken from the given technique names, 'unknown' included.
    """
    digest = F.sha2(mark, 256)
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    pick = lambda words, i: F.element_at(F.array(*[F.lit(w) for w in words]), (i + 1).cast("int"))
    adjective = F.pmod(number, F.lit(len(V.CODENAME_ADJECTIVES)))
    noun = F.pmod(F.shiftright(number, 6), F.lit(len(V.CODENAME_NOUNS)))
    known = mark != ""
    actor_id = F.when(known, F.concat(F.lit("ACTOR-"), F.upper(F.substring(digest, 1, 4)))
                      ).otherwise(V.UNKNOWN_ACTOR_ID)
    codename = F.when(known, F.concat_ws(" ", pick(V.CODENAME_ADJECTIVES, adjective),
                                         pick(V.CODENAME_NOUNS, noun))).otherwise(V.UNKNOWN_ACTOR_NAME)
    emoji = F.when(known, F.concat(pick(V.ADJECTIVE_EMOJI, adjective), pick(V.NOUN_EMOJI, noun))
                   ).otherwise(V.UNKNOWN_ACTOR_EMOJI)
    tags = F.array_sort(F.array_distinct(F.filter(techniques, lambda t: (t != "") & (t != "unknown"))))
    return F.struct(
        actor_id.alias("actor_id"), codename.alias("codename"), emoji.alias("emoji"),
        F.concat(emoji, F.lit(" "), codename, F.lit(" ("), actor_id, F.lit(")")).alias("full_name"),
        F.when(known, threat_tier(techniques)).otherwise("LOW").alias("threat_tier"),
        F.when(known, tags).otherwise(F.array().cast("array<string>")).alias("tags"))


def actor_score(techniques: Column, hostile: Column, n_targets: Column) -> Column:
    """Breadth first: weight per technique, then volume, then hosts touched."""
    weights = F.create_map(*[F.lit(x) for kv in V.TECHNIQUE_WEIGHTS.items() for x in kv])
    breadth = F.aggregate(F.map_keys(techniques), F.lit(0), lambda acc, t: acc + F.coalesce(
        F.try_element_at(weights, t), F.lit(V.DEFAULT_TECHNIQUE_WEIGHT)))
    volume = F.floor(F.least(hostile, F.lit(50)) / 5)
    return (breadth + volume + 10 * (n_targets - 1)).cast("bigint")


def ruleset_version(rules=V.TECHNIQUE_RULES) -> str:
    """12 hex digits that change with any rule, its name or its place."""
    text = "|".join(f"{name}:{pattern}" for name, _, pattern in rules)
    return hashlib.sha256(text.encode()).hexdigest()[:12]
