"""Hostile traffic: requests to actors, actors to campaigns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as V
from ..functions.access import with_hit
from ..functions.staging import only_where
from ..functions.techniques import (TECHNIQUES, actor_profile, actor_score, fingerprint,
                                    tactic_of, with_technique)
from ..session import cut_lineage


def access_hits(events: DataFrame, benign: str = V.DEFAULT_BENIGN_PATHS) -> DataFrame:
    """One row per request: id, timestamp, ip, path, method, status, target, technique."""
    rows = events.select("id", "timestamp", "raw", "kv",
                         F.coalesce(F.try_element_at("labels", F.lit("instance")),
                                    F.lit("unknown")).alias("target"))
    return only_where(with_technique(with_hit(rows), benign),
                      F.col("ip").isNotNull() & F.col("path").isNotNull(),
                      ["ip", "path", "method", "status", "technique"], ["id", "timestamp", "target"])


def split_internal(hits: DataFrame, internal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits of strangers, internal addresses that were left out); internal has a column ip."""
    known = internal.select("ip").distinct()
    return (hits.join(known, "ip", "left_anti"),
            hits.select("ip").distinct().join(known, "ip", "left_semi"))


def rank_key() -> Column:
    """Order of actors: score, hostile hits, then whose newest request is newest."""
    return F.struct("score", "hostile_hits", "newest")


def _distinct_paths(hits: DataFrame, max_paths: int) -> DataFrame:
    """Per ip how many distinct hostile paths there are (hostile_paths), and of the first max_paths of
    them, scanning newest first, how many (distinct_paths) and which (sample_paths, eight).

    The rank filter is applied before the shuffle as well, so each task passes on
    at most max_paths rows of an ip however many it holds.
    """
    newest = (hits.filter("technique != 'benign'").groupBy("ip", "path")
              .agg(F.max(F.struct("timestamp", "id")).alias("newest")))
    order = Window.partitionBy("ip").orderBy(F.desc("newest.timestamp"), F.desc("newest.id"))
    first = newest.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= max_paths)
    shown = first.groupBy("ip").agg(F.count("*").alias("distinct_paths"),
                                    F.slice(F.array_sort(F.collect_list("path")), 1, 8).alias("sample_paths"))
    return shown.join(newest.groupBy("ip").agg(F.count("*").alias("hostile_paths")), "ip")


def threat_actors(hits: DataFrame, min_hits: int = 1, max_paths: int = 40) -> DataFrame:
    """Actors: one row per address with at least min_hits hostile requests.

    Counting runs on (ip, status, target) first, with map-side combining, so an
    address that holds a third of all requests shrinks before it is shuffled. The
    hits are written first: counts and paths read them, and lines are parsed once.
    """
    hits = cut_lineage(hits)
    names = [t for t in TECHNIQUES]
    per = hits.groupBy("ip", "status", "target").agg(
        F.count("*").alias("n"), F.count_if(F.col("technique") == "benign").alias("benign"),
        F.min("timestamp").alias("first_seen"), F.max(F.struct("timestamp", "id")).alias("newest"),
        *[F.count_if(F.col("technique") == t).alias(f"t {t}") for t in names])

    def roll(extra):
        return [F.sum("n").alias("n"), F.sum("benign").alias("benign"),
                F.min("first_seen").alias("first_seen"), F.max("newest").alias("newest"),
                *[F.sum(f"t {t}").alias(f"t {t}") for t in names], *extra]

    by_status = per.groupBy("ip", "status").agg(*roll([F.collect_list("target").alias("targets")]))
    by_ip = by_status.groupBy("ip").agg(*roll([
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("targets")))).alias("targets"),
        F.map_from_entries(F.collect_list(F.struct("status", "n"))).alias("statuses")]))

    counted = F.map_from_entries(F.filter(
        F.array(*[F.struct(F.lit(t).alias("k"), F.col(f"t {t}").alias("v")) for t in names]),
        lambda e: e["v"] > 0))
    facts = (by_ip.withColumn("techniques", counted)
             .withColumn("hostile_hits", F.col("n") - F.col("benign"))
             .filter(F.col("hostile_hits") >= min_hits))
    named = (facts.join(_distinct_paths(hits, max_paths), "ip", "left")
             .withColumn("fingerprint", fingerprint(F.col("techniques")))
             .withColumn("profile", actor_profile(F.col("fingerprint"), F.map_keys("techniques"))))
    return named.select(
        "ip", F.col("profile.actor_id").alias("actor_id"), F.col("profile.codename").alias("actor_name"),
        F.col("profile.emoji").alias("emoji"), F.col("profile.full_name").alias("campaign_name"),
        F.col("profile.threat_tier").alias("threat_tier"), F.col("profile.tags").alias("tags"),
        F.col("n").alias("hits"), "hostile_hits", F.col("benign").alias("benign_hits"), "techniques",
        F.array_sort(F.array_distinct(F.transform(F.map_keys("techniques"), tactic_of))).alias("tactics"),
        "fingerprint", "targets", F.coalesce("distinct_paths", F.lit(0)).alias("distinct_paths"),
        F.coalesce("hostile_paths", F.lit(0)).alias("hostile_paths"),
        F.coalesce("sample_paths", F.array().cast("array<string>")).alias("sample_paths"),
        "statuses", "first_seen", F.col("newest.timestamp").alias("last_seen"), "newest",
        actor_score(F.col("techniques"), F.col("hostile_hits"), F.size("targets")).alias("score"))


def order_actors(actors: DataFrame) -> DataFrame:
    """Score, then hostile hits; after profiling the inconsistency comes first."""
    keys = [F.desc("score"), F.desc("hostile_hits"), F.desc("newest"), F.col("ip")]
    if "inconsistency" in actors.columns:
        keys = [F.coalesce("inconsistency", F.lit(0)).desc()] + keys
    return actors.orderBy(*keys)


def top_members(actors: DataFrame, group: str, k: int = 25) -> DataFrame:
    """The k highest-ranked addresses of every group, in order."""
    order = Window.partitionBy(group).orderBy(rank_key().desc(), F.col("ip"))
    ranked = (actors.select(group, "ip", "score", "hostile_hits", "newest")
              .withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k))
    return ranked.groupBy(group).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("place", "ip"))), lambda m: m["ip"]).alias("actors"))


def campaigns(actors: DataFrame) -> DataFrame:
    """Actors that share a technique fingerprint: the same tooling, whatever its address."""
    members = cut_lineage(actors.filter(~F.col("fingerprint").isin(V.NOT_A_CAMPAIGN)).select(
        "ip", "fingerprint", "score", "hostile_hits", "newest", "first_seen", "last_seen", "techniques", "targets"))
    totals = members.groupBy("fingerprint").agg(
        F.count("*").alias("actor_count"), F.sum("hostile_hits").alias("hits"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.max(F.struct(rank_key().alias("rank"), F.map_keys("techniques").alias("names"))).alias("top"))
    targets = (members.select("fingerprint", F.explode("targets").alias("target")).distinct()
               .groupBy("fingerprint").agg(F.array_sort(F.collect_list("target")).alias("targets")))
    return (totals.join(targets, "fingerprint").join(top_members(members, "fingerprint"), "fingerprint")
            .withColumn("profile", actor_profile(F.col("fingerprint"), F.col("top.names")))
            .select("fingerprint", F.col("profile.actor_id").alias("actor_id"),
                    F.col("profile.codename").alias("actor_name"), F.col("profile.emoji").alias("emoji"),
                    F.col("profile.full_name").alias("full_name"),
                    F.col("profile.threat_tier").alias("threat_tier"),
                    F.col("profile.tags").alias("tags"), "actor_count", "actors", "hits", "targets",
                    "first_seen", "last_seen"))


def order_campaigns(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("actor_count"), F.desc("hits"), "fingerprint")


def technique_totals(actors: DataFrame) -> DataFrame:
    return (actors.select(F.explode("techniques").alias("technique", "n"))
            .groupBy("technique").agg(F.sum("n").alias("hits")))


def auto_tags(mass_floor: int = 8, deception_floor: int = 40, wordlist_floor: int = 20,
              burst_floor: float = 5.0) -> Column:
    """What an actor is, from its techniques, owner and behaviour columns.

    Expects techniques, hits, org, tells, inconsistency, longest_404_run and
    peak_rate_per_s; any of the last five may be null.
    """
    has = lambda *names: reduce(lambda a, b: a | b,
                                [F.map_contains_key("techniques", t) for t in names])
    named = F.filter(F.map_keys("techniques"), lambda t: (t != "") & (t != "unknown"))
    org = F.upper(F.coalesce("org", F.lit("")))
    owned_by = lambda words: reduce(lambda a, b: a | b, [org.contains(w) for w in words])
    impostor = F.exists(F.coalesce("tells", F.array().cast("array<string>")), lambda t: (
        F.lower(t).contains("claims")
        & reduce(lambda a, b: a | b, [F.lower(t).contains(w) for w in V.CRAWLER_CLAIM_WORDS])))
    rules = [
        (F.size(named) >= mass_floor, "mass-scanner"),
        (has("rce-attempt", "webshell-probe"), "exploit-attempt"),
        (has("private-key-theft", "secret-file-harvest"), "credential-harvester"),
        (has("mcp-probe"), "mcp-hunter"),
        (F.coalesce("inconsistency", F.lit(0)) >= deception_floor, "deceptive"),
        (F.coalesce("longest_404_run", F.lit(0)) >= wordlist_floor, "wordlist-walker"),
        (F.coalesce("peak_rate_per_s", F.lit(0.0)) >= burst_floor, "burst"),
        (impostor, "crawler-impostor"),
        (owned_by(V.RESEARCH_ORGS), "research-scanner"),
        (owned_by(V.CLOUD_ORGS), "cloud-hosted"),
    ]
    tags = F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules])))
    quiet = (F.col("hits") == 1) & F.forall(named, lambda t: t == "recon")
    return F.when((F.size(tags) == 0) & quiet, F.array(F.lit("single-touch"))).otherwise(tags)


def tag_totals(actors: DataFrame) -> DataFrame:
    return (actors.select(F.explode("auto_tags").alias("tag")).groupBy("tag")
            .agg(F.count("*").alias("actors")))


def raise_reason(repeat: int = V.REPEAT_THRESHOLD, deception: int = V.DECEPTION_FLOOR,
                 score: int = V.SCORE_FLOOR) -> Column:
    """Why an actor deserves a person's attention, or null."""
    count = lambda t: F.try_element_at("techniques", F.lit(t))
    once = F.array_compact(F.array(*[F.when(count(t).isNotNull(), F.lit(t)) for t in V.ESCALATE_ONCE]))
    often = F.array_compact(F.array(*[
        F.when(count(t) >= repeat, F.concat(F.lit(f"{t} x"), count(t).cast("string")))
        for t in V.ESCALATE_REPEATED]))
    return (F.when(F.size(once) > 0, F.concat(F.lit("attempted "), F.array_join(once, ", ")))
            .when(F.size(often) > 0, F.concat(F.lit("repeated "), F.array_join(often, ", ")))
            .when(F.coalesce("inconsistency", F.lit(0)) >= deception,
                  F.concat(F.lit("claimed to be something it is not (inconsistency "),
                           F.col("inconsistency").cast("string"), F.lit(")")))
            .when(F.col("score") >= score, F.concat(F.lit("breadth of technique (score "),
                                                    F.col("score").cast("string"), F.lit(")"))))


def attach_registry(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Follow-up tags, notes and the earliest sighting from the campaign registry."""
    kept = registry.select("actor_id", F.col("followup_tags").alias("kept_tags"),
                           F.col("notes").alias("kept_notes"), F.col("first_seen").alias("kept_first"))
    joined = rows.join(kept, "actor_id", "left")
    out = [c for c in rows.columns if c not in ("first_seen", "followup_tags", "notes")]
    return joined.select(
        *out, F.least("first_seen", "kept_first").alias("first_seen"),
        F.coalesce("kept_tags", F.array().cast("array<string>")).alias("followup_tags"),
        F.coalesce("kept_notes", F.lit("")).alias("notes"))
