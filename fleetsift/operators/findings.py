"""Findings: detections with a state, and the campaign registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..functions.lines import finding_key
from ..functions.techniques import ruleset_version
from ..functions.times import as_timestamp
from ..schema import CAMPAIGN_ACTOR, FINDING
from .threats import raise_reason


def threat_findings(actors: DataFrame, detail: list[str] | None = None) -> DataFrame:
    """Detections (kind, subject, instance, severity_hint, evidence) for actors worth raising."""
    if "inconsistency" not in actors.columns:
        actors = actors.withColumn("inconsistency", F.lit(None).cast("long"))
    reason = raise_reason()
    high = F.arrays_overlap(F.map_keys("techniques"), F.array(*[F.lit(t) for t in V.ESCALATE_ONCE]))
    detail = detail or [c for c in actors.columns if c not in ("newest",)]
    evidence = F.to_json(F.struct(F.col("reason"), F.lit(ruleset_version()).alias("ruleset"), *detail))
    return (actors.withColumn("reason", reason).filter("reason is not null")
            .select(F.lit("threat_actor").alias("kind"), F.col("ip").alias("subject"),
                    F.coalesce(F.get("targets", F.lit(0)), F.lit("unknown")).alias("instance"),
                    F.when(high, "high").otherwise("medium").alias("severity_hint"),
                    "reason", evidence.alias("evidence")))


def login_findings(unexpected: DataFrame) -> DataFrame:
    """Detections for logins nobody has seen before."""
    source = F.coalesce("src_ip", F.lit("unknown source"))
    reason = F.format_string("%s: %s on %s from %s", F.col("kind"), F.col("user"), F.col("host"), source)
    evidence = F.to_json(F.struct("reason", *unexpected.columns))
    return (unexpected.withColumn("reason", reason)
            .select(F.lit("unexpected_login").alias("kind"),
                    F.concat("user", F.lit("@"), F.coalesce("src_ip", F.lit("?"))).alias("subject"),
                    F.col("host").alias("instance"),
                    F.when(F.col("kind") == "new-host-user", "high").otherwise("medium").alias("severity_hint"),
                    "reason", evidence.alias("evidence")))


def upsert_findings(findings: DataFrame, detections: DataFrame, as_of) -> DataFrame:
    """Findings after a batch of detections.

    A detection raises a new finding or bumps the one with its key. Dismissed and
    actioned findings keep their state, every other state returns to new. When a
    batch holds several detections of one key, the last by evidence order wins
    (detections may carry `seq` to order them).
    """
    now = as_timestamp(as_of)
    seq = F.col("seq") if "seq" in detections.columns else F.lit(0)
    last, first = F.struct(seq.alias("seq"), "evidence"), F.struct(seq.alias("seq"), "severity_hint")
    batch = (detections.withColumn("fingerprint", finding_key(F.col("kind"), F.col("subject"), F.col("instance")))
             .groupBy("fingerprint").agg(
                 F.first("kind").alias("kind"), F.first("subject").alias("subject"),
                 F.nullif(F.first("instance"), F.lit("")).alias("instance"),
                 F.min(first)["severity_hint"].alias("severity_hint"),
                 F.max(last)["evidence"].alias("evidence"), F.count("*").alias("n")))
    f, d = findings.alias("f"), batch.alias("d")
    old, hit = F.col("f.fingerprint").isNotNull(), F.col("d.fingerprint").isNotNull()
    keep = lambda c: F.when(old, F.col(f"f.{c}"))
    values = {
        "fingerprint": F.coalesce("f.fingerprint", "d.fingerprint"),
        **{c: F.when(old, F.col(f"f.{c}")).otherwise(F.col(f"d.{c}"))
           for c in ("kind", "subject", "instance", "severity_hint")},
        "evidence": F.when(hit, F.col("d.evidence")).otherwise(F.col("f.evidence")),
        "state": (F.when(~hit | F.col("f.state").isin(V.STICKY_STATES), F.col("f.state"))
                  .otherwise(F.lit("new"))),
        **{c: keep(c) for c in ("verdict", "severity", "rationale", "recommended_action", "reviewer")},
        "occurrences": F.coalesce("f.occurrences", F.lit(0)) + F.coalesce("d.n", F.lit(0)),
        "first_seen": F.coalesce("f.first_seen", now),
        "last_seen": F.when(hit, now).otherwise(F.col("f.last_seen")),
        "triaged_at": keep("triaged_at"),
    }
    joined = f.join(d, F.col("f.fingerprint") == F.col("d.fingerprint"), "full_outer")
    return joined.select(*[values[c.name].cast(c.dataType).alias(c.name) for c in FINDING])


def empty_findings(spark) -> DataFrame:
    return spark.createDataFrame([], FINDING)


def list_findings(findings: DataFrame, state=None, kind=None, limit: int = 50) -> DataFrame:
    """New ones first, then the most recent."""
    rows = findings.drop("evidence")
    if state:
        rows = rows.filter(F.col("state") == state)
    if kind:
        rows = rows.filter(F.col("kind") == kind)
    return (rows.orderBy((F.col("state") == "new").desc(), F.desc("last_seen"), "fingerprint")
            .limit(int(limit)))


def get_finding(findings: DataFrame, key: str) -> DataFrame:
    """The whole row, evidence included."""
    return findings.filter(F.col("fingerprint") == key)


def split_verdicts(verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a reason): a known verdict and a rationale of 10 characters."""
    problem = (F.when(~F.coalesce(F.col("verdict").isin(V.VERDICTS), F.lit(False)),
                      F.lit(f"verdict must be one of {', '.join(V.VERDICTS)}"))
               .when(F.length(F.trim(F.coalesce("rationale", F.lit("")))) < 10,
                     F.lit("rationale is required and must explain the judgement")))
    judged = verdicts.withColumn("problem", problem)
    return judged.filter("problem is null").drop("problem"), judged.filter("problem is not null")


def apply_verdicts(findings: DataFrame, verdicts: DataFrame, as_of) -> DataFrame:
    """Findings with the accepted verdicts (fingerprint, verdict, rationale, reviewer,
    severity, recommended_action) written in. Nothing is carried out."""
    accepted, _ = split_verdicts(verdicts)
    v = accepted.alias("v")
    hit = F.col("v.fingerprint").isNotNull()
    state = F.when(F.col("v.verdict").isin(V.DISMISSING_VERDICTS), "dismissed").otherwise("triaged")
    new = {"verdict": F.col("v.verdict"), "rationale": F.trim("v.rationale"), "reviewer": F.col("v.reviewer"),
           "severity": F.coalesce("v.severity", "f.severity", "f.severity_hint"),
           "recommended_action": F.col("v.recommended_action"), "state": state,
           "triaged_at": as_timestamp(as_of)}
    joined = findings.alias("f").join(v, F.col("f.fingerprint") == F.col("v.fingerprint"), "left")
    return joined.select(*[
        (F.when(hit, new[c]).otherwise(F.col(f"f.{c}")) if c in new else F.col(f"f.{c}")).alias(c)
        for c in findings.columns])


def unknown_verdict_keys(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts on findings that do not exist."""
    return verdicts.join(findings, "fingerprint", "left_anti")


def findings_summary(findings: DataFrame) -> DataFrame:
    """Rows (state, n) plus what is waiting: awaiting and oldest_new on the new row."""
    return findings.groupBy("state").agg(
        F.count("*").alias("n"), F.count_if(F.col("state") == "new").alias("awaiting"),
        F.min(F.when(F.col("state") == "new", F.col("first_seen"))).alias("oldest_new"))


# ---- campaign registry --------------------------------------------------------

def list_campaign_actors(registry: DataFrame, limit: int = 100) -> DataFrame:
    return registry.orderBy(F.desc("last_seen"), "actor_id").limit(limit)


def tag_campaign_actors(registry: DataFrame, tags: DataFrame, as_of) -> DataFrame:
    """Registry after follow-up tags, at most one row per actor_id in `tags`.

    On a known actor the follow-up tags are replaced; notes, codename and emoji
    only if given; tier, fingerprint and tags stay.
    """
    now = as_timestamp(as_of)
    r, t = registry.alias("r"), tags.alias("t")
    old, hit = F.col("r.actor_id").isNotNull(), F.col("t.actor_id").isNotNull()

    def text(name: str, missing: str) -> Column:
        given = F.nullif(F.coalesce(f"t.{name}", F.lit("")), F.lit(""))
        given = F.nullif(given, F.lit(missing)) if missing else given
        return F.coalesce(given, f"r.{name}", F.lit(missing))

    fixed = lambda name, missing: F.when(old, F.col(f"r.{name}")).otherwise(
        F.coalesce(f"t.{name}", missing))
    no_tags = F.array().cast("array<string>")
    values = {
        "actor_id": F.coalesce("r.actor_id", "t.actor_id"),
        "codename": text("codename", "UNKNOWN"), "emoji": text("emoji", ""), "notes": text("notes", ""),
        "fingerprint": fixed("fingerprint", F.lit("")), "threat_tier": fixed("threat_tier", F.lit("ELEVATED")),
        "tags": fixed("tags", no_tags),
        "followup_tags": F.when(hit, F.coalesce("t.followup_tags", no_tags)).otherwise(F.col("r.followup_tags")),
        "first_seen": F.coalesce("r.first_seen", now),
        "last_seen": F.when(hit, now).otherwise(F.col("r.last_seen")),
    }
    joined = r.join(t, F.col("r.actor_id") == F.col("t.actor_id"), "full_outer")
    return joined.select(*[values[c.name].cast(c.dataType).alias(c.name) for c in CAMPAIGN_ACTOR])
