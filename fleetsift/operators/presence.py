"""Who is logged in where, and which logins were never seen before."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as V
from ..functions.documents import first_nonempty

KINDS = {V.LOGIN: "login", V.SESSION_OPEN: "session_open", V.SESSION_CLOSE: "session_close",
         V.SUDO: "sudo", V.SUDO_FAIL: "sudo_fail"}


def auth_records(events: DataFrame) -> DataFrame:
    """host, user, kind, src_ip, service, command, target of the auth events.

    Sessions of automated services, and rows without a host or user, are left out.
    """
    get = lambda k: F.try_element_at("kv", F.lit(k))
    kind = F.try_element_at(F.create_map(*[F.lit(x) for p in KINDS.items() for x in p]), F.col("event"))
    sudo = F.col("event").isin(V.SUDO, V.SUDO_FAIL)
    login = F.col("event") == V.LOGIN
    service = F.lower(F.coalesce(get("service"), F.lit("")))
    rows = events.filter(F.col("event").isin(V.AUTH_EVENTS)).select(
        "id", "timestamp", kind.alias("kind"),
        F.try_element_at("labels", F.lit("instance")).alias("host"),
        F.when(sudo, get("actor")).otherwise(get("user")).alias("user"),
        F.when(login, first_nonempty(get("src_ip"), get("ip"))).alias("src_ip"),
        F.when(login, F.lit("sshd")).when(sudo, F.lit("sudo"))
        .otherwise(F.nullif(service, F.lit(""))).alias("service"),
        F.when(sudo, get("command")).alias("command"),
        F.when(sudo, first_nonempty(get("target_user"), get("target_host"))).alias("target"))
    automated = F.col("kind").isin("session_open", "session_close") & F.coalesce(
        F.col("service").isin(V.AUTOMATED_SERVICES), F.lit(False))
    return rows.filter((F.col("host") != "") & (F.col("user") != "") & ~automated)


def presence(events: DataFrame) -> DataFrame:
    """One row per (host, user, src_ip) with counters, first and last sighting.

    A session or sudo has no source of its own and goes to the source its user
    logged in from most often; equal counts go to the source seen last, then to
    the highest id. Rows are counted per source before anything is joined.
    """
    counts = auth_records(events).groupBy("host", "user", "kind", "src_ip").agg(
        F.count("*").alias("n"), F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"), F.max(F.struct("timestamp", "id")).alias("newest"))
    usual = (counts.filter("kind = 'login' and src_ip is not null").groupBy("host", "user")
             .agg(F.max_by("src_ip", F.struct("n", "newest")).alias("usual_ip")))
    placed = counts.join(usual, ["host", "user"], "left").withColumn(
        "src_ip", F.when(F.col("kind") == "login", F.col("src_ip")).otherwise(F.col("usual_ip")))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    people = placed.groupBy("host", "user", "src_ip").agg(
        of("login").alias("logins"), of("session_open").alias("sessions_open"),
        of("session_close").alias("sessions_closed"), of("sudo").alias("sudo"),
        of("sudo_fail").alias("sudo_failed"), F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"))
    return people.withColumn("active", (F.col("sessions_open") > F.col("sessions_closed")) | (
        (F.col("logins") > 0) & (F.col("sessions_closed") == 0)))


def order_presence(people: DataFrame) -> DataFrame:
    return people.orderBy("host", F.desc("last_seen"), "user", "src_ip")


def new_presence(recent: DataFrame, baseline: DataFrame) -> DataFrame:
    """People of `recent` that `baseline` never saw, and what is new about them."""
    base = baseline.select("host", "user", "src_ip").distinct()
    same = ((F.col("r.host") == F.col("b.host")) & (F.col("r.user") == F.col("b.user"))
            & F.col("r.src_ip").eqNullSafe(F.col("b.src_ip")))
    unseen = recent.alias("r").join(base.alias("b"), same, "left_anti")
    known = base.select("host", "user").distinct().withColumn("known", F.lit(True))
    kind = (F.when(F.col("known").isNull(), "new-host-user")
            .when(F.col("src_ip").isNotNull(), "new-source"))
    return (unseen.join(known, ["host", "user"], "left").withColumn("kind", kind)
            .filter("kind is not null")
            .select("kind", "host", "user", "src_ip", "logins", "sudo", "first_seen", "last_seen"))


def unexpected_logins(events: DataFrame, as_of, recent_s: int, baseline_s: int = 30 * 86400) -> DataFrame:
    """new_presence of the logins of the last recent_s seconds against those before."""
    from ..functions.times import as_timestamp, seconds
    now = as_timestamp(as_of)
    logins = events.filter((F.col("event") == V.LOGIN)
                           & (F.col("timestamp") >= now - seconds(max(recent_s, baseline_s))))
    cut = now - seconds(recent_s)
    return new_presence(presence(logins.filter(F.col("timestamp") >= cut)),
                        presence(logins.filter(F.col("timestamp") < cut)))


def order_unexpected(found: DataFrame) -> DataFrame:
    return found.orderBy((F.col("kind") != "new-host-user"), F.desc("last_seen"), "host", "user", "src_ip")
