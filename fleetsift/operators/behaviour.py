"""Does a client behave like what it claims to be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.access import FIELDS, with_request
from ..functions.clients import (claims_browser, crawler_claim, crawler_verdict, is_asset,
                                 is_candid, ua_anachronism)
from ..functions.staging import only_where
from ..functions.times import clf_time, int_div
from ..session import cut_lineage
from .runs import longest_run


def client_requests(events: DataFrame) -> DataFrame:
    """One row per request, structured fields first, then the raw line.

    `at` is the line's own clock where it has one, else the row's timestamp.
    """
    rows = (with_request(events.select("id", "timestamp", "raw", "kv"))
            .withColumn("at", F.coalesce(clf_time(F.col("when")), "timestamp")))
    return only_where(rows, F.col("ip").isNotNull(), [*FIELDS, "at"], ["id", "timestamp"])


def client_agents(requests: DataFrame) -> DataFrame:
    """(ip, ua, requests): every agent string an address presented."""
    return (requests.filter("ua != ''").groupBy("ip", "ua").agg(F.count("*").alias("requests")))


def agent_lists(agents: DataFrame) -> DataFrame:
    """(ip, user_agents): the sorted list, for callers that want it in one row."""
    return agents.groupBy("ip").agg(F.array_sort(F.collect_list("ua")).alias("user_agents"))


def request_gaps(requests: DataFrame, bucket: str = "minute") -> DataFrame:
    """(ip, gap_ms, n): how often each time between neighbouring requests occurs.

    Requests of one instant collapse first. Neighbours are then found inside
    (ip, bucket) and across the edges of buckets, so no task holds a whole ip.
    """
    instants = (requests.filter("at is not null").groupBy("ip", "at").agg(F.count("*").alias("n"))
                .withColumn("bucket", F.date_trunc(bucket, "at")))
    inside = Window.partitionBy("ip", "bucket").orderBy("at")
    placed = (instants.withColumn("before", F.lag("at").over(inside))
              .withColumn("last", F.max("at").over(Window.partitionBy("ip", "bucket"))))
    follow = placed.filter("before is not null")
    first = (placed.filter("before is null")
             .withColumn("before", F.lag("last").over(Window.partitionBy("ip").orderBy("at"))))
    micros = F.unix_micros("at") - F.unix_micros("before")
    rounded = int_div(micros + 500, 1000)
    pairs = F.array(F.struct(rounded.alias("gap_ms"), F.lit(1).cast("long").alias("n")),
                    F.struct(F.lit(0).cast("long").alias("gap_ms"), (F.col("n") - 1).alias("n")))
    return (follow.unionByName(first).select("ip", F.inline(pairs))
            .filter("gap_ms is not null and n > 0")
            .groupBy("ip", "gap_ms").agg(F.sum("n").alias("n")))


def upper_median_gap(gaps: DataFrame) -> DataFrame:
    """(ip, gaps, median_gap_ms): element n div 2 of the sorted gaps, zero-based.

    Works on distinct gap lengths. Those of one ip sum to no more than its span,
    so there are at most sqrt(2 * span in ms) of them, 72,000 for thirty days.
    """
    running = Window.partitionBy("ip").orderBy("gap_ms").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("ip")
    ranked = (gaps.withColumn("upto", F.sum("n").over(running))
              .withColumn("total", F.sum("n").over(whole)))
    return (ranked.filter(F.col("upto") > int_div(F.col("total"), 2)).groupBy("ip")
            .agg(F.first("total").alias("gaps"), F.min("gap_ms").alias("median_gap_ms")))


def longest_404_run(requests: DataFrame, written: bool = False) -> DataFrame:
    """(ip, longest_404_run) in scan order: row timestamp, then id."""
    rows = requests.select(F.col("ip").alias("key"), F.col("timestamp").alias("at"), "id",
                           (F.coalesce("status", F.lit("")) == "404").alias("flag"))
    return longest_run(rows, written).select(F.col("key").alias("ip"), F.col("longest_run").alias("longest_404_run"))


def _agent_facts(requests: DataFrame) -> DataFrame:
    ua = F.col("ua")
    judged = client_agents(requests).select(
        "ip", "ua", claims_browser(ua).alias("browser"), is_candid(ua).alias("candid"),
        ua_anachronism(ua).alias("old"), crawler_claim(ua).alias("crawler"))
    return judged.groupBy("ip").agg(
        F.count("*").alias("agents"), F.min("ua").alias("first_agent"),
        F.bool_or("browser").alias("claims_browser"), F.bool_or("candid").alias("self_identified_tool"),
        F.min(F.when(F.col("old").isNotNull(), F.struct("ua", "old")))["old"].alias("anachronism"),
        F.min(F.when(F.col("crawler").isNotNull(), F.struct("ua", "crawler")))["crawler"].alias("claimed_crawler"))


def _request_facts(requests: DataFrame) -> DataFrame:
    port = F.nullif("sport", F.lit(""))
    return requests.groupBy("ip").agg(
        F.count("*").alias("requests"), F.count("at").alias("timed"),
        F.min("at").alias("first_at"), F.max("at").alias("last_at"),
        F.count(port).alias("port_seen"), F.count_distinct(port).alias("ports"), F.min(port).alias("port"),
        F.count_if(F.coalesce(~F.col("referer").isin("-", ""), F.lit(False))).alias("referers"),
        F.count_if(is_asset(F.col("path"))).alias("asset_fetches"),
        F.bool_or(F.coalesce(F.col("status").isin("200", "304"), F.lit(False))).alias("got_page"),
        F.bool_or(F.coalesce(F.col("proto") == "1.0", F.lit(False))).alias("old_protocol"))


def _methods(requests: DataFrame) -> DataFrame:
    return (requests.filter("method != ''").select("ip", "method").distinct().groupBy("ip")
            .agg(F.array_sort(F.collect_list("method")).alias("methods")))


def _seconds(micros: Column) -> Column:
    return micros / F.lit(1e6)


def _tells() -> Column:
    """Ordered reasons; %-style numbers follow the usual float formatting."""
    honest = F.col("self_identified_tool")
    posing = F.col("claims_browser") & ~honest
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    num = lambda c: F.col(c).cast("string")
    whole = F.col("port_seen") == F.col("requests")
    checks = [
        (posing & F.col("got_page") & (F.col("asset_fetches") == 0),
         F.lit("claims a browser but never fetched an asset after a 200 -- nothing was rendered")),
        (posing & (F.col("requests") > 5) & (F.col("referers") == 0),
         F.lit("claims a browser but sent no Referer on any request")),
        (F.col("anachronism").isNotNull() & ~honest, F.col("anachronism")),
        (F.col("crawler_verified") == F.lit(False), F.col("crawler_reason")),
        (F.col("crawler_verified"), text("verified ", F.col("claimed_crawler"), " (reverse DNS confirms)")),
        (honest & F.col("claimed_crawler").isNull(),
         text("identifies itself as tooling (", F.left("first_agent", F.lit(60)), ")")),
        (F.col("agents") > 1, text("presented ", num("agents"), " different User-Agents from one address")),
        ((F.col("agents") == 0) & (F.col("requests") > 20),
         F.lit("no User-Agent recorded on this port -- see nginx for the claim")),
        (F.col("rate") >= 2, F.format_string("%.1f requests/second sustained over %.0fs -- scripted",
                                             F.col("rate"), F.col("span"))),
        ((F.col("median_gap_ms") <= 250) & (F.col("gaps") >= 8),
         F.format_string("median gap %.2fs between requests -- no human read anything",
                         F.col("median_gap_ms") / F.lit(1000.0))),
        ((F.col("ports") == 1) & (F.col("port_seen") >= 10),
         text(F.when(whole, text("all ", num("port_seen"), " requests")).otherwise(
             text(num("port_seen"), " of ", num("requests"), " requests")),
             " on ONE connection (port ", F.col("port"), ") -- keep-alive pipelining")),
        (F.col("longest_404_run") >= 20,
         text(num("longest_404_run"), " consecutive 404s without stopping -- walking a wordlist")),
        (F.col("old_protocol"), F.lit("HTTP/1.0 -- older than any current browser")),
    ]
    return F.array_compact(F.array(*[F.when(cond, reason) for cond, reason in checks]))


def _inconsistency() -> Column:
    """The claim against the conduct; a tool that says so scores nothing for it."""
    posing = F.col("claims_browser") & ~F.col("self_identified_tool")
    points = lambda cond, n: F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)
    return (points(posing & F.col("got_page") & (F.col("asset_fetches") == 0), 40)
            + points(posing & (F.col("requests") > 5) & (F.col("referers") == 0), 20)
            + points(posing & (F.col("rate") >= 2), 20)
            + points(posing & (F.col("longest_404_run") >= 20), 20)
            + points(posing & F.col("anachronism").isNotNull(), 30)
            + points(F.col("crawler_verified") == F.lit(False), 60))


def behaviour_profiles(requests: DataFrame, rdns: DataFrame | None = None) -> DataFrame:
    """One profile per address; rdns (ip, rdns) lets crawler claims be checked.

    Agent strings are judged once per distinct (ip, agent). The full list of
    agents is in client_agents; it can be as long as a client cares to make it.
    The requests are written to the shared folder first: five steps read them,
    and the lines are parsed once.
    """
    requests = cut_lineage(requests)
    gaps = upper_median_gap(request_gaps(requests))
    joined = (_request_facts(requests)
              .join(_agent_facts(requests), "ip", "left").join(gaps, "ip", "left")
              .join(longest_404_run(requests, written=True), "ip", "left").join(_methods(requests), "ip", "left"))
    if rdns is None:
        joined = joined.withColumn("rdns", F.lit(None).cast("string"))
    else:
        joined = joined.join(rdns.select("ip", "rdns"), "ip", "left")
    span = _seconds(F.unix_micros("last_at") - F.unix_micros("first_at"))
    facts = (joined.withColumns({
        "agents": F.coalesce("agents", F.lit(0)),
        "claims_browser": F.coalesce("claims_browser", F.lit(False)),
        "self_identified_tool": F.coalesce("self_identified_tool", F.lit(False)),
        "methods": F.coalesce("methods", F.array().cast("array<string>")),
        "gaps": F.coalesce("gaps", F.lit(0)),
        "span": F.coalesce(span, F.lit(0.0)),
        "verdict": crawler_verdict(F.col("claimed_crawler"), F.col("rdns"))})
        .withColumns({
            "rate": F.when(F.col("span") > 0, F.col("timed") / F.col("span")).otherwise(0.0),
            "crawler_verified": F.col("verdict.verified"),
            "crawler_reason": F.col("verdict.reason")}))
    return facts.select(
        "ip", "requests", F.round("span", 1).alias("span_seconds"),
        F.round("rate", 2).alias("peak_rate_per_s"), "gaps", "median_gap_ms",
        (F.col("median_gap_ms") / F.lit(1000.0)).alias("median_gap_s"),
        F.nullif("ports", F.lit(0)).alias("connections"), F.col("agents").alias("user_agent_count"),
        "claims_browser", "self_identified_tool", "asset_fetches", "referers", "longest_404_run",
        "methods", _tells().alias("tells"), "claimed_crawler", "crawler_verified",
        _inconsistency().cast("long").alias("inconsistency"),
        F.col("anachronism").isNotNull().alias("anachronistic_ua"))
