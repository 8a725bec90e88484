"""The registered queries: every operator on tables derived from the given ones."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession, functions as F

from fleetsift import fixed_values as V
from fleetsift.functions import access, clients, documents, lines as L, techniques as TQ, times, values
from fleetsift.operators import (alerts, anomaly, behaviour as B, findings as N, flows as FL, graph as G,
                                 mining, ownership as O, presence as P, search as S, templates as TP,
                                 threats as T)
from fleetsift.plans import ingest, metrics
from fleetsift.plans.threat_view import sweep as findings_sweep, threat_view
from fleetsift.schema import CAMPAIGN_ACTOR
from fleetsift.session import cut_lineage, scratch_path
from fleetsift.sources import ecs, events as EV, lines as LN, topology as TY, value_index as VI

from .derived import PATHS, events_table, log

AS_OF = "2024-01-31 00:00:00"
us = lambda c: F.unix_micros(c)
csv = lambda c: F.array_join(c, ",")


_events = events_table


def last_instant(spark: SparkSession, d: str, plus_s: int = 0) -> str:
    """The compressed clock's last moment, as text."""
    row = (spark.read.parquet(f"{d}/events.parquet").agg(F.max("event_id").alias("m"))
           .select((F.timestamp_micros(F.lit(1704067200000000) + F.col("m") * 100000 + plus_s * 1000000)).cast("string")).first())
    return row[0]


def _rows(df):
    return df.select("id", us("timestamp").alias("at_us"), "event", "instance", "raw")


# ---- search ---------------------------------------------------------------------

def search_value(s, d):
    return _rows(S.search_logs(log(s, d), 50, value="198.51.100.8", since_s=20 * 86400, as_of=AS_OF))


_INDEXES: dict[tuple, VI.ValueIndex] = {}


def value_index(s, d) -> VI.ValueIndex:
    """The log in two appends and its index, brought up to date after each."""
    key = (s.sparkContext.applicationId, d)
    if key not in _INDEXES:
        table, half = scratch_path(s, "indexed-log"), F.lit("2024-01-15 00:00:00").cast("timestamp")
        EV.write_events(log(s, d).where(F.col("timestamp") < half).drop("instance", "source", "event_date"), table)
        index = VI.ValueIndex(s, table, scratch_path(s, "value-index"))
        index.refresh()
        EV.write_events(log(s, d).where(F.col("timestamp") >= half).drop("instance", "source", "event_date"), table)
        index.refresh()
        _INDEXES[key] = index
    return _INDEXES[key]


def search_value_indexed(s, d):
    return _rows(value_index(s, d).search(50, value="198.51.100.8", since_s=20 * 86400, as_of=AS_OF))


def search_field_indexed(s, d):
    return _rows(value_index(s, d).search(30, kv="user:u3"))


def search_port_indexed(s, d):
    return _rows(value_index(s, d).search(200000, port=443, process="nginx"))


def count_values_indexed(s, d):
    """How many rows of a week hold each of some addresses."""
    index = value_index(s, d)
    parts = [index.count(value=v, since_s=7 * 86400, as_of=AS_OF).select(F.lit(v).alias("term"), "matched")
             for v in ("198.51.100.8", "198.51.100.21", "203.0.113.1")]
    return parts[0].union(parts[1]).union(parts[2])


def search_text(s, d):
    return _rows(S.search_logs(log(s, d), 40, q="WP-login"))


def search_field(s, d):
    return _rows(S.search_logs(log(s, d), 30, kv="user:u3"))


def search_port_process(s, d):
    return _rows(S.search_logs(log(s, d), 200000, port=443, process="nginx"))


def search_window(s, d):
    return _rows(S.search_logs(log(s, d), 1000, event="nginx_access", instance="host-2", source="nginx",
                               start_time="2024-01-05 00:00:00", end_time="2024-01-12 12:00:00"))


def search_by_shape(s, d):
    rows = log(s, d)
    parts = [S.count_logs(rows, **S.auto_filter(term)).select(F.lit(term).alias("term"), "matched")
             for term in ("198.51.100.8", "process:sshd", "phpinfo")]
    return parts[0].union(parts[1]).union(parts[2])


def count_text(s, d):
    return S.count_logs(log(s, d), q="HTTP/1.1", since_s=7 * 86400, as_of=AS_OF)


def search_truncation(s, d):
    return S.search_with_truncation(log(s, d), 100, q="HTTP/1.1")


def recent_logins(s, d):
    return _rows(S.recent(log(s, d), V.LOGIN, 25))


def network_rows(s, d):
    return _rows(S.network_events(log(s, d), ip="198.51.100.8"))


def network_dns(s, d):
    return _rows(S.network_events(log(s, d), protocol="dns", instance="host-1", limit=300))


def instances(s, d):
    return S.instances(log(s, d), AS_OF)


# ---- threats ----------------------------------------------------------------------

def technique_counts(s, d):
    hits = T.access_hits(log(s, d))
    return (hits.groupBy("technique", TQ.tactic_of(F.col("technique")).alias("tactic"), "method", "status")
            .agg(F.count("*").alias("n"), F.count_distinct("ip").alias("ips")))


def _actor_columns(actors):
    pairs = lambda m: csv(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"]))))
    return actors.select(
        "ip", "actor_id", "actor_name", "threat_tier", "hits", "hostile_hits", "benign_hits",
        pairs("techniques").alias("techniques"), csv("tactics").alias("tactics"), "fingerprint",
        csv("targets").alias("targets"), F.col("distinct_paths").cast("long").alias("distinct_paths"),
        csv("sample_paths").alias("sample_paths"), pairs("statuses").alias("statuses"),
        us("first_seen").alias("first_us"), us("last_seen").alias("last_us"), "score")


def threat_actors(s, d):
    return _actor_columns(T.threat_actors(T.access_hits(log(s, d))))


def actor_hostile_paths(s, d):
    return T.threat_actors(T.access_hits(log(s, d)), max_paths=3).select("ip", "hostile_paths")


def actor_paths_capped(s, d):
    actors = T.threat_actors(T.access_hits(log(s, d)), min_hits=20, max_paths=5)
    return actors.select("ip", F.col("distinct_paths").cast("long").alias("distinct_paths"),
                         csv("sample_paths").alias("sample_paths"), "score")


def _day_actors(s, d):
    """Actors by address and day, so that fingerprints differ."""
    hits = T.access_hits(log(s, d))
    day = F.date_format("timestamp", "dd")
    return T.threat_actors(hits.withColumn("ip", F.concat_ws("/", "ip", day)))


def campaigns(s, d):
    return T.campaigns(_day_actors(s, d)).select(
        "fingerprint", "actor_id", "actor_name", "threat_tier", "actor_count", csv("actors").alias("actors"),
        "hits", csv("targets").alias("targets"), us("first_seen").alias("first_us"), us("last_seen").alias("last_us"))


def technique_totals(s, d):
    return T.technique_totals(_day_actors(s, d))


def internal_addresses_left_out(s, d):
    strangers, excluded = T.split_internal(T.access_hits(log(s, d)), fleet(s).internal_addresses())
    return (strangers.groupBy("ip").agg(F.count("*").alias("hits"))
            .unionByName(excluded.withColumn("hits", F.lit(-1).cast("long"))))


ORGS = ["DIGITALOCEAN-ASN", "CENSYS-ARIN-01", "Example Hosting", "Test University"]


def owner_table(s, d):
    """Ownership by address, derived from the addresses in the log; some are not known."""
    n = F.substring_index("ip", ".", -1).cast("int")
    ips = T.access_hits(log(s, d)).select("ip").distinct()
    return ips.filter(n % 9 != 8).select(
        "ip", F.when(n % 7 == 6, "NA").otherwise(F.concat(F.lit("AS"), (64500 + n % 4).cast("string"))).alias("asn"),
        F.concat(F.lit("198.51.100."), (n - n % 8).cast("string"), F.lit("/29")).alias("prefix"),
        F.when(n % 2 == 0, "NL").otherwise("US").alias("country"), F.lit("ripencc").alias("registry"),
        F.lit("2012-01-01").alias("allocated"),
        F.element_at(F.array(*[F.lit(o) for o in ORGS]), n % 4 + 1).alias("org"))


def rdns_table(s, d):
    n = F.substring_index("ip", ".", -1).cast("int")
    return T.access_hits(log(s, d)).select("ip").distinct().select(
        "ip", F.when(n % 10 == 2, F.concat(F.lit("crawl-"), n.cast("string"), F.lit(".googlebot.com")))
        .when(n % 10 == 7, F.concat(F.lit("host-"), n.cast("string"), F.lit(".example.net."))).alias("rdns"))


def owners(s, d):
    actors = O.attach_owner(T.threat_actors(T.access_hits(log(s, d))), owner_table(s, d), rdns_table(s, d))
    return O.owners(actors).select(
        F.coalesce("asn", F.lit("unknown")).alias("asn"), "org", "country", "actor_count",
        csv("actors").alias("actors"), "hits", csv("prefixes").alias("prefixes"), csv("techniques").alias("techniques"))


def owner_by_prefix(s, d):
    ips = T.access_hits(log(s, d)).select("ip").distinct()
    n = F.substring_index("ip", ".", -1).cast("int")
    block = lambda size, bits: ips.select(F.concat(F.lit("198.51.100."), (n - n % size).cast("string"),
                                                   F.lit(f"/{bits}")).alias("prefix")).distinct()
    blocks = (block(8, 29).filter("prefix != '198.51.100.8/29'").union(block(16, 28)).union(block(256, 24))
              .withColumn("asn", F.concat(F.lit("AS-"), "prefix")))
    for c in ("country", "registry", "allocated", "org"):
        blocks = blocks.withColumn(c, F.lit("x"))
    return O.owners_by_prefix(ips, blocks).select("ip", "asn", "prefix")


# ---- behaviour -----------------------------------------------------------------------

def _profile_columns(p):
    return p.select(
        "ip", "requests", F.col("gaps").cast("long").alias("gaps"), "median_gap_ms", "longest_404_run",
        F.col("connections").cast("long").alias("connections"), F.col("user_agent_count").cast("long").alias("agents"),
        F.col("claims_browser").cast("int").alias("browser"), F.col("self_identified_tool").cast("int").alias("tool"),
        "asset_fetches", "referers", csv("methods").alias("methods"), "claimed_crawler",
        F.col("crawler_verified").cast("int").alias("verified"), "inconsistency",
        F.col("anachronistic_ua").cast("int").alias("old"), F.size("tells").cast("long").alias("tells"))


def behaviour_profiles(s, d):
    return _profile_columns(B.behaviour_profiles(B.client_requests(log(s, d, "compressed")), rdns_table(s, d)))


def request_gaps(s, d):
    return B.request_gaps(B.client_requests(log(s, d)))


def longest_404_runs(s, d):
    return B.longest_404_run(B.client_requests(log(s, d)))


def client_claims(s, d):
    agents = B.client_agents(B.client_requests(log(s, d)))
    ua = F.col("ua")
    return agents.groupBy("ua").agg(F.sum("requests").alias("requests")).select(
        "ua", "requests", clients.claims_browser(ua).cast("int").alias("browser"),
        clients.is_candid(ua).cast("int").alias("candid"), clients.crawler_claim(ua).alias("crawler"),
        clients.ua_anachronism(ua).alias("old"))


def _view(s, d, **kw):
    registry = registry_table(s, d)
    return threat_view(log(s, d, "compressed"), fleet(s), owner_table(s, d), rdns_table(s, d), registry, **kw)


def threat_view_actors(s, d):
    v = _view(s, d)
    return v.actors.select("ip", "hits", "score", "inconsistency", "org", csv("auto_tags").alias("auto_tags"),
                           csv("followup_tags").alias("followup_tags"), "notes", us("first_seen").alias("first_us"))


def threat_view_tags(s, d):
    return _view(s, d).tag_totals


def threat_view_scan_all(s, d):
    return _view(s, d).scanned


def threat_view_scan(s, d):
    return _view(s, d, limit=500).scanned


# ---- findings -------------------------------------------------------------------------

def raise_reasons(s, d):
    return N.threat_findings(_day_actors(s, d)).select("subject", "instance", "severity_hint", "reason")


def _half_findings(s, d):
    """Findings after the first fifteen days, and the detections of all thirty."""
    rows = log(s, d)
    early = T.threat_actors(T.access_hits(rows.filter("timestamp < '2024-01-16'")))
    late = T.threat_actors(T.access_hits(rows))
    brief = ["ip", "score"]
    found = N.upsert_findings(N.empty_findings(s), N.threat_findings(early, brief), "2024-01-16 00:00:00")
    return found, N.threat_findings(late, brief)


def _verdicts(findings):
    n = F.substring_index("subject", ".", -1).cast("int")
    return findings.select(
        "fingerprint", F.element_at(F.array(*[F.lit(v) for v in V.VERDICTS + ["maybe"]]), n % 6 + 1).alias("verdict"),
        F.when(n % 5 == 4, "short").otherwise("seen before on this fleet").alias("rationale"),
        F.lit("sam").alias("reviewer"), F.when(n % 3 == 0, "low").alias("severity"),
        F.lit(None).cast("string").alias("recommended_action"))


def findings_upserted(s, d):
    found, again = _half_findings(s, d)
    judged = N.apply_verdicts(found, _verdicts(found), "2024-01-20 00:00:00")
    return N.upsert_findings(judged, again, AS_OF).select(
        "fingerprint", "kind", "subject", "instance", "severity_hint", "state", "verdict", "severity",
        "rationale", "occurrences", us("first_seen").alias("first_us"), us("last_seen").alias("last_us"),
        us("triaged_at").alias("triaged_us"))


def findings_listed(s, d):
    found, _ = _half_findings(s, d)
    judged = N.apply_verdicts(found, _verdicts(found), "2024-01-20 00:00:00")
    return N.list_findings(judged, kind="threat_actor", limit=15).select("fingerprint", "subject", "state")


def findings_summed(s, d):
    found, _ = _half_findings(s, d)
    judged = N.apply_verdicts(found, _verdicts(found), "2024-01-20 00:00:00")
    return N.findings_summary(judged).select("state", "n", "awaiting", us("oldest_new").alias("oldest_us"))


def finding_evidence(s, d):
    found, _ = _half_findings(s, d)
    key = L.finding_key(F.lit("threat_actor"), F.lit("198.51.100.4"), F.lit("host-0"))
    return found.filter(F.col("fingerprint") == key).select(
        "subject", F.get_json_object("evidence", "$.reason").alias("reason"),
        F.get_json_object("evidence", "$.score").alias("score"))


def rejected_verdicts(s, d):
    found, _ = _half_findings(s, d)
    return N.split_verdicts(_verdicts(found))[1].groupBy("verdict", "problem").agg(F.count("*").alias("n"))


def registry_table(s, d):
    """A registry holding some of the log's campaigns, with earlier sightings."""
    actors = T.threat_actors(T.access_hits(log(s, d)))
    tags = actors.groupBy("actor_id", "actor_name").agg(F.count("*").alias("n")).select(
        "actor_id", F.col("actor_name").alias("codename"), F.lit("").alias("emoji"), F.lit("").alias("fingerprint"),
        F.lit("HIGH").alias("threat_tier"), F.array().cast("array<string>").alias("tags"),
        F.array(F.lit("watch"), F.concat(F.lit("seen-"), F.col("n").cast("string"))).alias("followup_tags"),
        F.lit("keep an eye on it").alias("notes"))
    return N.tag_campaign_actors(s.createDataFrame([], CAMPAIGN_ACTOR), tags, "2023-12-01 00:00:00")


def campaign_registry(s, d):
    first = registry_table(s, d)
    again = first.filter(F.col("followup_tags")[1] != "seen-1").select(
        "actor_id", F.lit(None).cast("string").alias("codename"), F.lit("*").alias("emoji"),
        F.lit("other").alias("fingerprint"), F.lit("LOW").alias("threat_tier"), "tags",
        F.array(F.lit("block")).alias("followup_tags"), F.lit("").alias("notes"))
    return N.list_campaign_actors(N.tag_campaign_actors(first, again, AS_OF), 1000).select(
        "actor_id", "codename", "emoji", "fingerprint", "threat_tier", csv("followup_tags").alias("followup_tags"),
        "notes", us("first_seen").alias("first_us"), us("last_seen").alias("last_us"))


# ---- presence -------------------------------------------------------------------------

def presence(s, d):
    return P.presence(log(s, d)).select(
        "host", "user", "src_ip", "logins", "sessions_open", "sessions_closed", "sudo", "sudo_failed",
        F.col("active").cast("int").alias("active"), us("first_seen").alias("first_us"), us("last_seen").alias("last_us"))


def unexpected_logins(s, d):
    return P.unexpected_logins(log(s, d), AS_OF, 6 * 86400).select(
        "kind", "host", "user", "src_ip", "logins", "sudo", us("last_seen").alias("last_us"))


def login_findings(s, d):
    return N.login_findings(P.unexpected_logins(log(s, d), AS_OF, 6 * 86400)).select(
        "kind", "subject", "instance", "severity_hint", "reason")


def sweep(s, d):
    found = findings_sweep(log(s, d, "compressed"), N.empty_findings(s), last_instant(s, d), fleet(s),
                           owner_table(s, d), rdns_table(s, d), window_s=600, presence_window_s=300)
    return found.select("kind", "subject", "instance", "severity_hint", "state", "occurrences")


# ---- anomalies and alerts -----------------------------------------------------------------

def rate_windows(s, d):
    return anomaly.rate_windows(log(s, d, "compressed"), last_instant(s, d)).select(
        "instance", "event", "total", "count_1m", "minutes", F.round("z_score", 6).alias("z"))


def rate_spikes(s, d):
    return anomaly.rate_spikes(log(s, d, "compressed"), last_instant(s, d), min_count=5, min_z=1.0,
                               min_ratio=0.0).select("instance", "event", "count_1m", "minutes")


def rate_series(s, d):
    return anomaly.rate_series(log(s, d, "compressed")).select(
        "instance", "event", us("minute").alias("minute_us"), "count_1m", "total", "minutes", F.round("z_score", 6).alias("z"))


def unstructured_surges(s, d):
    return anomaly.unstructured_surges(log(s, d, "compressed"), last_instant(s, d), min_total=20, min_ratio=5.0,
                                       min_count=1).select("instance", "total_1m", "count_1m", F.round("ratio", 6).alias("ratio"))


def _ticks(s, d):
    ticks = anomaly.anomaly_ticks(log(s, d, "compressed"))
    return anomaly.hysteresis(ticks, raise_z=1.0, clear_z=0.0, min_count=3, min_buckets=5, min_ratio=0.0,
                              raise_share=7.0, clear_share=5.0, min_total=20, min_surge=3)


def anomaly_states(s, d):
    return _ticks(s, d).select("kind", "instance", "event", us("tick").alias("tick_us"), "n",
                               F.col("active").cast("int").alias("active"))


def anomaly_alerts(s, d):
    return alerts.anomaly_alerts(_ticks(s, d), "2024-01-01 00:00:00", warmup_s=300, cooldown_s=300)


def _unit_lines(s, d):
    """Unit reports derived from events: every purchase reports a unit, some of them failed."""
    unit = F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string"), F.lit(".service"))
    state = F.when(F.col("event_id") % 3 == 0, "active").otherwise("failed")
    return _events(s, d).filter("event_type = 'purchase'").select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("timestamp"),
        F.create_map(F.lit("instance"), F.concat(F.lit("host-"), (F.col("user_id") % 6).cast("string"))).alias("labels"),
        F.concat(F.lit("unitwatch unit="), unit, F.lit(" scope=system active="), state, F.lit(" sub=dead")).alias("raw"),
        F.lit("unit_report").alias("event"))


def unit_alerts(s, d):
    return alerts.with_cooldown(alerts.failed_units(_unit_lines(s, d)), V.UNIT_COOLDOWN_SECONDS)


def critical_lines(s, d):
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("kernel: Out of memory: killed process "), F.col("user_id").cast("string"))
                  ).when(F.col("event_type") == "view", F.lit("panicking is not a panics")).otherwise("all is well")
    rows = _events(s, d).select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("timestamp"), text.alias("raw"),
        F.create_map(F.lit("instance"), F.concat(F.lit("host-"), (F.col("user_id") % 6).cast("string"))).alias("labels"),
        F.lit("kernel").alias("event"))
    return alerts.critical_lines(rows).groupBy("instance").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


# ---- graph ---------------------------------------------------------------------------------

_FLEETS: dict[str, TY.Topology] = {}


def fleet(s) -> TY.Topology:
    """The declared topology, built and measured once per session."""
    key = s.sparkContext.applicationId
    if key not in _FLEETS:
        _FLEETS[key] = _declared_fleet(s)
    return _FLEETS[key]


def _declared_fleet(s) -> TY.Topology:
    nodes = s.createDataFrame([
        ("hub", "collector", "server", "10.0.0.250", ["192.0.2.10"], "collects"),
        ("hub:ingest", None, "service", None, None, None), ("hub:dnsmasq", None, "service", None, None, None),
        ("host-0", None, None, "10.0.0.10", None, None), ("host-1", None, "server", "10.0.0.11", None, None),
        ("host-2", None, "server", "10.0.0.12", ["10.0.0.12"], None), ("host-3", None, "workstation", None, ["10.0.0.13"], None),
        ("host-0:sshd", None, "service", None, None, None), ("host-1:nginx", None, "service", None, None, None),
        ("gw", None, "gateway", "198.51.100.3", None, None)], TY.NODE)
    edges = s.createDataFrame([
        ("host-0", "hub:ingest", "http", "telemetry_ingest", 2.0), ("host-1", "hub:ingest", "http", "telemetry_ingest", 1.0),
        ("host-2", "hub:ingest", "http", "telemetry_ingest", 1.0), ("10.0.0.13", "hub:ingest", "http", None, None),
        ("host-1", "gw", "tcp", "socket", 2.0), ("gw", "host-0:sshd", "tcp", "port_22", 0.5),
        ("hub", "gw", "dns", "dns_query", 0.0)], TY.EDGE)
    return TY.topology_of(s, nodes, edges, "hub")


def observed_flows(s, d):
    return (FL.observe_flows(log(s, d, "compressed"), fleet(s)).groupBy("source", "target", "protocol", "channel")
            .agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.max("port").cast("long").alias("port")))


def history_flows(s, d):
    return (FL.extract_flows(log(s, d, "compressed"), fleet(s)).groupBy("source", "target", "protocol", "channel")
            .agg(F.count("*").alias("n"), F.max("port").cast("long").alias("port"), F.max("process").alias("process")))


def _edges(s, d, plus_s=0):
    flows = FL.observe_flows(log(s, d, "compressed"), fleet(s))
    return G.build_edges(flows, fleet(s), last_instant(s, d, plus_s))


def edges(s, d):
    return _edges(s, d).select(
        "edge_id", "channel", F.col("port").cast("long").alias("port"), F.col("is_declared").cast("int").alias("declared"),
        "expected_min_rate", "total_volume", "total_bytes", "rate_1m", "bytes_1m",
        F.round(F.col("bytes_per_sec") * 100).cast("long").alias("bytes_per_sec_x100"),
        F.round(F.col("baseline_15m") * 100).cast("long").alias("baseline_x100"), us("last_seen").alias("last_us"))


def topology_shifts(s, d):
    return G.topology_shifts(_edges(s, d), last_instant(s, d), min_rate=10, min_z=0.0, min_ratio=1.0, heavy=1.0,
                             drop=0.5).select("edge_id", "type", "severity", "rate_1m")


def silent_links(s, d):
    late = 130
    return G.topology_shifts(_edges(s, d, late), last_instant(s, d, late)).select("edge_id", "type", "severity", "rate_1m")


def node_states(s, d):
    late = 130
    e = _edges(s, d, late)
    judged = G.judge_edges(e, last_instant(s, d, late))
    return G.node_status(G.graph_nodes(e, fleet(s)), judged).select(
        "id", "type", F.col("declared").cast("int").alias("declared"), "status")


def _tables(s, d):
    e = cut_lineage(_edges(s, d))
    return cut_lineage(G.graph_nodes(e, fleet(s))), e


def subgraph(s, d):
    nodes, e = _tables(s, d)
    near, inside = G.subgraph(nodes, e, "198.51.100.3", fleet(s), depth=2)
    return near.select("id", F.col("hops").cast("long").alias("hops"))


def subgraph_edges(s, d):
    nodes, e = _tables(s, d)
    return G.subgraph(nodes, e, "198.51.100.5", fleet(s), depth=1)[1].select("edge_id", "total_volume")


def subgraph_search(s, d):
    _, e = _tables(s, d)
    flows = FL.extract_flows(log(s, d, "compressed"), fleet(s))
    return G.search_subgraph(e, fleet(s), flows, port=22, protocol="TCP", instance="host-1").select(
        "edge_id", "protocol", "channel", "total_volume", F.col("is_declared").cast("int").alias("declared"))


def subgraph_search_reach(s, d):
    _, e = _tables(s, d)
    found = G.search_subgraph(e, fleet(s), protocol="tcp", instance="host-2", depth=2)
    return G.subgraph_counts(found)


def host_flows(s, d):
    return G.host_flow_summary(G.host_flows(_edges(s, d), "host-1")).select(
        "direction", "flows", "rate", F.round(F.col("bytes_per_sec") * 100).cast("long").alias("bytes_x100"),
        csv("processes").alias("processes"))


def time_lapse(s, d):
    flows = FL.extract_flows(log(s, d, "compressed"), fleet(s))
    return G.time_lapse(flows, last_instant(s, d), 900, 9).select(
        F.col("slice_index").cast("long").alias("slice_index"), "total_edges", "new_edges", "total_volume",
        F.round(F.col("bytes_per_sec") * 100).cast("long").alias("bytes_x100"))


def retired_externals(s, d):
    nodes, e = _tables(s, d)
    rare = e.withColumn("total_volume", F.when(F.col("target").contains("d1"), 1).otherwise(F.col("total_volume")))
    return G.retire_externals(nodes, rare, "2024-01-02 00:00:00")[2]


def dangling_edges(s, d):
    nodes, e = _tables(s, d)
    kept, dropped = G.prune_dangling(nodes.filter("not id like 'external:198%'"), e)
    return kept.select("edge_id", F.lit("kept").alias("fate")).union(dropped.select("edge_id", F.lit("dropped")))


def folded_addresses(s, d):
    nodes, e = _tables(s, d)
    ip_map = cut_lineage(nodes.filter("id like 'external:198.51.100.1%'").select(
        F.substring_index("id", ":", -1).alias("ip"), F.lit("gw").alias("node_id")))
    n2, e2 = G.fold_addresses(nodes, e, ip_map)
    return (n2.filter("declared").select(F.concat(F.lit("node "), "id").alias("item"), F.size("ips").cast("long").alias("n"))
            .union(e2.agg(F.count("*").alias("n")).select(F.lit("edges"), "n")))


def merged_history(s, d):
    declared = G.build_edges(FL.observe_flows(log(s, d, "compressed"), fleet(s)).limit(0), fleet(s), last_instant(s, d))
    return G.merge_history(declared, _edges(s, d)).select(
        "edge_id", "total_volume", "rate_1m", F.round(F.col("baseline_15m") * 100).cast("long").alias("baseline_x100"),
        F.col("is_declared").cast("int").alias("declared"))


def graph_summary(s, d):
    late = 130
    e = _edges(s, d, late)
    return G.graph_summary(G.graph_nodes(e, fleet(s)), e, G.topology_shifts(e, last_instant(s, d, late)))


def graph_filtered(s, d):
    nodes, e = _tables(s, d)
    return (G.filter_graph(nodes, type="external").select(F.lit("external").alias("kind"), "id")
            .union(G.filter_graph(e, status="HEALTHY", source="host-1").select(F.lit("edge"), "edge_id")))


def fleet_metrics(s, d):
    rows = log(s, d, "compressed")
    now = last_instant(s, d)
    nodes, e = _tables(s, d)
    accounts = EV.ingest_accounting(_statuses(s, d))
    totals = anomaly.rate_windows(rows, now).groupBy("instance").agg(F.sum("total").alias("n"))
    spikes = anomaly.rate_spikes(rows, now, min_count=5, min_z=1.0, min_ratio=0.0)
    found = metrics.fleet_metrics(accounts, base_rules(s), totals, spikes, nodes, e,
                                  G.topology_shifts(e, now))
    return found.groupBy("metric").agg(F.count("*").alias("series"), F.round(F.sum("value"), 0).cast("long").alias("total"))


# ---- templates ---------------------------------------------------------------------------

RULES = [
    ("socket_line", r"netsnap proto=(?P<proto>\w+) state=(?P<state>\w+) local=(?P<local>[\d.]+) local_port=(?P<local_port>\d+) "
                    r"peer=(?P<peer>[\d.]+) peer_port=(?P<peer_port>\d+) process=(?P<process>\S+) pid=(?P<pid>\d+)"),
    ("key_accepted", r"Accepted publickey for (?P<user>\w+) from (?P<src>[\d.]+) port (?P<port>\d+) ssh2"),
    ("too_short", r"(?P<ip>\d+\.\d+\.\d+\.\d+)"),
    ("auth_line", r"auth event for (?P<user>\w+) on (?P<host>[\w-]+) seq (?P<seq>\d+)"),
    ("any_info", r"INFO:\s+(?P<client>[\d.:]+) - .*"),
]


def base_rules(s):
    rows = [(i, e, p, [], 0, None, "base") for i, (e, p) in enumerate(RULES)]
    return s.createDataFrame(rows, "priority long, event string, pattern string, fields array<string>, "
                                   "hit_count long, created_at timestamp, origin string")


def _matched(s, d):
    rules = TP.read_rules(base_rules(s))
    return TP.match_templates(log(s, d).select("id", "timestamp", "raw", "labels"), rules)


def matched_lines(s, d):
    m = _matched(s, d)
    get = lambda k: F.try_element_at("kv", F.lit(k))
    return m.groupBy("event", get("process").alias("process"), get("user").alias("user"),
                     F.array_join(F.array_sort(F.map_keys("kv")), ",").alias("keys")).agg(
        F.count("*").alias("n"), F.min(get("ip")).alias("min_ip"), F.max(get("ip")).alias("max_ip"))


def many_rules():
    """A rule for every address, path and status of the log, with one general rule at place 1000."""
    rules = [(f"u{a}_{p}_{status}", rf'INFO:\s+(?P<ip>198\.51\.100\.{a}):(?P<port>\d+) - "GET (?P<path>{re.escape(path)}) HTTP/1\.1" (?P<status>{status})(?: (?P<word>\w+))?')
             for a in range(40) for p, path in enumerate(PATHS) for status in ("404", "304", "200")]
    return rules[:1000] + [("any_304", r'INFO:\s+(?P<ip>[\d.]+):.* HTTP/1\.1" 304 \w+')] + rules[1000:]


def matched_lines_many_rules(s, d):
    m = TP.match_templates(log(s, d).select("id", "timestamp", "raw", "labels"), [TP.Rule.of(e, p) for e, p in many_rules()])
    done = F.when(F.array_contains(F.map_values("kv"), "Done"), 1).otherwise(0)
    return m.groupBy("event").agg(F.count("*").alias("n"), F.sum(done).alias("done"))


def template_usage(s, d):
    return TP.template_usage(_matched(s, d), base_rules(s)).select("event", "hits")


def _learned(s, d):
    """Candidate rules made from the data: one per kind of event, named alike on purpose."""
    kinds = _events(s, d).groupBy("event_type").agg(F.min("event_id").alias("seq"))
    return kinds.select(
        F.col("seq"), F.when(F.col("event_type").isin("view", "click"), "auth_line").otherwise("new_line").alias("event"),
        F.when(F.col("event_type") == "signup", F.lit(RULES[1][1])).otherwise(
            F.concat(F.col("event_type"), F.lit(" (?P<n>\\d+)"))).alias("pattern"),
        F.array(F.lit("n")).alias("fields"), F.lit(None).cast("timestamp").alias("created_at"))


def added_rules(s, d):
    return TP.add_rules(base_rules(s), _learned(s, d)).select("event", "pattern", "origin")


def loaded_rules(s, d):
    learned = _learned(s, d).withColumn("event", F.concat_ws("-", "event", "seq")).select(
        F.col("seq").alias("priority"), "event", "pattern", "fields", F.lit(0).cast("long").alias("hit_count"),
        "created_at", F.lit("runtime").alias("origin"))
    return TP.load_rules(base_rules(s), learned).select("event", "origin", "priority")


def merged_rules(s, d):
    learned = _learned(s, d).select(
        F.col("seq").alias("priority"), "event", "pattern", "fields", F.lit(0).cast("long").alias("hit_count"),
        "created_at", F.lit("runtime").alias("origin"))
    return TP.merge_rules(base_rules(s), learned).select("event", "pattern", F.col("merged").cast("int").alias("merged"))


def skeletons(s, d):
    return log(s, d).groupBy(mining.skeleton(F.col("raw")).alias("skeleton")).agg(F.count("*").alias("n"))


def clusters(s, d):
    return mining.cluster_skeletons(log(s, d)).select(
        "skeleton", "n", F.col("emitted").cast("long").alias("emitted"), F.array_join("samples", "|").alias("samples"))


def document_skeletons(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").select(
        F.col("doc_id").alias("id"), F.lit(0).cast("timestamp").alias("timestamp"), F.explode(F.split("text", "\n")).alias("raw"))
    return mining.cluster_skeletons(docs.filter("raw != ''")).select("skeleton", "n")


def synthesized_rules(s, d):
    made = mining.synthesize_rules(mining.cluster_skeletons(log(s, d)))
    return mining.validate_rules(made).select("event", "pattern", csv("fields").alias("fields"),
                                              F.col("matched").cast("long").alias("matched"))


# ---- fields and documents -----------------------------------------------------------------

def _shaped(c):
    """Values of many shapes out of one event."""
    k = F.regexp_extract("props", "[0-9]+", 0)
    n = F.col("user_id").cast("string")
    return F.array(
        F.concat(F.lit("10.0.0."), n), F.concat(F.lit("10.1.0."), n, F.lit(":"), k), F.concat(F.lit("/var/log/"), n),
        F.concat(k, F.lit("ms")), F.concat(k, F.lit(" KB")), F.concat(F.lit("web"), n, F.lit(".example.com")),
        F.concat(F.lit("http://x/"), k), k, F.concat(k, F.lit(".5")), F.concat(F.lit("web-"), n),
        F.concat(F.lit("00:11:22:33:44:"), F.lpad(F.substring(k, 1, 2), 2, "0")), F.concat(F.lit("dead"), F.lpad(k, 4, "0")),
        F.concat(F.lit("two words "), k), F.lit(""), F.concat(F.lit("fe80::"), k))


def value_shapes(s, d):
    v = _events(s, d).select(F.explode(_shaped(None)).alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    return v.select("v", "n", values.classify_value(F.col("v")).alias("shape"))


def normalized_fields(s, d):
    k = F.regexp_extract("props", "[0-9]+", 0)
    n = F.col("user_id").cast("string")
    kv = F.create_map(F.lit("remote_addr"), F.concat(F.lit("10.0.0."), n), F.lit("src"), F.concat(F.lit("10.1.0."), n, F.lit(":"), k),
                      F.lit("hostname"), F.concat(F.lit("web-"), n), F.lit("took"), F.concat(k, F.lit("ms")),
                      F.lit("pid"), k, F.lit("remote_ip"), F.concat(F.lit("10.9.9."), k))
    # Exploded where it is made: of a column made before, Spark would take "not empty" down to the scan and make it twice.
    return _events(s, d).select("event_id", F.explode(values.normalize_fields(kv)).alias("key", "value"))


def _ecs_docs(s, d, where: str = "true"):
    """ECS documents out of the events: nested for even ids, dotted for odd ones, some unusable."""
    n, k = F.col("user_id").cast("string"), F.regexp_extract("props", "[0-9]+", 0)
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    ip, path = F.concat(F.lit("198.51.100."), n), F.concat(F.lit("/p/"), k)
    nested = F.to_json(F.struct(
        stamp.alias("@timestamp"), F.struct(F.concat(F.lit("host-"), n).alias("name")).alias("host"),
        F.struct(F.lit("web.access").alias("dataset"), F.col("event_type").alias("action")).alias("event"),
        F.struct(ip.alias("ip"), (F.col("user_id") + 40000).alias("port")).alias("source"),
        F.struct(path.alias("path")).alias("url"),
        F.struct(F.struct(F.lit("GET").alias("method")).alias("request"),
                 F.struct(F.lit(404).alias("status_code")).alias("response")).alias("http"),
        F.array(F.lit("a"), k).alias("tags")))
    dotted = F.concat(F.lit('{"@timestamp":'), F.when(F.col("event_id") % 5 == 0, F.lit("4102444800000")).otherwise(
        F.concat(F.lit('"'), stamp, F.lit('"'))), F.lit(',"host.hostname":"h'), n, F.lit('","message":"line '), k,
        F.lit('","process.pid":'), k, F.lit("}"))
    bad = F.lit("[1]")
    useless = F.concat(F.lit('{"only":'), k, F.lit("}"))
    body = (F.when(F.col("event_id") % 10 == 7, bad).when(F.col("event_id") % 10 == 9, useless)
            .when(F.col("event_id") % 2 == 0, nested).otherwise(dotted))
    return _events(s, d).filter(where).select(body.alias("value"))


def ecs_rows(s, d):
    mapped = ingest.ingest_documents(ecs.decode_documents(_ecs_docs(s, d)), AS_OF)
    get = lambda k: F.try_element_at("kv", F.lit(k))
    return mapped.filter("status = 'structured'").groupBy(
        "event", F.try_element_at("labels", F.lit("instance")).alias("instance"), get("ip").alias("ip"),
        get("status").alias("http_status"), get("event.action").alias("action"), get("process.pid").alias("pid"),
        get("tags").alias("tags"), F.col("suspect").isNotNull().cast("int").alias("suspect")).agg(
        F.count("*").alias("n"), F.min("raw").alias("raw"), F.max(us("ts")).alias("last_us"))


def ecs_accounting(s, d):
    mapped = ingest.ingest_documents(ecs.decode_documents(_ecs_docs(s, d)), AS_OF)
    return EV.ingest_accounting(mapped).select("total", "structured", "rejected", "ts_clamped")


def ecs_value_search(s, d):
    rows = cut_lineage(ingest.to_store(ingest.ingest_documents(ecs.decode_documents(_ecs_docs(s, d)), AS_OF)))
    parts = [S.count_logs(rows, value=v).select(F.lit(v).alias("value"), "matched") for v in ("17", "click", "404")]
    return parts[0].union(parts[1]).union(parts[2])


def flattened_documents(s, d):
    v = _ecs_docs(s, d).select(F.try_parse_json("value").alias("v"))
    flat = v.select(F.explode(documents.flatten_json(F.col("v"))).alias("key", "value"))
    return flat.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct(F.col("value").cast("string")).alias("values"))


def text_lines(s, d):
    text = s.read.parquet(f"{d}/documents.parquet").select(F.explode(F.split("text", "\n")).alias("value"))
    return LN.lines_of(text, {"source": "documents"}).groupBy(
        F.try_element_at("labels", F.lit("protocol")).alias("protocol"),
        F.try_element_at("labels", F.lit("source")).alias("source")).agg(
        F.count("*").alias("n"), F.sum(F.length("raw")).alias("chars"))


def json_lines(s, d):
    n = F.col("user_id").cast("string")
    body = (F.when(F.col("event_id") % 4 == 0, F.to_json(F.array(F.concat(F.lit("a"), n), F.concat(F.lit("b"), n))))
            .when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"labels":{"instance":"i'), n, F.lit('","protocol":"x"},"lines":["l'), n, F.lit('"," "]}')))
            .when(F.col("event_id") % 4 == 2, F.concat(F.lit('{"line":"one'), n, F.lit('"}')))
            .otherwise(F.lit("{not json")))
    rows = LN.json_lines_of(_events(s, d).select(body.alias("value")))
    return rows.groupBy("raw", F.try_element_at("labels", F.lit("protocol")).alias("protocol"),
                        F.try_element_at("labels", F.lit("instance")).alias("instance")).agg(F.count("*").alias("n"))


def _stream_bodies(s, d):
    n = F.col("user_id").cast("string")
    ns = F.concat(F.unix_micros(F.col("ts").cast("timestamp")).cast("string"), F.lit("000"))
    streams = F.concat(F.lit('[{"stream":{"job":"j'), (F.col("user_id") % 3).cast("string"), F.lit('","unit":"u"},"values":[["'), ns,
                       F.lit('","line '), n, F.lit('"],["bad","x"],["1"]]}]'))
    push = F.concat(F.lit('{"streams":'), streams, F.lit("}"))
    query = F.concat(F.lit('{"data":{"result":'), streams, F.lit("}}"))
    return _events(s, d).select(F.when(F.col("event_id") % 2 == 0, push).otherwise(query).alias("value"))


def stream_entries(s, d):
    rows = LN.read_log_streams(_stream_bodies(s, d))
    return rows.select(F.try_element_at("labels", F.lit("job")).alias("job"), "ts_ns", "line",
                       us(times.ns_to_ts(F.col("ts_ns"))).alias("at_us"))


def stream_regrouped(s, d):
    groups = LN.regroup_streams(LN.log_stream_entries(_stream_bodies(s, d)), {"via": "tail"})
    return groups.select("key", us("block").alias("block_us"), F.size("entries").cast("long").alias("n"),
                         F.col("entries")[0]["ts_ns"].alias("first_ns"), F.col("entries")[0]["line"].alias("first_line"))


def stream_chunks(s, d):
    groups = LN.chunk_streams(LN.log_stream_entries(_stream_bodies(s, d)), 100)
    return groups.select("key", "chunk", F.size("entries").cast("long").alias("n"), F.col("entries")[0]["ts_ns"].alias("first_ns"),
                         F.element_at("entries", -1)["ts_ns"].alias("last_ns"))


def stream_labels(s, d):
    n = F.col("user_id").cast("string")
    text = F.concat(F.lit('{job="a", instance="i'), n, F.lit('",job="b'), (F.col("user_id") % 4).cast("string"), F.lit('"}'))
    m = _events(s, d).select(L.parse_stream_labels(text).alias("m"))
    return m.groupBy(F.col("m")["job"].alias("job"), F.col("m")["instance"].alias("instance"),
                     F.size("m").cast("long").alias("size")).agg(F.count("*").alias("n"))


def socket_snapshot(s, d):
    n, k = F.col("user_id").cast("string"), F.regexp_extract("props", "[0-9]+", 0)
    peer = (F.when(F.col("user_id") % 10 == 0, F.lit("127.0.0.1:80")).when(F.col("user_id") % 10 == 1, F.lit("*:*"))
            .when(F.col("user_id") % 10 == 2, F.concat(F.lit("[2001:db8::"), n, F.lit("]:443")))
            .otherwise(F.concat(F.lit("198.51.100."), n, F.lit("%eth0:"), k)))
    users = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('users:(("nginx",pid='), k, F.lit(",fd=3))"))).otherwise("")
    line = F.concat(F.lit("tcp   0  0   10.0.0.1%lo:"), (F.col("user_id") + 1000).cast("string"), F.lit("  "), peer, F.lit(" "), users)
    rows = LN.parse_socket_snapshot(_events(s, d).select(line.alias("value")))
    return rows.groupBy("proto", "state", "local", "peer", "peer_port", "process", "pid").agg(
        F.count("*").alias("n"), F.min("local_port").alias("min_local_port"))


def logfmt_fields(s, d):
    rows = log(s, d).filter("event = 'netsnap_socket'").select(F.explode(L.parse_logfmt(F.col("raw"))).alias("key", "value"))
    return rows.groupBy("key", "value").agg(F.count("*").alias("n"))


def timestamps(s, d):
    ts = F.col("ts").cast("timestamp")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    text = (F.when(F.col("event_id") % 6 == 0, iso).when(F.col("event_id") % 6 == 1, F.unix_millis(ts).cast("string"))
            .when(F.col("event_id") % 6 == 2, F.unix_seconds(ts).cast("string")).when(F.col("event_id") % 6 == 3, "tuesday")
            .when(F.col("event_id") % 6 == 4, "4102444800").otherwise("3600"))
    clf = F.concat(F.date_format(ts, "dd/MMM/yyyy:HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, " +0130").otherwise(""))
    c = times.clamp_ts(times.parse_ts(F.col("text")), AS_OF)
    rows = _events(s, d).select("event_id", text.alias("text"), clf.alias("clf"))
    return rows.select("event_id", us(times.parse_ts(F.col("text"))).alias("parsed_us"), us(c["ts"]).alias("kept_us"),
                       us(c["suspect"]).alias("suspect_us"), us(times.clf_time(F.col("clf"))).alias("clf_us"))


def structured_requests(s, d):
    rows = log(s, d).select("id", access.request_from_fields(F.col("kv")).alias("r")).filter("r is not null")
    return rows.select("id", "r.ip", "r.path", "r.status", "r.ua", "r.source")


def address_parts(s, d):
    n = F.col("user_id").cast("string")
    addr = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("10.0.0."), n, F.lit(":80"))).otherwise(
        F.concat(F.lit("[2001:db8::"), n, F.lit("]:22")))
    rows = _events(s, d).select(L.split_addr(addr).alias("a"),
                                L.edge_port(F.when(F.col("event_id") % 3 == 0, "port_443").otherwise("9100"),
                                            F.when(F.col("event_id") % 5 == 0, "8080")).cast("long").alias("edge_port"))
    return rows.groupBy("a.host", "a.port", "edge_port").agg(F.count("*").alias("n"))


def finding_keys(s, d):
    key = L.finding_key(F.lit("threat_actor"), F.col("ip"), F.when(F.col("target") != "host-0", F.col("target")))
    return T.access_hits(log(s, d)).select("ip", "target").distinct().select("ip", "target", key.alias("finding_key"))


# ---- storage -------------------------------------------------------------------------------

def _statuses(s, d):
    rules = TP.read_rules(base_rules(s))
    rows = log(s, d)
    raw = F.when(F.col("id") % 50 == 0, F.concat(F.lit("[Graph] "), "raw")).otherwise(F.col("raw"))
    ts = F.when(F.col("id") % 40 == 1, F.lit("2031-01-01").cast("timestamp")).otherwise(F.col("timestamp"))
    return ingest.ingest_lines(rows.select("id", raw.alias("raw"), "labels", ts.alias("ts")), rules, AS_OF)


def ingest_accounting(s, d):
    return EV.ingest_accounting(_statuses(s, d)).select(
        "total", "matched", "unstructured", "filtered", "ts_clamped", F.round("hit_rate", 4).alias("hit_rate"))


def stored_days(s, d):
    path = scratch_path(s, "stored")
    EV.write_events(ingest.to_store(_statuses(s, d)), path, AS_OF)
    return s.read.parquet(path).groupBy(F.col("event_date").cast("string").alias("day"), "source").agg(F.count("*").alias("n"))


def retention(s, d):
    path = scratch_path(s, "kept")
    EV.write_events(log(s, d).drop("event_date"), path)
    gone = EV.apply_retention(s, path, "2024-01-31 06:00:00", "14d")
    left = s.read.parquet(path).agg(F.count("*").alias("kept"), us(F.min("timestamp")).alias("oldest_us"))
    return left.withColumn("deleted", F.lit(gone).cast("long"))


def retention_days(s, d):
    return EV.retention_report(log(s, d), AS_OF, "10d").select(F.col("event_date").cast("string").alias("day"), "kept", "deleted")


def topology_aliases(s, d):
    seen = FL.resolve_nodes(log(s, d).select(F.try_element_at("kv", F.lit("peer_ip")).alias("ip")).filter("ip is not null"),
                            "ip", fleet(s), "node")
    named = FL.resolve_nodes(log(s, d).select(F.concat("instance", F.lit(":22")).alias("ip")), "ip", fleet(s), "node")
    return seen.unionByName(named).groupBy("ip", "node").agg(F.count("*").alias("n"))


# ---- orders and single rows ----------------------------------------------------------------

def actors_ordered(s, d):
    """The first nine actors of a listing."""
    return T.order_actors(T.threat_actors(T.access_hits(log(s, d)))).limit(9).select("ip", "score", "hostile_hits")


def unexpected_ordered(s, d):
    """The first twelve unexpected logins of a listing."""
    return P.order_unexpected(P.unexpected_logins(log(s, d), AS_OF, 6 * 86400)).limit(12).select("kind", "host", "user", "src_ip")


def counts_by_window(s, d):
    """Rows in windows written as people write them; one that says nothing is no window."""
    parts = [S.count_logs(log(s, d), q="HTTP/1.1", since_s=times.search_window(w), as_of=AS_OF).select(F.lit(w).alias("spec"), "matched")
             for w in ("7d", "36h", "90000", "later")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def one_finding(s, d):
    """A finding by its key, evidence included."""
    found, _ = _half_findings(s, d)
    key = found.agg(F.min("fingerprint")).first()[0]
    return N.get_finding(found, key).select("fingerprint", "subject", "instance", F.get_json_object("evidence", "$.reason").alias("reason"),
                                            F.get_json_object("evidence", "$.score").cast("long").alias("score"))


BATCH = {f.__name__: f for f in [
    search_value, search_value_indexed, search_field_indexed, search_port_indexed, count_values_indexed, search_text, search_field, search_port_process, search_window, search_by_shape, count_text,
    search_truncation, recent_logins, network_rows, network_dns, instances, technique_counts, threat_actors,
    actor_paths_capped, actor_hostile_paths, campaigns, technique_totals, internal_addresses_left_out, owners, owner_by_prefix,
    behaviour_profiles, request_gaps, longest_404_runs, client_claims, threat_view_actors, threat_view_tags,
    threat_view_scan, threat_view_scan_all, raise_reasons, findings_upserted, findings_listed, findings_summed, finding_evidence,
    rejected_verdicts, campaign_registry, presence, unexpected_logins, login_findings, sweep, rate_windows,
    rate_spikes, rate_series, unstructured_surges, anomaly_states, anomaly_alerts, unit_alerts, critical_lines,
    observed_flows, history_flows, edges, topology_shifts, silent_links, node_states, subgraph, subgraph_edges,
    subgraph_search, subgraph_search_reach, host_flows, time_lapse, retired_externals, dangling_edges,
    folded_addresses, merged_history, graph_summary, graph_filtered, fleet_metrics, matched_lines, matched_lines_many_rules, template_usage,
    added_rules, loaded_rules, merged_rules, skeletons, clusters, document_skeletons, synthesized_rules,
    value_shapes, normalized_fields, ecs_rows, ecs_accounting, ecs_value_search, flattened_documents, text_lines,
    json_lines, stream_entries, stream_regrouped, stream_chunks, stream_labels, socket_snapshot, logfmt_fields, timestamps,
    structured_requests, address_parts, finding_keys, ingest_accounting, stored_days, retention, retention_days,
    topology_aliases, actors_ordered, unexpected_ordered, counts_by_window, one_finding]}
