"""The whole threat view, and the sweep that turns it into findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators import behaviour as B, findings as N, ownership as O, presence as P, threats as T
from ..operators.search import log_filter, search_logs, search_with_truncation
from ..session import cut_lineage
from ..sources.topology import Topology


@dataclass
class ThreatView:
    actors: DataFrame
    campaigns: DataFrame
    technique_totals: DataFrame
    tag_totals: DataFrame
    owners: DataFrame | None
    excluded_internal: DataFrame
    scanned: DataFrame


def threat_view(events: DataFrame, topology: Topology | None = None, owners: DataFrame | None = None,
                rdns: DataFrame | None = None, registry: DataFrame | None = None, *,
                q: str | None = "HTTP/1.1", since_s: int | None = None, as_of=None,
                limit: int | None = None, min_hits: int = 1) -> ThreatView:
    """Actors with owner, behaviour and tags, their campaigns and totals.

    The view covers every matching row of the window unless a limit is asked for,
    and `scanned` says how many rows matched and whether the limit cut any off.
    Requests, and then the finished actors, are written to the shared folder, so
    the log is parsed once for each reader and the parts of the view share actors.
    """
    filters = dict(q=q, since_s=since_s, as_of=as_of)
    rows = (events.filter(log_filter(events, **filters)) if limit is None
            else search_logs(events, limit, **filters))
    scanned = search_with_truncation(events, limit, **filters)
    hits, requests = T.access_hits(rows), B.client_requests(rows)
    hits = cut_lineage(hits) if topology else hits
    internal = topology.internal_addresses() if topology else None
    excluded = hits.select("ip").limit(0)
    if internal is not None:
        hits, excluded = T.split_internal(hits, internal)
    actors = T.threat_actors(hits, min_hits)
    if owners is not None:
        actors = O.attach_owner(actors, owners, rdns)
    else:
        actors = actors.withColumn("org", F.lit(None).cast("string"))
    profiles = B.behaviour_profiles(requests, rdns).select(
        "ip", "tells", "inconsistency", "user_agent_count", "peak_rate_per_s", "connections",
        "longest_404_run")
    actors = cut_lineage(actors.join(profiles, "ip", "left").withColumn("auto_tags", T.auto_tags()))
    found_owners = O.owners(actors) if owners is not None else None
    campaigns = T.campaigns(actors)
    if registry is not None:
        actors, campaigns = T.attach_registry(actors, registry), T.attach_registry(campaigns, registry)
    return ThreatView(actors, campaigns, T.technique_totals(actors), T.tag_totals(actors), found_owners,
                      excluded, scanned)


def sweep(events: DataFrame, findings: DataFrame, as_of, topology: Topology | None = None,
          owners: DataFrame | None = None, rdns: DataFrame | None = None, *, window_s: int = 3600,
          presence_window_s: int = 3600, baseline_s: int = 30 * 86400) -> DataFrame:
    """Findings after one pass over the last hour's requests and logins."""
    view = threat_view(events, topology, owners, rdns, since_s=window_s, as_of=as_of)
    detail = ["ip", "actor_id", "threat_tier", "hits", "hostile_hits", "techniques", "fingerprint",
              "targets", "score", "inconsistency", "tells"]
    threats = N.threat_findings(view.actors, detail)
    logins = N.login_findings(P.unexpected_logins(events, as_of, presence_window_s, baseline_s))
    return N.upsert_findings(findings, threats.unionByName(logins), as_of)
