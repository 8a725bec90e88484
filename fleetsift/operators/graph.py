"""The traffic graph: edges with rates, shifts, neighbourhoods, slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as V
from ..functions.lines import edge_port
from ..functions.times import as_timestamp, seconds
from ..session import cut_lineage
from ..sources.topology import Topology
from .anomaly import z_score
from .flows import resolve_nodes


def edge_id(source: Column, target: Column, kind: Column) -> Column:
    return F.concat(source, F.lit("->"), target, F.lit(":"), kind)


def edge_rates(flows: DataFrame, as_of, keys=("source", "target", "protocol"),
               window_minutes: float = 15.0) -> DataFrame:
    """Per edge up to as_of: volume, bytes, last_seen, last-minute rates and baseline."""
    now = as_timestamp(as_of)
    age = lambda s: F.col("timestamp") >= now - seconds(s)
    named = F.when(F.col("channel").startswith("port_"), F.struct("timestamp", "id", "channel"))
    minute_bytes = F.sum(F.when(age(60), F.col("bytes")).otherwise(0))
    return flows.filter(F.col("timestamp") <= now).groupBy(*keys).agg(
        F.count("*").alias("total_volume"), F.sum("bytes").alias("total_bytes"),
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
        F.count_if(age(60)).alias("rate_1m"), minute_bytes.alias("bytes_1m"),
        F.round(minute_bytes / F.lit(60.0), 2).alias("bytes_per_sec"),
        F.round(F.count_if(age(V.WINDOW_SECONDS)) / F.lit(float(window_minutes)), 2).alias("baseline_15m"),
        F.min(F.struct("timestamp", "id", "channel"))["channel"].alias("first_channel"),
        F.min(named)["channel"].alias("port_channel"),
        F.max(F.when(F.col("port") > 0, F.struct("timestamp", "id", "port")))["port"].alias("port"))


def declared_edges(topology: Topology) -> DataFrame:
    """Declared edges between resolved nodes; a repeated edge keeps one declaration."""
    edges = resolve_nodes(resolve_nodes(topology.edges, "source", topology), "target", topology)
    return edges.groupBy("source", "target", "protocol").agg(
        F.max(F.struct("expected_min_rate", "channel")).alias("d")).select(
        "source", "target", "protocol", "d.channel", "d.expected_min_rate", F.lit(True).alias("is_declared"))


def build_edges(flows: DataFrame, topology: Topology, as_of, window_minutes: float = 15.0) -> DataFrame:
    """Declared and observed edges in one table, keyed source -> target : protocol.

    An observed edge nobody declared is NOVEL. A channel gives way to the first
    port_N channel seen on the edge.
    """
    rates = edge_rates(flows, as_of, window_minutes=window_minutes)
    keys = ["source", "target", "protocol"]
    both = declared_edges(topology).join(rates, keys, "full_outer")
    declared = F.coalesce("is_declared", F.lit(False))
    channel = F.when(F.col("channel").startswith("port_"), F.col("channel")).otherwise(
        F.coalesce("port_channel", "channel", "first_channel"))
    zero = lambda c, kind: F.coalesce(c, F.lit(0).cast(kind)).alias(c)
    return both.select(
        edge_id(F.col("source"), F.col("target"), F.col("protocol")).alias("edge_id"), *keys,
        channel.alias("channel"), edge_port(channel, F.col("port").cast("string")).alias("port"),
        declared.alias("is_declared"), zero("expected_min_rate", "double"), zero("total_volume", "long"),
        zero("total_bytes", "long"), zero("rate_1m", "long"), zero("bytes_1m", "long"),
        zero("bytes_per_sec", "double"), zero("baseline_15m", "double"), "first_seen", "last_seen",
        F.when(declared, "HEALTHY").otherwise("NOVEL").alias("status"))


def _silence(as_of) -> Column:
    return (F.unix_micros(as_timestamp(as_of)) - F.unix_micros("last_seen")) / F.lit(1e6)


def judge_edges(edges: DataFrame, as_of, min_rate: float = 30.0, min_z: float = 4.0, min_ratio: float = 2.5,
                heavy: float = 20.0, drop: float = 0.2, silent_s: float = 120.0) -> DataFrame:
    """Edges with their status and the shifts they show, in the order they are judged."""
    rate, base = F.col("rate_1m"), F.col("baseline_15m")
    quiet = F.coalesce(_silence(as_of), F.lit(0.0))
    silent = (F.col("is_declared") & (F.col("expected_min_rate") > 0) & (F.col("total_volume") > 0)
              & (quiet > silent_s) & (rate == 0))
    novel = ~silent & ~F.col("is_declared")
    surge = ~silent & (rate >= min_rate) & (base > 0) & (z_score(rate, base) >= min_z) & (rate >= base * min_ratio)
    starved = ~silent & ~surge & (base >= heavy) & (rate < base * drop) & (quiet <= silent_s) & (F.col("total_volume") > 0)
    shift = lambda when, kind, severity, message: F.when(when, F.struct(
        F.lit(kind).alias("type"), severity.alias("severity"), message.alias("message")))
    found = F.array_compact(F.array(
        shift(silent, "SILENT_LINK", F.when(F.col("expected_min_rate") >= 2.0, "critical").otherwise("warning"),
              F.format_string("Traffic on link %s silent for %ds (nominal baseline: %.1f logs/min).",
                              F.col("edge_id"), quiet.cast("long"), base)),
        shift(novel, "NOVEL_EDGE", F.lit("warning"), F.format_string(
            "Undeclared communication path active: %s -> %s via %s (%.1f logs/min).",
            F.col("source"), F.col("target"), F.col("protocol"), rate.cast("double"))),
        shift(surge, "FLOW_SURGE", F.lit("warning"), F.format_string(
            "Edge %s surging at %d logs/min (+%.1fσ vs %.1f/min baseline).",
            F.col("edge_id"), rate, z_score(rate, base), base)),
        shift(starved, "STARVATION", F.lit("notice"), F.format_string(
            "Edge %s starved: current rate %d/min is >80%% below baseline %.1f/min.",
            F.col("edge_id"), rate, base))))
    status = (F.when(silent, "SILENT").when(surge, "SURGING").when(starved, "STARVED")
              .when(F.col("is_declared"), "HEALTHY").otherwise("NOVEL"))
    return edges.withColumn("status", status).withColumn("shifts", found)


def topology_shifts(edges: DataFrame, as_of, **limits) -> DataFrame:
    """One row per shift of the edges."""
    judged = judge_edges(edges, as_of, **limits)
    return judged.select("edge_id", "source", "target", "protocol", "rate_1m", "baseline_15m",
                         F.inline("shifts"))


def filter_graph(rows: DataFrame, **equals) -> DataFrame:
    """Nodes, edges or shifts whose columns equal the given values; None is no filter."""
    for name, value in equals.items():
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    return rows


def _ends(edges: DataFrame, *columns: str) -> DataFrame:
    """(id, role, columns) for both ends of every edge."""
    role = F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit("source").alias("role")),
                             F.struct(F.col("target").alias("id"), F.lit("target").alias("role"))))
    return edges.select(role.alias("end"), *columns).select("end.*", *columns)


def graph_nodes(edges: DataFrame, topology: Topology) -> DataFrame:
    """Declared nodes and every endpoint seen: id, name, type, ips, declared, seen times.

    An undeclared id that starts with 'external:' is external, another one a
    client if it was a source when first seen, else a service.
    """
    seen = _ends(edges, "first_seen", "last_seen").groupBy("id").agg(
        (F.min(F.struct("first_seen", "role"))["role"] == "source").alias("dials"), F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"))
    kind = (F.when(F.col("id").startswith("external:"), "external").when(F.col("dials"), "client")
            .otherwise("service"))
    address = F.when(F.col("id").contains("."), F.array("id")).otherwise(F.array().cast("array<string>"))
    nodes = topology.nodes.select("id", "name", "type", "ips")
    return nodes.join(seen, "id", "full_outer").select(
        "id", F.coalesce("name", F.concat_ws(":", kind, F.substring_index("id", ":", -1))).alias("name"),
        F.coalesce("type", kind).alias("type"), F.coalesce("ips", address).alias("ips"),
        F.col("type").isNotNull().alias("declared"), "first_seen", "last_seen")


def node_status(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with DEGRADED if a silent critical link touches them, SURGING, else HEALTHY."""
    touched = _ends(edges, "status", "expected_min_rate").groupBy("id").agg(
        F.bool_or((F.col("status") == "SILENT") & (F.col("expected_min_rate") >= 2.0)).alias("broken"),
        F.bool_or(F.col("status") == "SURGING").alias("surging"))
    status = F.when(F.col("broken"), "DEGRADED").when(F.col("surging"), "SURGING").otherwise("HEALTHY")
    return nodes.join(touched, "id", "left").withColumn("status", status).drop("broken", "surging")


def graph_summary(nodes: DataFrame, edges: DataFrame, shifts: DataFrame) -> DataFrame:
    """One row (metric, value) each, and the fleet status."""
    count = lambda df, name: df.agg(F.count("*").cast("string").alias("value")).select(F.lit(name).alias("metric"), "value")
    bad = F.coalesce(F.bool_or(F.col("severity") == "critical"), F.lit(False))
    status = shifts.agg(F.when(bad, "DEGRADED").otherwise("HEALTHY").alias("value"))
    return (count(nodes, "total_nodes").union(count(edges, "total_edges")).union(count(shifts, "active_shifts"))
            .union(status.select(F.lit("fleet_status"), "value")))


# ---- neighbourhoods ------------------------------------------------------------

def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(id, hops) of everything within depth hops of seeds (id), edges taken both ways.

    Each hop is written to the shared folder, so a plan never repeats earlier hops
    and a lost executor costs one hop. A node already reached is never revisited.
    """
    if depth < 0:
        raise ValueError("a depth is at least 0")
    links = edges.select("source", "target").filter("source != target").distinct()
    both = links.union(links.select("target", "source")).toDF("id", "next")
    reached = cut_lineage(seeds.select("id").distinct().withColumn("hops", F.lit(0)))
    frontier = reached
    both = cut_lineage(both) if depth > 1 else both
    for hop in range(1, depth + 1):
        step = (both.join(frontier.select("id"), "id", "left_semi").select(F.col("next").alias("id")).distinct()
                .join(reached.select("id"), "id", "left_anti").withColumn("hops", F.lit(hop)))
        frontier = cut_lineage(step)
        if frontier.isEmpty():
            break
        reached = reached.union(frontier)
    return reached


def find_seed(nodes: DataFrame, name: str, topology: Topology) -> DataFrame:
    """(id) of the node a name stands for, also under its external spelling; empty if none."""
    text = (name or "").strip()
    asked = resolve_nodes(nodes.sparkSession.sql("SELECT :name AS name", args={"name": text}),
                          "name", topology, "resolved")
    tries = asked.select(F.posexplode(F.array("resolved", F.concat(F.lit("external:"), "name"), "name"))
                         .alias("place", "id"))
    found = nodes.select("id").distinct().join(tries, "id").groupBy().agg(F.min_by("id", "place").alias("id"))
    return found.filter("id is not null")


def subgraph(nodes: DataFrame, edges: DataFrame, name: str, topology: Topology,
             depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """(nodes with hops, edges among them) around a name; both empty if nothing carries it."""
    hops = reach(edges, find_seed(nodes, name, topology), depth)
    near = nodes.join(hops, "id")
    ids = near.select("id")
    inside = (edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi")
              .join(ids.select(F.col("id").alias("target")), "target", "left_semi"))
    return near, inside


def order_subgraph(near: DataFrame) -> DataFrame:
    return near.orderBy("hops", "id")


def _holds(c, text: str) -> Column:
    return F.lower(c).contains(text.lower())


def search_subgraph(edges: DataFrame, topology: Topology, flows: DataFrame | None = None, *, ip=None,
                    port=None, protocol=None, instance=None, process=None, status=None,
                    depth: int = 1, nodes: DataFrame | None = None) -> DataFrame:
    """Edges that match every criterion, live and from flows of the past.

    Live edges match port, ip, process and instance as substrings; flows match
    the port exactly. A past flow is keyed by channel and adds its volume to a
    live edge of that key. Beyond depth 1 only what the seed reaches stays.
    """
    p = str(port).strip() if port is not None and str(port).strip() else None
    live = edges
    if protocol:
        live = live.filter(F.lower("protocol") == protocol.lower())
    if status:
        live = live.filter(F.upper("status") == status.upper())
    if p:
        live = live.filter(F.col("edge_id").contains(p) | F.col("channel").contains(p) | (F.col("port") == F.lit(p)))
    if process:
        live = live.filter(_holds("source", process) | _holds("target", process) | _holds("channel", process))
    if instance:
        live = live.filter(_holds("source", instance) | _holds("target", instance))
    if ip:
        owners = topology.nodes.filter(F.exists("ips", lambda a: a.contains(ip))).select("id")
        if nodes is not None:
            owners = owners.union(nodes.filter(F.exists("ips", lambda a: a.contains(ip))).select("id")).distinct()
        hit = F.col("edge_id").contains(ip)
        for end in ("source", "target"):
            live = live.join(owners.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
            hit = hit | F.coalesce(f"_{end}", F.lit(False))
        live = live.filter(hit).drop("_source", "_target")
    live = live.select("edge_id", "source", "target", "protocol", "channel", "port", "is_declared",
                       "total_volume", "rate_1m", "bytes_per_sec", "status")
    if flows is not None:
        past = flows
        if protocol:
            past = past.filter(F.lower("protocol") == protocol.lower())
        if p:
            past = past.filter(F.col("port").cast("string") == p)
        if process:
            past = past.filter(_holds("process", process) | _holds("source", process) | _holds("target", process))
        if instance:
            past = past.filter(_holds("source", instance) | _holds("target", instance))
        if ip:
            past = past.filter(F.col("source").contains(ip) | F.col("target").contains(ip) | F.col("raw").contains(ip))
        live = _merge_history_flows(live, edges, past)
    seed = ip or instance
    if seed and depth > 1:
        live = cut_lineage(live)
        all_nodes = live.select(F.explode(F.array("source", "target")).alias("id")).distinct()
        found = find_seed(all_nodes, seed, topology)
        if not found.isEmpty():
            ids = reach(live, found, depth).select("id")
            live = (live.join(ids.select(F.col("id").alias("source")), "source", "left_semi")
                    .join(ids.select(F.col("id").alias("target")), "target", "left_semi"))
    return live


def _merge_history_flows(live: DataFrame, edges: DataFrame, flows: DataFrame) -> DataFrame:
    key = edge_id(F.col("source"), F.col("target"), F.col("channel"))
    past = flows.groupBy(key.alias("edge_id"), "source", "target", "channel").agg(
        F.count("*").alias("n"), F.min(F.struct("timestamp", "id", "protocol", "port")).alias("f"))
    known = edges.select("edge_id", F.struct(*[c for c in live.columns if c != "edge_id"]).alias("k"))
    hits = live.select("edge_id", F.lit(True).alias("matched"))
    joined = past.join(known, "edge_id", "left").join(hits, "edge_id", "left")
    volume = (F.when(F.col("matched"), F.col("k.total_volume") + F.col("n"))
              .when(F.col("k").isNotNull(), F.col("k.total_volume") + F.col("n") - 1).otherwise(F.col("n")))
    old = lambda c, new: F.coalesce(F.col(f"k.{c}"), new).alias(c)
    rows = joined.select(
        "edge_id", "source", "target", old("protocol", F.col("f.protocol")), "channel",
        old("port", F.col("f.port")), old("is_declared", F.lit(False)), volume.alias("total_volume"),
        old("rate_1m", F.lit(0).cast("long")), old("bytes_per_sec", F.lit(0.0)), old("status", F.lit("HEALTHY")))
    return live.join(past.select("edge_id"), "edge_id", "left_anti").select(*rows.columns).unionByName(rows)


def subgraph_counts(found: DataFrame, shifts: DataFrame | None = None) -> DataFrame:
    """One row: nodes, edges and volume of a search result, and the shifts that touch it."""
    ids = _ends(found).select("id").distinct()
    out = found.agg(F.count("*").alias("edge_count"), F.coalesce(F.sum("total_volume"), F.lit(0)).alias("total_volume"))
    nodes = ids.agg(F.count("*").alias("node_count"))
    rows = (out.select(F.lit("edge_count").alias("metric"), F.col("edge_count").alias("value"))
            .union(out.select(F.lit("total_volume"), "total_volume"))
            .union(nodes.select(F.lit("node_count"), "node_count")))
    if shifts is None:
        return rows
    touched = _ends(shifts, "edge_id", "type").join(ids, "id", "left_semi").select("edge_id", "type").distinct()
    return rows.union(touched.agg(F.count("*")).select(F.lit("active_shifts"), "count(1)"))


def host_flows(edges: DataFrame, host: str) -> DataFrame:
    """Edges of a host with direction inbound, outbound or internal, the process at its end, and the
    processes at both ends where both are the host's."""
    at = lambda c: (F.col(c) == host) | F.col(c).startswith(f"{host}:")
    own = lambda c: F.when(F.col(c).startswith(f"{host}:"), F.substr(c, F.lit(len(host) + 2)))
    direction = (F.when(at("source") & at("target"), "internal").when(at("target"), "inbound")
                 .when(at("source"), "outbound"))
    return (edges.withColumn("direction", direction).filter("direction is not null")
            .withColumn("process", F.coalesce(F.when(F.col("direction") == "inbound", own("target")),
                                              own("source"), own("target"), F.lit("")))
            .withColumn("processes", F.array_distinct(F.array_compact(F.array(
                F.when(at("source"), F.nullif(own("source"), F.lit(""))), F.when(at("target"), F.nullif(own("target"), F.lit(""))))))))


def host_flow_summary(flows_of_host: DataFrame) -> DataFrame:
    """Per direction: flows, rate, bandwidth and the processes involved."""
    return flows_of_host.groupBy("direction").agg(
        F.count("*").alias("flows"), F.round(F.sum("rate_1m"), 2).alias("rate"),
        F.round(F.sum("bytes_per_sec"), 2).alias("bytes_per_sec"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("processes")))).alias("processes"))


def surface_slices(slices: int) -> int:
    """A number of slices asked for from outside, held within the usual bounds."""
    return max(V.MIN_SLICES, min(int(slices), V.MAX_SLICES))


def flow_slices(flows: DataFrame, as_of, since_s: int = 3600, slices: int = 12) -> DataFrame:
    """(slice_index, edge_id, volume, is_new): edges per slice, new against the slice before."""
    n = slices
    start = F.unix_micros(as_timestamp(as_of)) - since_s * 1_000_000
    index = F.floor((F.unix_micros("timestamp") - start) * n / F.lit(float(since_s * 1_000_000))).cast("int")
    rows = flows.withColumn("slice_index", index).filter(F.col("slice_index").between(0, n - 1))
    key = edge_id(F.col("source"), F.col("target"), F.col("channel"))
    counted = rows.groupBy(key.alias("edge_id"), "slice_index").agg(F.count("*").alias("volume"))
    before = F.lag("slice_index").over(Window.partitionBy("edge_id").orderBy("slice_index"))
    return counted.withColumn("is_new", F.coalesce(before != F.col("slice_index") - 1, F.lit(True)))


def time_lapse(flows: DataFrame, as_of, since_s: int = 3600, slices: int = 12) -> DataFrame:
    """Per slice, with traffic or without: edges, new edges, volume and bytes per second."""
    n = slices
    width = since_s / n
    start = as_timestamp(as_of) - seconds(since_s)
    busy = flow_slices(flows, as_of, since_s, slices).groupBy("slice_index").agg(
        F.count("*").alias("total_edges"), F.count_if("is_new").alias("new_edges"),
        F.sum("volume").alias("total_volume"))
    every = flows.sparkSession.range(n).select(F.col("id").cast("int").alias("slice_index"))
    return (every.join(busy, "slice_index", "left").na.fill(0, ["total_edges", "new_edges", "total_volume"])
        .withColumn("timestamp_start", F.timestamp_micros(
            F.unix_micros(start) + (F.col("slice_index") * (width * 1e6)).cast("long")))
        .withColumn("bytes_per_sec", F.round(F.col("total_volume") * V.DEFAULT_SAMPLE_BYTES
                                             / F.lit(max(1.0, width)), 2)))


# ---- upkeep --------------------------------------------------------------------

def transient_externals(nodes: DataFrame, edges: DataFrame, as_of,
                        ttl_s: int = V.EXTERNAL_TTL_SECONDS) -> DataFrame:
    """(id) of external nodes seen at most once, long ago, beside at most one own node."""
    kinds = nodes.select(F.col("id").alias("other"), F.col("type").alias("other_type"))
    pairs = (edges.select(F.col("source").alias("id"), F.col("target").alias("other"), "total_volume")
             .union(edges.filter("source != target").select("target", "source", "total_volume")))
    facts = pairs.join(kinds, "other", "left").groupBy("id").agg(
        F.sum("total_volume").alias("volume"),
        F.count_distinct(F.when(F.col("other_type") != "external", F.col("other"))).alias("own"))
    old = F.unix_micros(as_timestamp(as_of)) - F.unix_micros(F.coalesce("first_seen", "last_seen")) > ttl_s * 1_000_000
    return (nodes.filter((F.col("type") == "external") & old).join(facts, "id", "left")
            .filter((F.coalesce("volume", F.lit(0)) <= 1) & (F.coalesce("own", F.lit(0)) <= 1)).select("id"))


def retire_externals(nodes: DataFrame, edges: DataFrame, as_of, **limits) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, retired ids) without the transient externals."""
    gone = transient_externals(nodes, edges, as_of, **limits)
    return nodes.join(gone, "id", "left_anti"), _without(edges, gone), gone


def _without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    for end in ("source", "target"):
        edges = edges.join(gone.select(F.col("id").alias(end)), end, "left_anti")
    return edges


def prune_dangling(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges whose ends exist, edges dropped)."""
    ids = nodes.select("id").distinct()
    marked = edges
    for end in ("source", "target"):
        marked = marked.join(ids.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
    whole = F.coalesce(F.col("_source") & F.col("_target"), F.lit(False))
    out = lambda keep: marked.filter(keep).select(*edges.columns)
    return out(whole), out(~whole)


def fold_addresses(nodes: DataFrame, edges: DataFrame, ip_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after addresses (ip, node_id) were found to belong to known nodes.

    The address joins its node, and the stale external:<ip> node goes with its edges.
    """
    mine = ip_map.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    more = mine.groupBy("node_id").agg(F.collect_set("ip").alias("more"))
    stale = mine.select(F.concat(F.lit("external:"), "ip").alias("id")).distinct()
    grown = (nodes.join(more.withColumnRenamed("node_id", "id"), "id", "left")
             .withColumn("ips", F.array_sort(F.array_union("ips", F.coalesce("more", F.array().cast("array<string>")))))
             .drop("more"))
    return grown.join(stale, "id", "left_anti"), _without(edges, stale)


def merge_history(declared: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Edges after a restart: declared ones keep their definition and take the history,
    others come back with their rates zeroed."""
    d, s = declared.alias("d"), snapshot.alias("s")
    taken = ["total_volume", "total_bytes", "baseline_15m", "last_seen"]
    zeroed = ["rate_1m", "bytes_1m", "bytes_per_sec"]
    old = F.col("d.edge_id").isNotNull()

    def value(c):
        if c in taken:
            return F.coalesce(f"s.{c}", f"d.{c}")
        fresh = F.lit(0).cast(dict(declared.dtypes)[c]) if c in zeroed else F.col(f"s.{c}")
        return F.when(old, F.col(f"d.{c}")).otherwise(fresh)

    joined = d.join(s, F.col("d.edge_id") == F.col("s.edge_id"), "full_outer")
    return joined.select(*[value(c).alias(c) for c in declared.columns])


def merge_node_history(declared: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Nodes after a restart: the later sighting counts, unknown nodes come back whole."""
    d, s = declared.alias("d"), snapshot.alias("s")
    old = F.col("d.id").isNotNull()
    pick = lambda c: (F.greatest("d.last_seen", "s.last_seen") if c == "last_seen"
                      else F.when(old, F.col(f"d.{c}")).otherwise(F.col(f"s.{c}")))
    joined = d.join(s, F.col("d.id") == F.col("s.id"), "full_outer")
    return joined.select(*[pick(c).alias(c) for c in declared.columns])
