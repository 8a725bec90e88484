"""Log rows to flows between nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..functions.documents import first_nonempty
from ..functions.lines import merge_fields, parse_logfmt
from ..sources.topology import Topology

FLOW = ["id", "timestamp", "source", "target", "protocol", "channel", "port", "process", "bytes", "raw"]


def resolve_nodes(df: DataFrame, column: str, topology: Topology, out: str | None = None) -> DataFrame:
    """Adds the node a name, address or host:port stands for; unknown ones stay as they are.

    Nothing becomes 'unknown'. host:port goes to the host's service node for a
    known port, then to a node of that very name, then to the host.
    """
    out = out or column
    known = topology.lookup
    ids = topology.ids
    clean = F.trim(F.coalesce(column, F.lit("")))
    ports = dict(V.PORT_SERVICES, **{V.INGEST_PORT: topology.ingest_service})
    service = F.try_element_at(F.create_map(*[F.lit(x) for p in ports.items() for x in p]), F.col("_port"))
    pair = F.col("_name").contains(":")
    step = (df.withColumn("_name", clean)
            .withColumn("_host", F.when(pair, F.substring_index("_name", ":", 1)))
            .withColumn("_port", F.when(pair, F.substr("_name", F.length("_host") + F.lit(2))))
            .join(known.select(F.col("alias").alias("_name"), F.col("node_id").alias("_node")), "_name", "left")
            .join(known.select(F.col("alias").alias("_host"), F.col("node_id").alias("_hostnode")), "_host", "left")
            .withColumn("_owner", F.coalesce("_hostnode", "_host"))
            .withColumn("_svc", F.concat_ws(":", "_owner", service))
            .withColumn("_pair", F.concat_ws(":", "_owner", "_port"))
            .join(ids.select(F.col("node_id").alias("_svc"), F.lit(True).alias("_has_svc")), "_svc", "left")
            .join(ids.select(F.col("node_id").alias("_pair"), F.lit(True).alias("_has_pair")), "_pair", "left"))
    by_port = (F.when(service.isNotNull() & F.col("_has_svc"), F.col("_svc"))
               .when(F.col("_hostnode").isNotNull() & F.col("_has_pair"), F.col("_pair"))
               .otherwise(F.col("_hostnode")))
    node = F.coalesce("_node", by_port, "_name")
    columns = [c for c in df.columns if c != out]
    return step.select(*columns, F.when(F.col("_name") == "", "unknown").otherwise(node).alias(out))


def _facts(events: DataFrame) -> DataFrame:
    """The label and field values both extractors read, each once."""
    label = lambda k: F.coalesce(F.try_element_at("labels", F.lit(k)), F.lit(""))
    journal = F.exists(F.map_entries("labels"), lambda e: e["key"].contains("journal")
                       | e["value"].contains("journal"))
    return events.select(
        "id", "timestamp", F.coalesce("event", F.lit("")).alias("event"), F.coalesce("raw", F.lit("")).alias("raw"),
        "kv", F.nullif(label("instance"), F.lit("")).alias("instance"), label("unit").alias("unit"),
        label("source").alias("log_source"),
        first_nonempty(label("protocol"), F.when(journal, "loki").otherwise("http")).alias("log_protocol"),
        F.coalesce(first_nonempty(label("source"), label("job")), F.lit("telemetry_ingest")).alias("log_channel"),
        F.when(F.octet_length("raw") > 0, F.octet_length("raw")).otherwise(V.DEFAULT_SAMPLE_BYTES)
        .cast("long").alias("bytes"))


def _kv(*keys: str) -> Column:
    return first_nonempty(*[F.try_element_at("kv", F.lit(k)) for k in keys])


def _ssh_client() -> Column:
    written = F.nullif(F.regexp_extract("raw", r"from\s+(\d+\.\d+\.\d+\.\d+)", 1), F.lit(""))
    return F.coalesce(_kv("ip"), written)


def _is_ssh() -> Column:
    return F.col("event").isin("publickey_accepted", "sshd_session", "sshd") | F.col("raw").contains("Accepted publickey")


def _is_dns() -> Column:
    return F.col("event").isin("query_result", "dnsmasq") | F.col("unit").contains("dnsmasq")


def _ports(local: Column, peer: Column) -> tuple[Column, Column]:
    """Both port numbers; 0 for missing, and both 0 if either is no number."""
    number = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("0")).try_cast("int")
    bad = number(local).isNull() | number(peer).isNull()
    return F.when(bad, 0).otherwise(number(local)), F.when(bad, 0).otherwise(number(peer))


def _flow(when: Column, source, target, protocol, channel, port=None, process=None,
          source_host=None, target_host=None) -> Column:
    text = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("string")
    number = port if isinstance(port, Column) else F.lit(port)
    return F.when(when, F.struct(
        text(source).alias("source"), text(target).alias("target"), text(protocol).alias("protocol"),
        text(channel).alias("channel"), number.cast("int").alias("port"), text(process).alias("process"),
        text(source_host).alias("source_host"), text(target_host).alias("target_host")))


def _or_external(resolved: str, plain: str) -> Column:
    return F.when(F.col(resolved) == F.col(plain), F.concat(F.lit("external:"), F.col(plain))
                  ).otherwise(F.col(resolved))


def _exploded(facts: DataFrame, flows: list[Column]) -> DataFrame:
    return (facts.select("id", "timestamp", "bytes", "raw", F.explode(F.array_compact(F.array(*flows))).alias("f"))
            .select("id", "timestamp", "bytes", "raw", "f.*"))


def observe_flows(events: DataFrame, topology: Topology) -> DataFrame:
    """Flows as the live graph records them: zero to four per row, endpoints resolved.

    Every row is a telemetry flow from its host to the collector. A socket line
    with a known process adds one flow, oriented by the lower port; other rows
    may add an ssh flow and up to two resolver flows. A 'host:process' endpoint
    is that node where it is declared, else the host.
    """
    me = topology.self_node
    facts = _facts(events).withColumn("instance", F.coalesce("instance", F.lit("unknown")))
    socket = F.col("event").startswith("netsnap") | (F.col("log_source") == "netsnap")
    client = F.when(socket, _kv("peer_ip", "ip")).when(_is_ssh(), _ssh_client()).when(_is_dns(), _kv("ip", "client"))
    facts = (facts.withColumn("socket", socket).withColumn("peer", client)
             .withColumn("process", _kv("process")))
    lp, pp = _ports(F.try_element_at("kv", F.lit("local_port")), F.try_element_at("kv", F.lit("peer_port")))
    facts = facts.withColumn("lp", lp).withColumn("pp", pp)
    facts = resolve_nodes(facts, "instance", topology, "host")
    facts = resolve_nodes(facts, "peer", topology, "peer_node")
    host = F.col("host")
    far, proc = _or_external("peer_node", "peer"), F.concat_ws(":", host, "process")
    outward = (F.col("pp") > 0) & ((F.col("lp") == 0) | (F.col("pp") <= F.col("lp")))
    svc = F.when(outward, F.col("pp")).otherwise(F.col("lp"))
    channel = F.when(svc != 0, F.concat(F.lit("port_"), svc.cast("string"))).otherwise("socket")
    opened = F.col("socket") & (F.col("process") != "-") & F.col("peer").isNotNull()
    here = F.when(host != "unknown", host).otherwise(me)
    sshd = F.when(here.contains(":"), here).otherwise(F.concat(here, F.lit(":sshd")))
    rest = ~F.col("socket")
    dns_client = F.when(_is_dns(), _kv("ip", "client"))
    domain = _kv("url", "domain", "query")
    flows = _exploded(facts, [
        _flow(F.lit(True), host, f"{me}:{topology.ingest_service}", F.col("log_protocol"), F.col("log_channel")),
        _flow(opened, F.when(outward, proc).otherwise(far), F.when(outward, far).otherwise(proc),
              F.coalesce(_kv("proto"), F.lit("tcp")), channel, F.nullif(svc, F.lit(0)), F.col("process"),
              F.when(outward, host), F.when(~outward, host)),
        _flow(rest & _is_ssh() & F.col("peer").isNotNull(), F.col("peer_node"), sshd, "ssh", "remote_access",
              target_host=here),
        _flow(rest & _is_dns() & dns_client.isNotNull(), F.col("peer_node"), f"{me}:dnsmasq", "dns", "dns_query"),
        _flow(rest & _is_dns() & domain.isNotNull(), f"{me}:dnsmasq", F.concat(F.lit("external:"), domain),
              "dns", "dns_upstream"),
    ])
    for end in ("source", "target"):
        flows = flows.join(topology.ids.select(F.col("node_id").alias(end), F.lit(True).alias("_declared")), end, "left")
        flows = flows.withColumn(end, F.when(F.col("_declared"), F.col(end)).otherwise(
            F.coalesce(f"{end}_host", end))).drop("_declared")
    return flows.select(*FLOW)


def extract_flows(events: DataFrame, topology: Topology) -> DataFrame:
    """Flows as a search over history reads them: one kind per row, endpoints unfolded.

    Socket lines need both addresses and fall back to the fields in the line;
    a process of '-' stands for the host; unknown peers and clients are external.
    """
    me = topology.self_node
    facts = _facts(events)
    socket = (F.col("event").startswith("netsnap") | (F.col("log_source") == "netsnap")
              | F.col("raw").contains("netsnap "))
    have = lambda k: F.map_contains_key("kv", k)
    reread = (F.size("kv") == 0) | ~(have("local_port") | have("peer_port") | have("local"))
    facts = facts.withColumn("socket", socket).withColumn("kv", F.when(
        F.col("socket") & reread, merge_fields(F.col("kv"), parse_logfmt(F.col("raw")))).otherwise(F.col("kv")))
    split = lambda c, p: (p.isNull() & c.rlike(r":\d+$"))
    local, peer = _kv("local_ip", "local"), _kv("peer_ip", "peer", "ip")
    local_port, peer_port = _kv("local_port"), _kv("peer_port")
    tail = lambda c: F.substring_index(c, ":", -1)
    head = lambda c: F.regexp_replace(c, r":\d+$", "")
    facts = (facts
             .withColumn("lport", F.when(split(local, local_port), tail(local)).otherwise(local_port))
             .withColumn("pport", F.when(split(peer, peer_port), tail(peer)).otherwise(peer_port))
             .withColumn("laddr", F.when(split(local, local_port), head(local)).otherwise(local))
             .withColumn("paddr", F.when(split(peer, peer_port), head(peer)).otherwise(peer)))
    lp, pp = _ports(F.col("lport"), F.col("pport"))
    client = F.when(_is_ssh(), _ssh_client()).when(_is_dns(), _kv("ip", "client"))
    facts = (facts.withColumn("lp", lp).withColumn("pp", pp).withColumn("process", _kv("process"))
             .withColumn("far", F.when(F.col("socket"), F.col("paddr")).otherwise(client))
             .withColumn("near", F.when(F.col("socket") & F.col("instance").isNull(), F.col("laddr"))
                         .when(~F.col("socket"), F.col("instance"))))
    facts = resolve_nodes(resolve_nodes(facts, "far", topology, "far_node"), "near", topology, "near_node")
    host = F.coalesce("instance", "near_node")
    proc = F.when(F.col("process") != "-", F.concat_ws(":", host, "process")).otherwise(host)
    proc = F.when(F.col("process").isNull(), host).otherwise(proc)
    far = _or_external("far_node", "far")
    outward = (F.col("pp") > 0) & ((F.col("lp") == 0) | (F.col("pp") <= F.col("lp")))
    svc = F.when(outward, F.col("pp")).otherwise(F.col("lp"))
    channel = F.when(svc != 0, F.concat(F.lit("port_"), svc.cast("string"))).otherwise("socket")
    both = F.col("paddr").isNotNull() & F.col("laddr").isNotNull()
    plain = ~F.col("socket")
    ssh, dns = plain & _is_ssh(), plain & ~_is_ssh() & _is_dns()
    domain = _kv("url", "domain", "query")
    return _exploded(facts, [
        _flow(F.col("socket") & both, F.when(outward, proc).otherwise(far), F.when(outward, far).otherwise(proc),
              F.coalesce(_kv("proto"), F.lit("tcp")), channel, svc, F.coalesce("process", F.lit(""))),
        _flow(ssh & F.col("far").isNotNull(), far, F.concat(F.coalesce("instance", F.lit(me)), F.lit(":sshd")),
              "ssh", "remote_access", 22, "sshd"),
        _flow(dns & F.col("far").isNotNull(), far, f"{me}:dnsmasq", "dns", "dns_query", 53, "dnsmasq"),
        _flow(dns & domain.isNotNull(), f"{me}:dnsmasq", F.concat(F.lit("external:"), domain), "dns",
              "dns_upstream", 53, "dnsmasq"),
        _flow(plain & ~_is_ssh() & ~_is_dns() & F.col("instance").isNotNull(), F.col("near_node"),
              f"{me}:{topology.ingest_service}", F.col("log_protocol"), F.col("log_channel"),
              int(V.INGEST_PORT), "alloy"),
    ]).select(*FLOW)
