import random

import pytest
from pyspark.sql import functions as F

from fleetsift.operators import alerts, anomaly, graph as G, ownership as O, presence as P, search as S
from fleetsift.sources import events as EV, topology as TY
from tests.test_techniques import events


def auth(event, user, host="web", second=0, ip=None, service=None, actor=None):
    kv = {k: v for k, v in dict(user=user, src_ip=ip, service=service, actor=actor).items() if v}
    return (0, f"2026-09-15 00:00:{second:02d}", event, {"instance": host}, kv, "x")


def people(spark, rows):
    return {(r.host, r.user, r.src_ip): r for r in P.presence(events(spark, rows)).collect()}


def test_presence_folds_sessions_onto_the_usual_source(spark):
    rows = [auth("auth_ssh_accepted", "ann", ip="1.1.1.1"), auth("auth_ssh_accepted", "ann", ip="1.1.1.1", second=1),
            auth("auth_ssh_accepted", "ann", ip="2.2.2.2", second=2), auth("auth_session_opened", "ann", service="sshd", second=3),
            auth("auth_session_closed", "ann", service="sshd", second=4), auth("auth_session_opened", "root", service="cron"),
            auth("auth_sudo_command", None, actor="ann", second=5), auth("auth_sudo_failed", None, actor="bob", second=6)]
    got = people(spark, rows)
    assert set(got) == {("web", "ann", "1.1.1.1"), ("web", "ann", "2.2.2.2"), ("web", "bob", None)}
    main = got[("web", "ann", "1.1.1.1")]
    assert (main.logins, main.sessions_open, main.sessions_closed, main.sudo, main.active) == (2, 1, 1, 1, False)
    assert got[("web", "ann", "2.2.2.2")].active and got[("web", "bob", None)].sudo_failed == 1


def test_new_presence(spark):
    base = P.presence(events(spark, [auth("auth_ssh_accepted", "ann", ip="1.1.1.1")]))
    now = P.presence(events(spark, [auth("auth_ssh_accepted", "ann", ip="1.1.1.1"), auth("auth_ssh_accepted", "ann", ip="9.9.9.9"),
                                    auth("auth_ssh_accepted", "eve", ip="1.1.1.1"), auth("auth_session_opened", "ann", host="db", service="sshd")]))
    found = {(r.kind, r.host, r.user, r.src_ip) for r in P.new_presence(now, base).collect()}
    assert found == {("new-source", "web", "ann", "9.9.9.9"), ("new-host-user", "web", "eve", "1.1.1.1"), ("new-host-user", "db", "ann", None)}
    known = P.presence(events(spark, [auth("auth_session_opened", "ann", service="sshd")]))
    assert P.new_presence(known, base).count() == 0
    assert P.new_presence(base, base.limit(0)).count() == 1


def test_search_limits_and_values(spark):
    assert (S.clamp_limit(0), S.clamp_limit(-5), S.clamp_limit(10**9), S.clamp_limit(7)) == (1, 1, 200_000, 7)
    rows = events(spark, [auth("a", "ann"), auth("b", "bob")])
    for bad in ('x"y', "a b", "x" * 129, "a;b"):
        with pytest.raises(ValueError):
            S.search_logs(rows, value=bad)
    with pytest.raises(ValueError):
        S.search_logs(rows, kv="user:")
    assert S.search_logs(rows, value="ann").count() == 1 and S.count_logs(rows, kv="user:bob").first()[0] == 1
    assert S.auto_filter("10.0.0.1") == {"value": "10.0.0.1"} and S.auto_filter("peer_ip:1") == {"kv": "peer_ip:1"}
    assert S.auto_filter("some text") == {"q": "some text"}


def test_stored_table_prunes_and_expires(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.range(10).select("id", F.timestamp_seconds(F.lit(1767225600) + F.col("id") * 86400).alias("timestamp"),
                                  F.lit("e").alias("event"), F.create_map(F.lit("instance"), F.lit("h")).alias("labels"),
                                  F.lit(None).cast("map<string,string>").alias("kv"), F.lit(0.0).alias("latency_us"), F.lit("r").alias("raw"))
    EV.write_events(rows, path)
    table = spark.read.parquet(path)
    found = S.search_logs(table, start_time="2026-01-09 00:00:00", instance="h")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "EqualTo(instance,h)" in plan
    assert [r.id for r in found.collect()] == [9, 8]
    assert EV.apply_retention(spark, path, "2026-01-10 12:00:00", "off") == 0
    assert EV.apply_retention(spark, path, "2026-01-10 12:00:00", "3d") == 7
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [7, 8, 9]


def nodes_edges(spark):
    nodes = spark.createDataFrame([("hub", "hub", "server", "10.0.0.1", ["10.0.0.2"], ""), ("laptop", "laptop", "workstation", "10.0.0.3", None, ""),
                                   ("external:9.9.9.9", "x", "external", None, None, "")], TY.NODE)
    top = TY.topology_of(spark, nodes, spark.createDataFrame([], TY.EDGE), "hub")
    edges = spark.createDataFrame([("e1", "laptop", "hub", 5), ("e2", "external:9.9.9.9", "hub", 1), ("e3", "external:8.8.8.8", "external:9.9.9.9", 1)],
                                  "edge_id string, source string, target string, total_volume long")
    return top, edges


def test_subgraph(spark):
    top, edges = nodes_edges(spark)
    ids = lambda name, depth: {r.id: r.hops for r in G.subgraph(top.nodes, edges, name, top, depth)[0].collect()}
    assert ids("10.0.0.2", 0) == {"hub": 0}
    assert ids("10.0.0.3", 1) == {"laptop": 0, "hub": 1}
    assert ids("laptop", 2) == {"laptop": 0, "hub": 1, "external:9.9.9.9": 2}
    assert ids("9.9.9.9", 99) == {"external:9.9.9.9": 0, "hub": 1, "laptop": 2}
    assert ids("7.7.7.7", 2) == {}
    kept, dropped = G.prune_dangling(top.nodes, edges)
    assert {r.edge_id for r in kept.collect()} == {"e1", "e2"} and {r.edge_id for r in dropped.collect()} == {"e3"}


@pytest.mark.parametrize("kind,volume,age,own,gone", [
    ("external", 1, 7200, 1, True), ("external", 1, 600, 1, False), ("external", 2, 7200, 1, False),
    ("external", 1, 7200, 2, False), ("client", 1, 7200, 1, False), ("external", 0, 7200, 0, True)])
def test_retiring(spark, kind, volume, age, own, gone):
    rows = [("x", kind, 10_000 - age), ("a", "server", 0), ("b", "server", 0)]
    nodes = spark.createDataFrame(rows, "id string, type string, s long").withColumn("first_seen", F.timestamp_seconds("s")).withColumn("last_seen", F.col("first_seen"))
    edges = [(f"e{i}", "x", h, volume if i == 0 else 0) for i, h in enumerate("ab"[:own])]
    edges = spark.createDataFrame(edges, "edge_id string, source string, target string, total_volume long")
    assert G.transient_externals(nodes, edges, "1970-01-01 02:46:40").count() == (1 if gone else 0)


def test_history_merge(spark):
    cols = "edge_id string, source string, target string, expected_min_rate double, total_volume long, total_bytes long, rate_1m long, bytes_1m long, bytes_per_sec double, baseline_15m double, last_seen timestamp"
    declared = spark.createDataFrame([("d", "a", "b", 1.0, 0, 0, 0, 0, 0.0, 0.0, None)], cols)
    snap = spark.createDataFrame([("d", "z", "z", 9.0, 7, 70, 5, 50, 1.0, 3.0, None), ("n", "a", "c", 0.0, 4, 40, 8, 80, 2.0, 1.5, None)], cols)
    got = {r.edge_id: r for r in G.merge_history(declared, snap).collect()}
    assert (got["d"].source, got["d"].expected_min_rate, got["d"].total_volume, got["d"].baseline_15m, got["d"].rate_1m) == ("a", 1.0, 7, 3.0, 0)
    assert (got["n"].total_volume, got["n"].rate_1m, got["n"].bytes_per_sec) == (4, 0, 0.0)


def edge_row(**kw):
    base = dict(edge_id="e", source="a", target="b", protocol="tcp", is_declared=True, expected_min_rate=0.0, total_volume=10,
                rate_1m=0, baseline_15m=0.0, ago=10)
    return tuple({**base, **kw}.values())


@pytest.mark.parametrize("row,status,types", [
    (edge_row(expected_min_rate=2.0, ago=121), "SILENT", [("SILENT_LINK", "critical")]),
    (edge_row(expected_min_rate=1.0, ago=121), "SILENT", [("SILENT_LINK", "warning")]),
    (edge_row(expected_min_rate=1.0, ago=120), "HEALTHY", []),
    (edge_row(is_declared=False, rate_1m=40, baseline_15m=10.0), "SURGING", [("NOVEL_EDGE", "warning"), ("FLOW_SURGE", "warning")]),
    (edge_row(rate_1m=29, baseline_15m=1.0), "HEALTHY", []), (edge_row(rate_1m=30, baseline_15m=10.0), "SURGING", [("FLOW_SURGE", "warning")]),
    (edge_row(rate_1m=3, baseline_15m=20.0), "STARVED", [("STARVATION", "notice")]),
    (edge_row(rate_1m=4, baseline_15m=20.0), "HEALTHY", []), (edge_row(rate_1m=0, baseline_15m=20.0, ago=121), "HEALTHY", [])])
def test_shifts(spark, row, status, types):
    edges = spark.createDataFrame([row], "edge_id string, source string, target string, protocol string, is_declared boolean, "
                                  "expected_min_rate double, total_volume long, rate_1m long, baseline_15m double, ago long")
    edges = edges.withColumn("last_seen", F.timestamp_seconds(F.lit(10_000) - F.col("ago")))
    judged = G.judge_edges(edges, "1970-01-01 02:46:40").first()
    assert judged.status == status and [(s.type, s.severity) for s in judged.shifts] == types


def burst(spark, per_minute, last):
    rows = [(m * 60 + 1, "unstructured" if i % 2 else "e") for m in range(14) for i in range(per_minute)] + [(870 + i * 29 // last, "e") for i in range(last)]
    return spark.createDataFrame(rows, "s long, event string").select(F.timestamp_seconds("s").alias("timestamp"), "event",
                                                                      F.create_map(F.lit("instance"), F.lit("h")).alias("labels"))


def test_default_spike_thresholds(spark):
    assert anomaly.rate_spikes(burst(spark, 4, 60), "1970-01-01 00:15:00").count() == 1
    assert anomaly.rate_spikes(burst(spark, 4, 29), "1970-01-01 00:15:00").count() == 0
    assert anomaly.rate_spikes(burst(spark, 60, 61), "1970-01-01 00:15:00").count() == 0


def test_cooldown_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.randrange(5000)) for _ in range(800)]
    df = spark.createDataFrame(rows, "key string, s long").withColumn("timestamp", F.timestamp_seconds("s"))
    want = set()
    for key in "ab":
        last = None
        for s in sorted(s for k, s in rows if k == key):
            if last is None or s - last >= 300:
                last = s
                want.add((key, s))
    assert {(r.key, r.second) for r in alerts.with_cooldown(df, 300).collect()} == want


def test_longest_prefix_wins(spark):
    blocks = spark.createDataFrame([("NA", "10.0.0.0/8", "", "r", "a", "wide"), ("AS2", "10.1.0.0/16", "NL", "r", "a", "narrow"), ("AS3", "bad", "NL", "r", "a", "x")],
                                   "asn string, prefix string, country string, registry string, allocated string, org string")
    got = {r.ip: r for r in O.owners_by_prefix(spark.createDataFrame([("10.1.2.3",), ("10.9.9.9",), ("11.0.0.1",)], "ip string"), blocks).collect()}
    assert got["10.1.2.3"].org == "narrow" and (got["10.9.9.9"].org, got["10.9.9.9"].asn, got["10.9.9.9"].country) == ("wide", None, None)
    assert "11.0.0.1" not in got


def test_unlimited_scans_are_not_cut(spark):
    many = spark.range(250_000).select(F.col("id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id")).alias("timestamp"), F.lit("e").alias("event"),
                                       F.lit("GET HTTP/1.1").alias("raw"), F.create_map(F.lit("instance"), F.lit("h")).alias("labels"), F.expr("map('a', 'b')").alias("kv"))
    all_rows = S.search_with_truncation(many, None, q="HTTP/1.1").first()
    assert (all_rows.matched, all_rows.returned, all_rows.truncated, all_rows.note) == (250_000, 250_000, False, None)
    some = S.search_with_truncation(many, 200_001, q="HTTP/1.1").first()
    assert (some.returned, some.truncated) == (200_001, True)
    assert S.search_logs(many, None).count() == 250_000 and S.surface_search(many, 10**9).count() == 1000
    with pytest.raises(ValueError):
        S.search_logs(many, 0)


def test_processes_of_internal_edges(spark):
    edges = spark.createDataFrame([("h1:a", "h1:b", 1.0, 2.0), ("h1:a", "x", 1.0, 2.0), ("x", "h1", 1.0, 2.0)], "source string, target string, rate_1m double, bytes_per_sec double")
    got = {r.direction: r.processes for r in G.host_flow_summary(G.host_flows(edges, "h1")).collect()}
    assert got == {"internal": ["a", "b"], "outbound": ["a"], "inbound": []}


def test_alarms_age_out(spark):
    at = lambda k, n, z: ("rate_spike", "h", "e", k, n, 10, z, 1.0)
    ticks = spark.createDataFrame([at(0, 100, 9.0), at(60, 5, 3.0), at(60 + 900, 5, 3.0), at(60 + 900 + 901, 5, 3.0), at(4000, 100, 9.0)],
                                  "kind string, instance string, event string, s long, n long, buckets long, measure double, avg_1m double")
    rows = anomaly.hysteresis(ticks.withColumn("tick", F.timestamp_seconds("s"))).orderBy("s").collect()
    assert [r.active for r in rows] == [True, True, True, False, True]


def test_longest_prefix_of_both_families(spark):
    blocks = spark.createDataFrame([("a", "10.0.0.0/8"), ("b", "10.1.0.0/16"), ("c", "2001:db8::/32"), ("d", "2001:db8:0:1::/64"), ("e", "0.0.0.0/0"), ("f", "junk")], "asn string, prefix string")
    for c in ("country", "registry", "allocated", "org"):
        blocks = blocks.withColumn(c, F.lit("x"))
    ips = spark.createDataFrame([("10.1.2.3",), ("10.9.9.9",), ("192.0.2.1",), ("2001:db8::5",), ("2001:DB8:0:1::5",), ("2001:db9::",), ("::1",), ("host",), (None,)], "ip string")
    assert {r.ip: r.asn for r in O.owners_by_prefix(ips, blocks).collect()} == {
        "10.1.2.3": "b", "10.9.9.9": "a", "192.0.2.1": "e", "2001:db8::5": "c", "2001:DB8:0:1::5": "d"}
    assert O.owners_by_prefix(ips, blocks.limit(0)).count() == 0


def test_node_type_follows_the_first_sighting(spark):
    edges = spark.createDataFrame([("a", "b", 1, 2), ("b", "c", 5, 6)], "source string, target string, f long, l long").select(
        "source", "target", F.timestamp_seconds("f").alias("first_seen"), F.timestamp_seconds("l").alias("last_seen"))
    top = TY.Topology(spark.createDataFrame([], "id string, name string, type string, ip string, ips array<string>, role string"), None)
    assert {r.id: r.type for r in G.graph_nodes(edges, top).collect()} == {"a": "client", "b": "service", "c": "service"}
