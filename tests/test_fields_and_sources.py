import json
import re

import pytest
from pyspark.sql import functions as F

from fleetsift import fixed_values as V
from fleetsift.functions import documents, lines as L, times, values
from fleetsift.functions.access import parse_access
from fleetsift.operators import mining, templates as TP
from fleetsift.plans import ingest
from fleetsift.sources import ecs, events as EV, lines as LN, topology as TY


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_normalize(spark):
    norm = lambda kv: one(spark, values.normalize_fields(F.create_map(*[F.lit(x) for p in kv.items() for x in p])))
    assert norm({"remote_addr": "10.0.0.2"}) == {"remote_ip": "10.0.0.2", "ip": "10.0.0.2"}
    assert norm({"src": "10.0.0.1", "dst": "10.0.0.2"}) == {"src_ip": "10.0.0.1", "dst_ip": "10.0.0.2", "ip": "10.0.0.1"}
    assert norm({"hostname": "hub"}) == {"host": "hub"}
    assert norm({"name": "com.apple.authd"}) == {"name": "com.apple.authd"}
    assert norm({"peer": "10.0.0.1:443"}) == {"peer_ip": "10.0.0.1", "peer_port": "443", "ip": "10.0.0.1", "port": "443"}
    assert norm({"ip": "10.0.0.1", "addr": "10.0.0.2"}) == {"ip": "10.0.0.1", "addr": "10.0.0.2"}


def test_times(spark):
    us = lambda c: one(spark, F.unix_micros(c))
    assert us(times.parse_ts(F.lit("2026-09-15T00:00:00Z"))) == us(times.parse_ts(F.lit("2026-09-15T02:00:00+02:00")))
    assert us(times.parse_ts(F.lit("1700000000"))) == us(times.parse_ts(F.lit("1700000000000"))) == 1700000000 * 10**6
    assert us(times.parse_ts(F.lit("tuesday"))) is None and us(times.ns_to_ts(F.lit("-1"))) is None
    assert us(times.clf_time(F.lit("15/Sep/2026:06:04:42 +0000"))) - us(times.clf_time(F.lit("15/Sep/2026:06:04:42 +0100"))) == 3600 * 10**6
    assert us(times.clf_time(F.lit("31/Foo/2026:06:04:42"))) is None and us(times.clf_time(F.lit("31/Feb/2026:06:04:42"))) is None
    kept = one(spark, times.clamp_ts(F.lit("2031-01-01").cast("timestamp"), "2026-01-01"))
    old = one(spark, times.clamp_ts(F.lit("2001-01-01").cast("timestamp"), "2026-01-01"))
    assert kept.ts is None and kept.suspect is not None and old.ts is not None


def test_durations():
    assert times.search_window("15m") == 900 and times.search_window("90") == 90 and times.search_window("x") is None
    assert times.stream_window("1d") == 86400 and times.stream_window("") == 900
    with pytest.raises(ValueError):
        times.stream_window("soon")
    assert times.retention_window("2w") == 14 * 86400 and times.retention_window("off") is None
    assert times.retention_window() == 30 * 86400
    for bad in ("7", "1m", "59m", "5y"):
        with pytest.raises(ValueError):
            times.retention_window(bad)


def test_skeletons_against_the_rule_language(spark, sf):
    """Whole documents and lines with many shapes, masked by Spark and by Python's re."""
    def masked(text):
        for pattern, mask in V.SKELETON_MASKS:
            text = re.sub(pattern, mask.replace("$1", r"\1"), text)
        return text
    made = ["2026-09-15T00:00:00Z x 10.0.0.1:80 aa:bb:cc:dd:ee:ff 0xdeadbeef /var/log/x 'a b' \"q\" id42 7ms from hub process=nginx",
            "pid=475075 deadbeef 123456 peer=- user=ann zone eu-1 [15/Sep/2026:06:00:00 +0000]"]
    docs = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + made
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i long, raw string")
    got = {r.i: r.s for r in rows.select("i", mining.skeleton(F.col("raw")).alias("s")).collect()}
    assert [got[i] for i in range(len(docs))] == [masked(d) for d in docs]


FAMILY = ["netsnap proto=tcp state=established local=10.0.0.1 local_port=22 peer=10.0.0.%d peer_port=%d process=%s pid=%d" % (i, 40000 + i, p, 1200 * 40 ** i)
          for i, p in enumerate(["sshd", "docker-proxy", "systemd-resolve"])]
WALL = ["[UFW BLOCK] IN=eth0 MAC=aa:bb:cc:dd:ee:f%d:00:11 SRC=10.0.0.%d DST=10.0.0.9 LEN=%d" % (i, i, 40 + i) for i in range(3)]
WEB = ['203.0.113.%d - - [15/Sep/2026:06:00:0%d +0000] "GET /%d HTTP/1.1" 404 %d "-" "ua %d"' % (i, i, i, 100 + i, i) for i in range(3)]


def lines_df(spark, lines):
    return spark.createDataFrame([(i, l) for i, l in enumerate(lines)], "id long, raw string").withColumn("timestamp", F.timestamp_seconds("id"))


@pytest.mark.parametrize("family", [FAMILY, WALL, WEB])
def test_learned_rules_match_their_family(spark, family):
    clusters = mining.cluster_skeletons(lines_df(spark, family))
    assert clusters.count() == 1
    rule = mining.validate_rules(mining.synthesize_rules(clusters)).first()
    assert rule.samples == family
    compiled = re.compile(rule.pattern)
    assert all(compiled.search(l).end() - compiled.search(l).start() >= 0.7 * len(l) for l in family)
    assert sorted(compiled.groupindex) == rule.fields
    matched = TP.match_templates(lines_df(spark, family), [TP.Rule.of(rule.event, rule.pattern)])
    assert {r.event for r in matched.collect()} == {rule.event}


def rules_df(spark, rows):
    return spark.createDataFrame([(i, e, p, [], 0, None, "base") for i, (e, p) in enumerate(rows)],
                                 "priority long, event string, pattern string, fields array<string>, hit_count long, created_at timestamp, origin string")


def test_rule_identity_is_the_pattern(spark):
    rules = rules_df(spark, [("a", "one"), ("a_2", "two")])
    new = spark.createDataFrame([(0, "a", "three", [], None), (1, "b", "one", [], None), (2, "a", "four", [], None), (3, "c", "four", [], None)],
                                "seq long, event string, pattern string, fields array<string>, created_at timestamp")
    got = TP.add_rules(rules, new).orderBy("priority").select("event", "pattern").collect()
    assert [tuple(r) for r in got] == [("a_4", "four"), ("a_3", "three"), ("a", "one"), ("a_2", "two")]


def test_first_rule_wins_and_short_matches_do_not_count(spark):
    rules = [TP.Rule.of("short", r"(?P<ip>[\d.]+)"), TP.Rule.of("long", r"peer (?P<ip>[\d.]+) is (?P<state>\w+)"), TP.Rule.of("late", r"peer .*")]
    got = TP.match_templates(lines_df(spark, ["peer 10.0.0.1 is up", "something else"]), rules).orderBy("id").collect()
    assert (got[0].event, got[0].kv) == ("long", {"ip": "10.0.0.1", "state": "up"})
    assert (got[1].event, got[1].kv) == ("unstructured", {})


def test_ecs_mapping(spark):
    docs = [{"@timestamp": "2026-01-01T00:00:00Z", "message": "hi", "host": {"name": "h"}, "event.dataset": "nginx.access",
             "source": {"ip": "203.0.113.7", "port": 99}, "url.path": "/x", "http": {"response": {"status_code": 404}}, "extra": {"deep": {"n": 5}}, "tags": ["a"]},
            {"client": {"address": "203.0.113.8"}, "url": {"original": "/y"}}, {"nothing": 1},
            {"message": "later", "@timestamp": "2040-01-01T00:00:00Z"}]
    body = spark.createDataFrame([(json.dumps(docs),), ("not json",), ('["text"]',)], "value string")
    rows = ingest.ingest_documents(ecs.decode_documents(body), "2026-01-02 00:00:00")
    by = {(r.raw or "")[:12]: r for r in rows.collect() if r.status == "structured"}
    first = by["hi"]
    assert first.event == "nginx.access" and first.labels == {"protocol": "ecs", "instance": "h", "source": "nginx.access"}
    assert first.kv["status"] == "404" and first.kv["ip"] == "203.0.113.7" and first.kv["extra.deep.n"] == "5" and "url.path" not in first.kv
    synth = by["203.0.113.8 "]
    parsed = one(spark, parse_access(F.lit(synth.raw)))
    assert (parsed.ip, parsed.path, parsed.status) == ("203.0.113.8", "/y", "000")
    assert by["later"].ts is None and "_ts_suspect" in by["later"].kv
    assert EV.ingest_accounting(rows).first().rejected == 3


def test_json_bodies_and_streams(spark):
    bodies = ['["a", {"line": "b"}]', '{"labels": {"protocol": "x"}, "lines": ["c", ""]}', '{"line": "d"}', '{"other": 1}', "bad"]
    rows = LN.json_lines_of(spark.createDataFrame([(b,) for b in bodies], "value string")).collect()
    assert sorted(r.raw for r in rows) == ["a", "b", "c", "d", '{"other":1}']
    assert {r.raw: r.labels["protocol"] for r in rows}["c"] == "x"
    payload = {"streams": [{"stream": {"a": "1"}, "values": [["20", "late"], ["10", "early"], ["x", "bad"], ["5"]]}]}
    got = LN.read_log_streams(spark.createDataFrame([(json.dumps(payload),)], "value string")).collect()
    assert [(r.ts_ns, r.line) for r in got] == [(10, "early"), (20, "late")]
    assert one(spark, L.parse_stream_labels(F.lit('{a="1",b="2",a="3"}'))) == {"a": "3", "b": "2"}


def test_socket_snapshot(spark):
    lines = ['tcp 0 0 10.0.0.1%eth0:22 198.51.100.7:50000 users:(("sshd",pid=7,fd=3))', "tcp 0 0 10.0.0.1:22 127.0.0.1:1",
             "udp 0 0 [fe80::1]:53 [2001:db8::1]:443", "tcp 0 0"]
    rows = LN.parse_socket_snapshot(spark.createDataFrame([(l,) for l in lines], "value string")).collect()
    assert [(r.local, r.peer, r.peer_port, r.process, r.pid) for r in rows] == [
        ("10.0.0.1", "198.51.100.7", "50000", "sshd", "7"), ("fe80::1", "2001:db8::1", "443", "-", "-")]


def test_noise_and_alarms(spark):
    noise = lambda raw, labels: one(spark, L.is_noise(F.lit(raw), F.create_map(*[F.lit(x) for p in labels.items() for x in p])))
    assert noise("[Graph] x", {"a": "b"}) and noise("x", {"unit": "ollama.service"}) and noise("x task.n_tokens y", {"a": "b"})
    assert not noise("a [Graph] x", {"unit": "nginx.service"})
    assert one(spark, L.is_critical(F.lit("kernel: Out of memory"))) and not one(spark, L.is_critical(F.lit("panicking")))


def test_topology_file(spark, tmp_path):
    path = tmp_path / "topology.json"
    path.write_text(json.dumps({"self": "hub", "nodes": [{"id": "hub", "ip": "10.0.0.1", "ips": ["10.0.0.2"]}, {"name": "no id"}],
                                "edges": [{"source": "hub", "target": "x"}, {"source": "hub"}]}))
    top = TY.read_topology(spark, str(path))
    node = top.nodes.first()
    assert (node.name, node.type, node.ips) == ("hub", "server", ["10.0.0.1", "10.0.0.2"])
    edge = top.edges.first()
    assert (edge.protocol, edge.channel, edge.expected_min_rate, top.edges.count()) == ("tcp", "default", 0.0, 1)
    assert TY.read_topology(spark, str(tmp_path / "none.json")).nodes.count() == 0
    broken = tmp_path / "broken.json"
    broken.write_text("{nope")
    assert TY.read_topology(spark, str(broken)).nodes.count() == 0


def test_flatten(spark):
    v = F.try_parse_json(F.lit('{"a":{"b":1,"c":{}},"x.y":[1],"n":null}'))
    flat = one(spark, F.transform_values(documents.flatten_json(v), lambda _, x: F.to_json(x)))
    assert flat == {"a.b": "1", "a.c": "{}", "x.y": "[1]", "n": "null"}


def test_rules_follow_python(spark):
    rules = [TP.Rule.of("twice", r"(?P<q>['\"]).*(?P=q) said"), TP.Rule.of("word", r"user=(?P<u>\w+)(?: from (?P<src>\S+))?"), TP.Rule.of("digits", r"n\d+")]
    got = TP.match_templates(lines_df(spark, ["user=m\u00fcller\u00df", "'a b' said", "user=x from 10.0.0.1", "  n12345 ", "n1 and then a lot of other text", ""]), rules)
    rows = [(r.event, r.kv) for r in got.orderBy("id").collect()]
    assert rows[0][0] == "word" and rows[0][1]["u"] == "m\u00fcller\u00df"
    assert [e for e, _ in rows[1:]] == ["twice", "word", "digits", "unstructured", "unstructured"] and rows[4][1] == {}


def test_rules_that_do_not_compile_are_told(spark):
    rules = rules_df(spark, [("good", "a+"), ("bad", "(x"), ("worse", "(?P=q)")])
    assert [r.event for r in TP.read_rules(rules)] == ["good"]
    assert {r.event: bool(r.reason) for r in TP.rejected_rules(rules).collect()} == {"bad": True, "worse": True}


def test_plan_does_not_grow_with_the_rules(spark):
    size = lambda n: len(TP.match_templates(lines_df(spark, ["x"]), [TP.Rule.of(f"e{k}", f"text {k} (?P<f{k}>.*)") for k in range(n)])._jdf.queryExecution().toString())
    assert size(1400) < 1.2 * size(5)


def test_objects_ten_levels_deep(spark):
    deep = "1"
    for k in range(10, 0, -1):
        deep = '{"k%d": %s, "t": "}{"}' % (k, deep)
    v = spark.createDataFrame([(deep,), ('{"a": [1, {"b": 2}]}',), ("[]",), (None,)], "value string").select(F.try_parse_json("value").alias("v"))
    assert documents.deepest(v, "v") == 10
    keys = v.select(F.explode(documents.flatten_json(F.col("v"), documents.deepest(v, "v"))).alias("k", "x")).select("k").collect()
    assert ".".join(f"k{k}" for k in range(1, 11)) in {r.k for r in keys}


def test_every_reader_reaches_the_store(spark, tmp_path):
    from fleetsift.operators import search as S
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("peer 10.0.0.1 is up\n\n  peer 10.0.0.2 is down \n")
    bodies = spark.createDataFrame([('["peer 10.0.0.3 is up", {"line": "x"}]',), ("{broken",)], "value string")
    streams = spark.createDataFrame([('{"streams": [{"stream": {"job": "j"}, "values": [["1704067200000000000", "peer 10.0.0.4 is up"], ["x", "y"]]}]}',)], "value string")
    rules = [TP.Rule.of("peer", r"peer (?P<ip>[\d.]+) is (?P<state>\w+)")]
    parts = [LN.identified(LN.read_lines(spark, str(tmp_path / "in"))), LN.identified(LN.json_lines_of(bodies)), LN.identified(LN.log_stream_entries(streams))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    EV.write_events(ingest.to_store(ingest.ingest_lines(rows, rules, "2024-01-02 00:00:00")), str(tmp_path / "log"), ingested_at="2024-01-02 00:00:00")
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.select("id").distinct().count() == log.count() == 5
    assert [r.raw for r in S.search_logs(log, 10, kv="ip:10.0.0.4").collect()] == ["peer 10.0.0.4 is up"]
    assert log.where("event = 'peer'").count() == 4
    assert tuple(LN.rejected_bodies(bodies).first()) == (2, 1)
