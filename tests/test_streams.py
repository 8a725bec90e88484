"""Streams: results that do not depend on how input is cut, transactions that can be run again, restarts."""

import pytest
from pyspark.sql import functions as F

from driver import streams as DS
from fleetsift.operators import findings as N
from fleetsift.schema import FINDING
from fleetsift.session import scratch_path
from fleetsift.sources import feed as FD
from fleetsift.streaming import evaluation as SE, mixed as MX, sources as SS
from fleetsift.streaming.versions import VersionedTable
from fleetsift.operators.templates import Rule

BEGIN = 1704067200


def staged(spark, rows, cuts):
    """Rows (second, event, instance) as one file for each stretch of time."""
    path = scratch_path(spark, "test-rows")
    for a, b in zip((0, *cuts), (*cuts, 10 ** 9)):
        part = [(k, s, e, i) for k, (s, e, i) in enumerate(rows) if a <= s < b]
        (spark.createDataFrame(part, "id long, s long, event string, instance string").select(
            "id", F.timestamp_seconds(F.col("s") + BEGIN).alias("timestamp"), "event", F.create_map(F.lit("instance"), "instance").alias("labels"),
            F.expr("cast(map() AS map<string,string>)").alias("kv"), F.lit(0.0).alias("latency_us"), F.lit("x").alias("raw"))
         .coalesce(1).write.mode("append").parquet(path))
    return path


def incidents():
    """One key at a steady pace, then a burst, then silence; another goes on to move the clock."""
    rows = [(s, "tick", "a") for s in range(0, 600, 5)] + [(600 + s // 4, "tick", "a") for s in range(240)]
    return rows + [(s, "tock", "b") for s in range(0, 2400, 7)]


@pytest.mark.parametrize("cuts", [(), (450,), (100, 610, 655, 1200, 1800)])
def test_anomalies_do_not_depend_on_batches(spark, cuts):
    stream = SS.timed(SS.event_stream(spark, staged(spark, incidents(), cuts), files_per_trigger=1), as_of="2024-01-31 00:00:00", delay="0 seconds")
    got = DS._drain(spark, SE.anomaly_turns(stream, "2024-01-01 00:00:00", warmup_s=300, cooldown_s=45), "test-anomalies")
    rows = sorted((r["instance"], r["turn"].timestamp() - BEGIN, r["change"], r["sent"]) for r in got.where("kind = 'rate_spike'").collect())
    assert [r for r in rows if r[0] == "b"] == []
    changes = [(c, t) for _, t, c, _ in rows if c]
    # 60 rows a quarter minute against 12 a minute before; high from the first turn with 30, over when z is below 2.
    assert [c for c, _ in changes] == ["raised", "cleared"] and changes[0][1] == 615
    sent = [t for _, t, _, s in rows if s]
    assert sent[0] == 615 and all(b - a >= 45 for a, b in zip(sent, sent[1:])) and len(sent) >= 2


def test_a_key_that_falls_silent_ages_out(spark):
    rows = [(s, "tick", "a") for s in range(0, 300, 10)] + [(300 + s // 4, "tick", "a") for s in range(240)] + [(s, "tock", "b") for s in range(0, 2400, 7)]
    stream = SS.timed(SS.event_stream(spark, staged(spark, rows, (200, 1000)), files_per_trigger=1), as_of="2024-01-31 00:00:00", delay="0 seconds")
    turns = SE.anomaly_turns(stream, "2024-01-01 00:00:00", warmup_s=0, clear_z=-1e9)
    got = DS._drain(spark, turns, "test-aged").where("kind = 'rate_spike' AND change IS NOT NULL").orderBy("turn").collect()
    assert [(r["instance"], r["change"]) for r in got] == [("a", "raised"), ("a", "aged")]
    assert got[1]["turn"].timestamp() - BEGIN == 1260  # the window of 900 s holds nothing any more: the last rows ended at 360


def finding(spark, subject, state="new"):
    values = {"fingerprint": subject, "kind": "threat_actor", "subject": subject, "state": state, "occurrences": 1}
    return spark.createDataFrame([tuple(values.get(f.name) for f in FINDING)], FINDING)


def test_versions_commit_once_and_skip_what_was_not_committed(spark):
    path = scratch_path(spark, "versions")
    table = VersionedTable(spark, path, FINDING)
    assert table.latest()["n"] == 0 and table.read().count() == 0
    table.commit(finding(spark, "a"), table.latest(), "run", 0, None, None, None)
    finding(spark, "lost").write.parquet(f"{path}/data/v2-of-a-writer-that-died")
    again = VersionedTable(spark, path, FINDING)
    assert again.made_by("run", 0) and not again.made_by("run", 1) and not again.made_by("other", 0)
    assert [r["subject"] for r in again.read().collect()] == ["a"]
    first = again.commits().where("n = 0").first()
    with pytest.raises(Exception):
        again.commit(finding(spark, "b"), first, "run", 1, None, None, None)
    assert [r["subject"] for r in again.read().collect()] == ["a"]


def test_a_transaction_run_again_replaces_itself(spark, tmp_path):
    for k, lines in enumerate((["user=a did x", "plain", "", "user=a did x"], ["user=b did y"])):
        (tmp_path / f"in{k}.log").write_text("\n".join(lines) + "\n")
    rules = [Rule.of("did", r"user=(?P<user>\w+) did (?P<what>\w+)")]
    out = scratch_path(spark, "txn")
    feed = FD.read_feed(FD.read_bodies(spark, str(tmp_path)), "text", {"source": "t"})
    for _ in range(2):
        counts = MX.write_outcomes(feed, rules, out, "one", "2024-01-31 00:00:00", "text")
    assert (counts["matched"], counts["unstructured"]) == (3, 1)
    rows = MX.stored_log(spark, out).collect()
    assert sorted((r["event"], r["raw"]) for r in rows) == [("did", "user=a did x")] * 2 + [("did", "user=b did y"), ("unstructured", "plain")]
    assert len({r["id"] for r in rows}) == 4
    stream = FD.read_feed(FD.read_bodies(spark, str(tmp_path), True, files_per_trigger=1), "text", {"source": "t"})
    other = scratch_path(spark, "txn-stream")
    SS.finish(stream.writeStream.foreachBatch(MX.mixed_writer(rules, other, "t", "2024-01-31 00:00:00"))
              .option("checkpointLocation", scratch_path(spark, "txn-state")).trigger(availableNow=True).start())
    assert {r["id"] for r in MX.stored_log(spark, other).collect()} == {r["id"] for r in rows}
    assert MX.accounts(spark, other).first()["total"] == 4


def test_feeds_say_what_they_refuse(spark):
    body = lambda *texts: spark.createDataFrame([("f", 0, k, t) for k, t in enumerate(texts)], FD.BODY)
    rows = lambda df: [(r["reason"], r["raw"] or (r["doc"] and "doc")) for r in df.orderBy("reason", "raw").collect()]
    assert rows(FD.read_feed(body("[1, {\"a\": 2}]", "{", " ", "{\"b\": 1}"), "ecs")) == [(None, "doc"), (None, "doc"), ("no object", "doc"), ("not JSON", None)]
    assert rows(FD.read_feed(body('["a", " ", {"line": "b"}]', "{no", '{"labels": {"x": "y"}, "lines": ["c"]}'), "json")) == [
        (None, "a"), (None, "b"), (None, "c"), ("not JSON", None)]
    assert rows(FD.read_feed(body('{"streams": [{"stream": {}, "values": [["1", "a"], ["x", "b"], ["2"]]}]}', "{}", "nope"), "streams")) == [
        (None, "a"), ("no stream", None), ("not JSON", None), ("short entry", None), ("short entry", None)]
    with pytest.raises(ValueError):
        FD.read_feed(body("a"), "other")


def test_search_over_all_feeds_is_not_cut(spark, monkeypatch):
    """The SQL has no limit; more than 100,000 rows match."""
    rows = spark.range(100_003).select("id", F.timestamp_seconds(F.lit(BEGIN) + F.col("id")).alias("timestamp"), F.lit("web.access").alias("event"),
                                       F.create_map(F.lit("peer_ip"), F.lit("198.51.100.8")).alias("kv"), F.lit("h").alias("instance"), F.lit("x").alias("raw"))
    other = rows.withColumn("kv", F.create_map(F.lit("peer_ip"), F.lit("198.51.100.9"))).limit(7)
    monkeypatch.setattr(DS, "_mixed", lambda s, d: d)
    monkeypatch.setattr(DS.MX, "stored_log", lambda s, path: rows.unionByName(other))
    got = DS.mixed_search(spark, "unused")
    assert got.count() == 100_003 and got.agg(F.min("at_us")).first()[0] == BEGIN * 1_000_000
