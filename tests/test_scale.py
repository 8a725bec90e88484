"""What a plan must not do twice, and steps that must keep their cost where tables grow."""

import pytest
from pyspark.sql import functions as F

from fleetsift.functions import values
from fleetsift.operators import mining


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def events_dir(spark, tmp_path):
    rows = [(k, k % 7, ("view", "click", "purchase", "signup", "error")[k % 5], f'{{"k": {k % 100}}}', k) for k in range(400)]
    (spark.createDataFrame(rows, "event_id long, user_id long, event_type string, props string, s long")
     .select("event_id", "user_id", "event_type", "props", F.timestamp_seconds(F.lit(1704067200) + F.col("s") * 60).alias("ts"))
     .coalesce(1).write.parquet(f"{tmp_path}/events.parquet"))
    return str(tmp_path)


def test_fields_are_normalized_once(spark, events_dir):
    from driver import queries as Q
    found = Q.normalized_fields(spark, events_dir)
    assert optimized(found).count("aggregate(") == 1
    assert "Filter" not in optimized(found)
    assert {r.key: r.value for r in found.where("event_id = 3").collect()}["host"] == "web-3"


def test_upper_case_keys_and_bare_names(spark):
    kv = F.expr("map('SRC_ADDR', ' 10.0.0.1 ', 'Peer', '10.0.0.2:80', 'peer_ip', '10.0.0.9', 'pid', '7', 'empty', '', 'none', cast(null as string))")
    got = spark.range(1).select(values.normalize_fields(kv).alias("m")).first().m
    assert got == {"src_ip": " 10.0.0.1 ", "peer_ip": "10.0.0.9", "peer_port": "80", "pid": "7", "empty": "", "none": None,
                   "ip": " 10.0.0.1 ", "port": "80"}


def test_lines_are_masked_once_and_rules_made_of_clusters_only(spark):
    lines = spark.range(60).select("id", F.timestamp_seconds("id").alias("timestamp"), F.format_string("unit %d took %d ms, see /a/b%d", F.col("id") % 2, "id", "id").alias("raw"))
    clusters = mining.cluster_skeletons(lines)
    assert "regexp_replace" not in optimized(clusters)
    made = mining.synthesize_rules(clusters)
    assert not [line for line in optimized(made).split("\n") if "Filter" in line and "regexp" in line]
    assert made.count() == clusters.count() == 1
    assert clusters.first().n == 60 and clusters.first().samples == [f"unit {k % 2} took {k} ms, see /a/b{k}" for k in range(3)]


def test_turns_look_at_their_window_only():
    from fleetsift.streaming.evaluation import Anomalies

    class Store:
        def exists(self): return self.row is not None
        def get(self): return self.row
        def update(self, row): self.row = row
        def clear(self): self.row = None

    class Handle:
        def getValueState(self, *_): return store
        def registerTimer(self, _): pass

    store, seen, judge = Store(), [], Anomalies(None, dict(window_s=300, warmup_s=0))
    ends = [t * 15 for t in range(1, 2001) if t % 7 and not 900 < t < 1000]
    store.row = (ends[0], None, None, None, ends, [5] * len(ends), [5] * len(ends), [float(t) for t in ends])
    judge.init(Handle())
    inner = judge.judge
    judge.judge = lambda key, at, held: (seen.append((at, list(held["at"]), held["heard"])), inner(key, at, held))[1]
    timer = type("T", (), {"getCurrentWatermarkInMs": staticmethod(lambda: 28000 * 1000)})
    list(judge.handleExpiredTimer(("rate_spike", "i", "e"), timer, None))
    assert [at for at, _, _ in seen] == list(range(15, 28001, 15))
    assert max(len(at) for _, at, _ in seen) <= 300 // 15 + 1
    for at, held, heard in seen:
        assert [t for t in held if t <= at] == [t for t in ends if at - 300 < t <= at]
        assert heard == max([float(t) for t in ends if t <= at])
    assert store.row[4] == [t for t in ends if t > 27990 - 300]


def test_slices_of_many_files_in_the_order_of_time(spark, events_dir, monkeypatch):
    from pathlib import Path
    from driver import streams as ST
    got = {}
    for size in (10 ** 9, 20):
        monkeypatch.setattr(ST, "FILE_ROWS", size)
        monkeypatch.setattr(ST, "_STAGED", {})
        rows = sorted(map(tuple, ST.stream_anomaly_changes(spark, events_dir).collect()))
        (path, files), = ST._STAGED.values()
        parts = sorted(Path(path).glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
        assert len(parts) == 3 * files
        slices = [spark.read.parquet(*map(str, parts[k * files:(k + 1) * files])).agg(F.min("timestamp"), F.max("timestamp")).first() for k in range(3)]
        assert all(a[1] < b[0] for a, b in zip(slices, slices[1:]))
        got[size] = files, rows
    assert got[10 ** 9][0] == 1 and got[20][0] > 3 and got[20][1] == got[10 ** 9][1]


@pytest.mark.parametrize("kind", ["text", "json", "streams", "ecs"])
def test_feeds_are_parsed_once(spark, tmp_path, kind):
    from fleetsift.sources import feed as FD
    spark.createDataFrame([("{}",), ('["a", "b"]',)], "value string").write.text(f"{tmp_path}/in")
    feed = FD.read_feed(FD.read_bodies(spark, f"{tmp_path}/in"), kind)
    assert not [line for line in optimized(feed).split("\n") if "Filter" in line and "size(" in line]
    assert feed.count() == {"text": 2, "json": 3, "streams": 2, "ecs": 3}[kind]


def test_documents_are_mapped_once_and_edges_built_once(spark, events_dir):
    from driver import queries as Q
    assert "Repartition" not in optimized(Q.ecs_value_search(spark, events_dir))
    Q.log(spark, events_dir, "compressed")
    plan = optimized(Q.fleet_metrics(spark, events_dir))
    assert sum("Relation" in line and "latency_us" in line for line in plan.split("\n")) <= 5
