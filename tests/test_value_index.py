"""The value index against a scan: every kind of filter, typed fields, appends, retention, files read."""

import pytest
from pyspark.sql import functions as F

from fleetsift.operators import search as S
from fleetsift.session import scratch_path
from fleetsift.sources.events import apply_retention, write_events
from fleetsift.sources.value_index import ValueIndex

AS_OF = "2024-01-08 00:00:00"


def rows(spark, first, last):
    """One row an hour; typed fields on every third, a hot value on every second."""
    n = F.col("id")
    typed = F.parse_json(F.concat(F.lit('{"tags":["a'), n % 5, F.lit('", 7, null], "n": '), n % 4, F.lit(', "who": "u'), n % 7, F.lit('"}')))
    return spark.range(first, last, numPartitions=2).select(
        "id", F.timestamp_seconds(F.lit(1704067200) + n * 3600).alias("timestamp"), F.lit("e").alias("event"),
        F.create_map(F.lit("instance"), F.concat(F.lit("h"), n % 3)).alias("labels"),
        F.create_map(F.lit("who"), F.concat(F.lit("u"), n % 7), F.lit("hot"), F.when(n % 2 == 0, "x").otherwise(F.lit("u1")), F.lit("peer_port"), (n % 3).cast("string"),
                     F.lit("process"), F.lit("p"), F.lit("rare"), F.when(n == 5, "once"), F.lit("plain"), F.lit("a1")).alias("kv"),
        F.when(n % 3 == 0, typed.cast("map<string,variant>")).alias("kv_v"), F.lit(0.0).alias("latency_us"),
        F.concat(F.lit("row "), n).alias("raw"))


@pytest.fixture(scope="module")
def index(spark):
    index = ValueIndex(spark, scratch_path(spark, "table"), scratch_path(spark, "index"))
    write_events(rows(spark, 0, 72), index.table)
    assert index.refresh() > 0 and index.refresh() == 0
    write_events(rows(spark, 72, 150), index.table)
    assert index.behind() and index.refresh() > 0 and not index.behind()
    return index


FILTERS = [dict(value="u1"), dict(value="a1"), dict(value="a3"), dict(value="7"), dict(value="once"), dict(value="nobody"), dict(value="x"),
           dict(kv="who:u1"), dict(kv="hot:u1"), dict(port=0), dict(port=" 2 "), dict(process="p"), dict(port=1, process="p", value="u1"),
           dict(value="u1", q="row 1"), dict(value="u1", instance="h1"), dict(kv="who:u2", since_s=3 * 86400, as_of=AS_OF),
           dict(value="u1", start_time="2024-01-02 00:00:00", end_time="2024-01-04 05:00:00"), dict(q="row 14"), dict(port=" ", value="u3")]


@pytest.mark.parametrize("filters", FILTERS, ids=str)
@pytest.mark.parametrize("limit", [None, 5])
def test_same_as_a_scan(index, filters, limit):
    want = [r["id"] for r in S.search_logs(index.log(), limit, **filters).collect()]
    assert [r["id"] for r in index.search(limit, **filters).collect()] == want
    assert limit or index.count(**filters).first()["matched"] == len(want)


def test_reads_only_files_that_match(index):
    assert len(index.search(5, value="once").inputFiles()) == 1
    assert len(index.search(3, value="x").inputFiles()) <= 3 < len(index.log().inputFiles())


def test_many_files_are_scanned(index):
    assert sorted(r["id"] for r in index.search(None, most_files=1, value="x").collect()) == list(range(0, 150, 2))


def test_refused(index):
    for bad in (dict(value="a'b"), dict(kv="nokey")):
        with pytest.raises(ValueError):
            index.search(5, **bad)


def test_rows_not_indexed_yet_and_retention(spark):
    index = ValueIndex(spark, scratch_path(spark, "table"), scratch_path(spark, "index"))
    write_events(rows(spark, 0, 80), index.table)
    index.refresh()
    write_events(rows(spark, 80, 100), index.table)
    assert [r["id"] for r in index.search(4, value="x").collect()] == [98, 96, 94, 92]
    assert index.count(value="x").first()["matched"] == 50
    index.refresh()
    assert apply_retention(spark, index.table, "2024-01-05 00:00:00", "2d") > 0
    index.refresh()
    want = [r["id"] for r in S.search_logs(index.log(), None, value="u1").collect()]
    assert want and [r["id"] for r in index.search(None, value="u1").collect()] == want
    assert index.count(value="u1").first()["matched"] == len(want)


def test_empty_table(spark):
    index = ValueIndex(spark, scratch_path(spark, "table"), scratch_path(spark, "index"))
    write_events(rows(spark, 0, 1), index.table)
    index.refresh()
    assert index.search(5, value="nobody").collect() == []
