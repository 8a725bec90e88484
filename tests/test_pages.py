"""The paged source: cursor, overlap, stops in mid-page, bodies that are none."""

from pyspark.sql import functions as F

from fleetsift.session import scratch_path
from fleetsift.streaming.pages import SECOND, PageReader, _entries, page_stream, write_pages
from fleetsift.streaming.sources import finish

BASE = 1_704_067_200


def entries(spark, seconds):
    return spark.createDataFrame([({"job": "a"}, (BASE + t) * SECOND + 5, f"line {t}") for t in seconds], "labels map<string,string>, ts_ns long, line string")


def run(spark, path, out, state, settle_s):
    stream = page_stream(spark, path, "2024-02-01 00:00:00", settle_s=settle_s).select("ts_ns", "line")
    finish(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start())
    return sorted((r["line"] for r in spark.read.schema("ts_ns long, line string").parquet(out).collect()), key=lambda x: int(x[5:]))


def test_each_entry_once_over_stops(spark):
    path, out, state = (scratch_path(spark, n) for n in ("pages", "out", "state"))
    write_pages(entries(spark, [t for t in range(100) if t not in (75, 95)]), path, "40 seconds")
    lines = lambda *skip: [f"line {t}" for t in range(100) if t not in skip]
    # The newest entry is at 99: with 15 seconds to settle the cursor stops in the page that begins at 80.
    assert run(spark, path, out, state, 15) == [x for x in lines(75) if int(x[5:]) <= 84]
    write_pages(entries(spark, [75, 95, 99]), path, "40 seconds")   # 75 is before the cursor; 99 is recorded twice
    assert run(spark, path, out, state, 0) == lines()
    assert run(spark, path, out, state, 0) == lines()
    write_pages(entries(spark, [10, 120]), path, "40 seconds")      # 10 is a page read long ago, recorded again
    assert run(spark, path, out, state, 0) == lines() + ["line 120"]


def test_only_pages_in_range_are_opened(spark):
    path = scratch_path(spark, "pages")
    write_pages(entries(spark, range(0, 400, 10)), path, "100 seconds")
    at = lambda t: {"cursor": (BASE + t) * SECOND + 5}
    reader = PageReader(path, -1, 30 * SECOND, 0)
    assert reader.latestOffset() == at(390)
    parts = reader.partitions(at(250), at(310))
    got = sorted(row[1] for p in parts for row in reader.read(p))
    assert got == [(BASE + t) * SECOND + 5 for t in range(230, 311, 10)]
    assert len({p.file.split("/first_ns=")[1].split("/")[0] for p in parts}) == 2
    assert reader.partitions(at(310), at(310)) == []


def test_empty_folder_and_bodies(spark):
    reader = PageReader(scratch_path(spark, "none"), -1, 0, 0)
    assert reader.latestOffset() == reader.initialOffset() == {"cursor": -1}
    assert list(_entries("no json")) == list(_entries("[1]")) == list(_entries("{}")) == []
    assert list(_entries('{"data":{"result":[{"stream":{"n":1},"values":[["7","x"],["bad","y"],["1"]]}]}}')) == [({"n": "1"}, 7, "x")]
