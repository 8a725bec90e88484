"""Streams in chunks of bounded size, one label set holding most lines."""

from pyspark.sql import functions as F

from fleetsift.sources.lines import chunk_streams


def test_hot_label_set(spark):
    n = F.col("id")
    entries = spark.range(3000, numPartitions=4).select(
        F.create_map(F.lit("job"), F.when(n % 3 > 0, "hot").otherwise(F.concat(F.lit("j"), n % 7))).alias("labels"),
        (n * 7919 % 1000).alias("ts_ns"), F.concat(F.lit("l"), n % 50).alias("line"))
    rows = chunk_streams(entries, 64).collect()
    want = {}
    for r in entries.collect():
        want.setdefault(r["labels"]["job"], []).append((r["ts_ns"], r["line"]))
    for job, all_of in want.items():
        own = sorted((r for r in rows if r["labels"]["job"] == job), key=lambda r: r["chunk"])
        assert [r["chunk"] for r in own] == list(range(-(-len(all_of) // 64)))
        assert all(len(r["entries"]) == 64 for r in own[:-1])
        assert [tuple(e) for r in own for e in r["entries"]] == sorted(all_of)


def test_empty(spark):
    assert chunk_streams(spark.createDataFrame([], "labels map<string,string>, ts_ns long, line string")).collect() == []
