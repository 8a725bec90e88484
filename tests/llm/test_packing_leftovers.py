"""Packing of pieces that close no sequence: more of them than one group holds."""

import pytest
from pyspark.sql import functions as F

from fleetsift.llm.packing import pack


@pytest.mark.parametrize("n, length, least", [(4500, 600, 4500), (9000, 1, 9), (4500, 110, 500)])
def test_pieces_without_partners(spark, n, length, least):
    packed = pack(spark.range(n, numPartitions=2).select("id", F.lit(length).cast("long").alias("length")))
    rows = packed.select("id", "length", "sequence_id", "offset").collect()
    assert sorted(r["id"] for r in rows) == list(range(n))
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        assert [a for a, _ in sorted(places)] == [length * k for k in range(len(places))]
        assert length * len(places) <= 1024
    assert least <= len(by_sequence) <= 1.02 * least


def test_leftovers_among_pieces_that_fit(spark):
    """A third of 600 tokens, the rest short: every short piece still finds a sequence."""
    lengths = F.when(F.col("id") % 3 == 0, 600).otherwise(30 + F.pmod(F.xxhash64("id"), F.lit(200))).cast("long")
    packed = pack(spark.range(15000, numPartitions=2).select("id", lengths.alias("length")))
    total, sequences, rows = packed.agg(F.sum("length"), F.countDistinct("sequence_id"), F.count("*")).first()
    assert rows == 15000 and sequences <= 1.03 * max(5000, total / 1024)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
