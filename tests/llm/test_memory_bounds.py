"""What a task holds at once: texts on their way to Python, rows that are looked at together, pre-tokens seen."""

import sys

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from fleetsift.llm.decontamination import build_index, search_index
from fleetsift.llm.ngram_join import _regrouped
from fleetsift.session import bound_batches

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def largest_batch(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"size": [batch.nbytes]})
    texts = spark.range(4000, numPartitions=1).select(F.repeat(F.lit("abcdefghij"), 400).alias("text"))
    return texts.mapInArrow(sizes, "size long").agg(F.max("size")).first()[0]


@pytest.mark.parametrize("stage", [stage for _, stage in P.STAGES])
def test_stages_bound_the_batches_of_texts(spark, sf, stage):
    spark.conf.unset(LIMIT)
    try:
        stage(spark, spark.read.parquet(f"{sf}/documents.parquet").limit(0), sf)
        assert largest_batch(spark) <= 5 << 20
    finally:
        spark.conf.unset(LIMIT)


def test_a_limit_of_the_session_stays(spark):
    spark.conf.set(LIMIT, "1m")
    try:
        assert bound_batches(spark).conf.get(LIMIT) == "1m"
    finally:
        spark.conf.unset(LIMIT)


@pytest.mark.parametrize("sizes", [[], [0], [3], [4], [1, 1, 1, 1, 1], [10], [3, 9, 0, 1], [4, 4], [2, 11, 3]])
def test_rows_looked_at_together_do_not_depend_on_batches(sizes):
    rows = iter(range(100))
    batches = [pa.RecordBatch.from_pydict({"t": pa.array([str(next(rows)) for _ in range(n)], pa.string())}) for n in sizes]
    got = [batch.column("t").to_pylist() for batch in _regrouped(iter(batches), 4)]
    whole = [str(k) for k in range(sum(sizes))]
    assert got == [whole[k:k + 4] for k in range(0, len(whole), 4)]


def test_store_of_pre_tokens_is_bounded():
    import public_tokenizers
    from fleetsift.llm.packing import Encoder
    path = public_tokenizers.path("byte_bpe_50k.json")
    small, most = Encoder(path, 500), 0
    for k in range(0, 8000, 250):
        small.encode([" ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(k, k + 250))])
        held = [*small.known.items(), *small.elder.items()]
        most = max(most, len(held))
    assert most <= 2 * (500 + 500)  # a store may be overfull by what one call brings
    each = sum(sys.getsizeof(word) + sys.getsizeof(ids) for word, ids in held) / len(held) + 40
    assert 2 * Encoder(path).keep * each < 128 << 20


def test_rows_of_the_index_are_written_and_read_one_at_a_time(spark):
    docs = spark.range(300, numPartitions=2).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some words"), "id").alias("text"))
    index = build_index(docs, segment_bytes=60)
    held = [meta.row_group(k).num_rows for meta in (pq.ParquetFile(f.removeprefix("file:")).metadata for f in index.inputFiles()) for k in range(meta.num_row_groups)]
    assert index.count() > 50 and set(held) == {1} and len(held) == index.count()


def test_texts_and_rows_of_the_index_travel_in_bounded_batches(spark):
    items = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    docs = spark.range(4000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 400).alias("text"))
    spark.conf.unset(LIMIT)
    try:
        index = build_index(docs)
        assert index.agg(F.max(F.size("positions"))).first()[0] * len("word ") <= 5 << 20
        spark.conf.unset(LIMIT)
        assert search_index(index, items).agg(F.sum(F.size("items"))).first()[0] == 4000
        assert largest_batch(spark) <= 5 << 20
    finally:
        spark.conf.unset(LIMIT)
