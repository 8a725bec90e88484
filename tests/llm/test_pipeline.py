"""The corpus pipeline stage by stage on the smallest tables."""

import pyarrow.parquet as pq
import pytest

import corpus_pipeline as P
from fleetsift.llm.secrets import base_spans
from fleetsift.llm.shingles import shingle_set
from fleetsift.session import cut_lineage


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    out.append(docs)
    for _, stage in P.STAGES:
        docs = cut_lineage(stage(spark, docs, sf))
        out.append(docs)
    return out


def test_columns_and_rows(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes
    counts = [df.select("doc_id").distinct().count() for df in stages]
    assert all(a >= b > 0 for a, b in zip(counts, counts[1:])) and counts[-1] == counts[-2] == counts[-3]


def test_clean_good_documents_pass_the_filters(stages, sf):
    labels = pq.read_table(f"{sf}/labels.parquet").to_pylist()
    kept = {r["doc_id"] for r in stages[2].select("doc_id").collect()}
    clean = [r["doc_id"] for r in labels if r["quality"] == 1 and r["toxic"] == 0]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)


def test_one_document_of_each_group_stays(stages):
    before = {r["doc_id"]: set(shingle_set(r["text"], 5).tolist()) for r in stages[2].collect()}
    after = [r["doc_id"] for r in stages[3].collect()]
    assert len(after) == len(set(after))
    near = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    for k, i in enumerate(after):
        assert not any(near(before[i], before[j]) for j in after[:k])
    for i in set(before) - set(after):
        assert any(near(before[i], before[j]) for j in before if j != i)


def test_secrets_are_masked(stages):
    before = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    for r in stages[4].collect():
        assert not base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        assert base_spans(before[r["doc_id"]]) or r["text"] == before[r["doc_id"]]


def test_run_is_its_stages(spark, sf, stages):
    key = lambda df: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(P.run(spark, sf)) == key(stages[-1])
