"""Samples for fitting are bounded by rows, whatever one id holds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetsift.llm import quality_classifier as Q, toxicity as T


@pytest.fixture(scope="module")
def tables(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels"))
    hot = labels.where("toxic = 1").where(~T.held_out(F.col("doc_id"))).orderBy("doc_id").first()["doc_id"]
    copies = docs.where(F.col("doc_id") == hot).crossJoin(spark.range(300)).select(*docs.columns)
    return docs, docs.unionByName(copies), labels


def test_toxicity_counts_an_id_once(tables):
    docs, repeated, labels = tables
    one, many = T.train_toxicity(docs, labels), T.train_toxicity(repeated, labels)
    assert np.abs(one.weights).sum() > 0 and np.allclose(one.weights, many.weights) and np.isclose(one.bias, many.bias)


def test_quality_counts_an_id_once(tables):
    docs, repeated, labels = tables
    one, many = ({r["doc_id"]: r["score"] for r in Q.score_quality(docs, Q.train_quality(d, labels)).collect()} for d in (docs, repeated))
    assert one.keys() == many.keys() and all(abs(one[i] - many[i]) < 1e-9 for i in one)
