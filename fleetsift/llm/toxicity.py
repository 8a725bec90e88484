"""Toxicity: a character n-gram classifier on features scaled by naive Bayes log-count ratios.

A text's features are the character n-grams it holds (in hashed slots, by presence). Each slot has the
ratio r = log((toxic share of texts with it) / (clean share)), both smoothed. The classifier is a
logistic regression on presence times r, so n-grams that tell nothing start near nothing and the
regularisation keeps them there.

Labels come from a bounded sample of labelled rows (`sample` rows, the lowest by a hash of the id).
Its n-grams are counted on the executors; the driver gets the counts of at most 2^bits slots and, for
the sample, the few slots that were selected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from fleetsift.session import cut_lineage

from .common import map_batches, one_row_each
from .linear import fit_logistic, sigmoid, slots


@dataclass(frozen=True)
class Settings:
    low: int = 3
    high: int = 6
    bits: int = 20
    sample: int = 12_000
    features: int = 1536
    smoothing: float = 1.0
    l2: float = 0.1


@dataclass
class Model:
    settings: Settings
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        at = slots(text, self.settings.low, self.settings.high, self.settings.bits)
        hit = np.unique(at[self.weights[at] != 0])
        return float(sigmoid(self.weights[hit].sum(dtype=np.float64) + self.bias))


def held_out(id) -> F.Column:
    """Rows kept from training: crc32 of the id's text is divisible by 5; a null id is not held out."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train_toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id: str = "doc_id",
                   text: str = "text", label: str = "toxic") -> Model:
    """Fit on labelled rows that are not held out.

    Null ids and labels are left out; an id labelled more than once is toxic if any row says so; of
    the rows of one document a single one counts, picked by a hash. Without a row of either class the model scores every text
    by the smoothed share of toxic rows.
    """
    s = settings
    chosen = (labels.select(labels[id].alias("i"), labels[label].cast("int").alias("y")).dropna()
              .where(~held_out(F.col("i"))).groupBy("i").agg(F.max("y").alias("y"))
              .orderBy(F.xxhash64("i"), "i").limit(s.sample))
    # s.sample rows of an id and a label: the bound of the broadcast
    sample = docs.select(docs[id].alias("i"), docs[text].alias("t")).join(F.broadcast(chosen), "i")
    sample = cut_lineage(one_row_each(sample, "i")).select("y", "t")

    def counting():
        def run(batch: dict) -> dict:
            held = np.zeros((2, 1 << s.bits), np.int32)
            for y, body in zip(batch["y"], batch["t"]):
                held[int(y > 0)][slots(body, s.low, s.high, s.bits)] += 1  # a repeated slot adds once
            at = np.flatnonzero(held.sum(axis=0))
            return {"slot": at, "clean": held[0][at], "toxic": held[1][at]}
        return run

    sizes = dict(sample.groupBy((F.col("y") > 0).alias("toxic")).count().collect())
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    flat = Model(s, np.zeros(1 << s.bits, np.float32), float(np.log((n_toxic + 1) / (n_clean + 1))))
    if not n_toxic or not n_clean:
        return flat
    counts = (map_batches(sample, counting, "slot int, clean int, toxic int").groupBy("slot")
              .agg(F.sum("clean").cast("double").alias("clean"), F.sum("toxic").cast("double").alias("toxic")))
    share_toxic = (F.col("toxic") + s.smoothing) / (n_toxic + 2 * s.smoothing)
    share_clean = (F.col("clean") + s.smoothing) / (n_clean + 2 * s.smoothing)
    ratio = F.log(share_toxic / share_clean)
    gain = F.abs(ratio) * F.abs(F.col("toxic") / n_toxic - F.col("clean") / n_clean)
    top = counts.select("slot", ratio.alias("r"), gain.alias("gain")).orderBy(F.desc("gain"), "slot").limit(s.features).collect()
    if not top:
        return flat
    picked = np.array([row["slot"] for row in top])
    r = np.array([row["r"] for row in top])
    column = np.full(1 << s.bits, -1, np.int32)
    column[picked] = np.arange(len(picked))

    def selecting():
        def run(batch: dict) -> dict:
            hits = []
            for body in batch["t"]:
                at = column[slots(body, s.low, s.high, s.bits)]
                hits.append(np.unique(at[at >= 0]).tolist())
            return {"y": [int(y > 0) for y in batch["y"]], "hits": hits}
        return run

    got = sorted(map_batches(sample, selecting, "y int, hits array<int>").collect(), key=lambda row: (row["hits"], row["y"]))
    cols = np.array([c for row in got for c in row["hits"]], np.int64)
    rows = np.repeat(np.arange(len(got)), [len(row["hits"]) for row in got])
    w, bias = fit_logistic(rows, cols, r[cols], np.array([row["y"] for row in got], float), len(picked), l2=s.l2)
    weights = np.zeros(1 << s.bits, np.float32)
    weights[picked] = w * r
    return Model(s, weights, bias)


def score_toxicity(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs' rows as (id, held_out, score, predicted): score from the whole text alone.

    Null and empty texts get the score of a text without n-grams. Repeated rows stay, a null id stays
    null, other columns are not read, an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.settings, model.weights, model.bias))  # 4 bytes x 2^bits

    def make():
        own = Model(*shared.value)

        def work(batch: dict) -> dict:
            return {"i": batch["i"], "score": [own.score(body) for body in batch["t"]]}
        return work

    kind = dict(docs.select(id).dtypes)[id]
    got = map_batches(docs.select(docs[id].alias("i"), docs[text].alias("t")), make, f"i {kind}, score double")
    return got.select(F.col("i").alias(id), held_out(F.col("i")).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast((model.settings, model.weights, model.bias))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def make():
        own = Model(*shared.value)

        def work(batch: dict) -> dict:
            clean = [own.score(body) < 0.5 for body in batch[text]]
            return {name: [v for v, ok in zip(values, clean) if ok] for name, values in batch.items()}
        return work

    return map_batches(docs, make, schema)
