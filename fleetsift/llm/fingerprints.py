"""Document fingerprints by consistent weighted sampling.

A document's terms are its pairs of neighbouring words (its last word also stands alone), weighted by
how often they occur. For sample k every term has three numbers that depend on (term, k) alone: r and c
from the gamma distribution of shape 2, and b uniform in [0, 1). With weight w let
t = floor(ln w / r + b) and ln a = ln c - r (t - b + 1). The term with the smallest a is the sample, and
(term, t) its value. Two documents agree in a sample with the probability of their generalised Jaccard
likeness, the sum of smaller weights over the sum of larger ones.

Everything is made of DataFrame functions. Gamma values come from a table of quantiles, picked by bits
of a hash. A sample is kept as one number, ln a above and the value's hash below, so that the smallest
is a plain minimum. Samples are computed in blocks of eight, a row for each term and block, which keeps
the generated code small enough to be compiled well.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

_BITS = 11
_GAPS = " \t\n\x0b\x0c\r"
_LAST = (1 << 63) - 1
BLOCK = 8


def gamma_quantiles(n: int) -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2 at the middles of n equal parts, by bisection."""
    p = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 60.0)
    for _ in range(80):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return mid


def _table(values: np.ndarray) -> Column:
    return F.expr("array(" + ",".join(f"{v:.8g}D" for v in values) + ")")


def term_rows(texts: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys, term): a row for each occurrence; a text without words has one term of its own."""
    words = F.split(F.btrim(text, F.lit(_GAPS)), "[\\x20\\x09-\\x0d]+")
    staged = texts.select(*keys, words.alias("_words"))
    pairs = F.arrays_zip(F.col("_words").alias("x"), F.slice("_words", F.lit(2), F.size("_words")).alias("y"))
    return staged.select(*keys, F.explode(pairs).alias("_p")).select(*keys, F.xxhash64("_p.x", "_p.y").alias("term"))


def weighted_samples(terms: DataFrame, keys: list[str], samples: int) -> DataFrame:
    """(keys, block, s0..s7): the least of each sample over the weighted terms (keys, term, weight)."""
    n = 1 << _BITS
    rate, start = _table(gamma_quantiles(n)), _table(np.log(gamma_quantiles(n)))
    bits = lambda h, at: F.shiftrightunsigned(h, at).bitwiseAND(F.lit(n - 1)).cast("int")
    names = range(BLOCK)
    blocks = terms.select(*keys, "term", F.log("weight").alias("lnw"), F.explode(F.array(*[F.lit(b) for b in range(samples // BLOCK)])).alias("block"))
    hashed = blocks.select(*keys, "block", "lnw", *[F.xxhash64("term", F.col("block") * BLOCK + k).alias(f"h{k}") for k in names])
    drawn = hashed.select(*keys, "block", "lnw", *[F.col(f"h{k}") for k in names], *[F.get(rate, bits(F.col(f"h{k}"), 0)).alias(f"r{k}") for k in names])
    part = lambda k: bits(F.col(f"h{k}"), 2 * _BITS) / F.lit(float(n))
    levels = drawn.select(*keys, "block", *[F.col(f"h{k}") for k in names], *[F.col(f"r{k}") for k in names],
                          *[F.floor(F.col("lnw") / F.col(f"r{k}") + part(k)).alias(f"t{k}") for k in names])

    def packed(k: int) -> Column:
        h, r, t = F.col(f"h{k}"), F.col(f"r{k}"), F.col(f"t{k}")
        height = F.get(start, bits(h, _BITS)) - r * (t - part(k) + 1)
        value = F.shiftrightunsigned(h, 30).bitwiseXOR(t * F.lit(2654435761)).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.shiftleft(F.greatest(F.lit(0.0), (height + 100) * 16777216).cast("long"), 32).bitwiseOR(value)

    return levels.groupBy(*keys, "block").agg(*[F.min(packed(k)).alias(f"s{k}") for k in names])


def as_text(samples: Column) -> Column:
    """Eight hexadecimal digits for each sample."""
    return F.array_join(F.transform(samples, lambda s: F.lower(F.lpad(F.hex(s), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of samples in which two fingerprints agree."""
    same = F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)
    return F.size(same) / F.size(a)


def _in_order(docs: DataFrame, n_buckets: int) -> DataFrame:
    """(bucket, edge, k, t): rows in buckets of ascending id; the first row of a bucket stands in the
    bucket before it as well (the first of all, in the last), marked as edge and sorted behind."""
    k = F.coalesce("i", F.lit(_LAST))
    cuts = docs.agg(F.percentile_approx(k, [x / n_buckets for x in range(1, n_buckets)] or [0.5], 10000).alias("c")).first()["c"]
    bounds = F.array(*[F.lit(c).cast("long") for c in sorted(set(cuts or [0]))])  # one number a bucket
    placed = docs.select(k.alias("k"), F.coalesce("t", F.lit("")).alias("t")).withColumn("own", F.size(F.filter(bounds, lambda c: c <= F.col("k"))))
    firsts = sorted((r["own"], r["k"]) for r in placed.groupBy("own").agg(F.min("k").alias("k")).collect())
    if not firsts:
        firsts = [(0, 0)]
    before = F.create_map(*[F.lit(x) for (own, _), prior in zip(firsts, firsts[-1:] + firsts[:-1]) for x in (own, prior[0])])
    least = F.create_map(*[F.lit(x) for own, first in firsts for x in (F.lit(own), F.lit(first).cast("long"))])
    stands = F.array(F.struct(F.col("own").alias("bucket"), F.lit(False).alias("edge")),
                     F.when(F.col("k") == least[F.col("own")], F.struct(before[F.col("own")].alias("bucket"), F.lit(True).alias("edge"))))
    return placed.select("k", "t", F.explode(F.array_compact(stands)).alias("_s")).select("_s.bucket", "_s.edge", "k", "t")


def fingerprint_documents(docs: DataFrame, samples: int = 64, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has its last quarter replaced by as much of the start of the next document, by
    ascending id, the first following the last. A null text counts as empty; texts without words have
    the same fingerprint. Null ids come last and stay null; rows of one id are ordered by text, so
    repeated rows follow each other. One row for each row; a single row is its own next. Other columns
    are not read. An empty table gives an empty table. Ids are whole numbers.
    """
    if samples % BLOCK:
        raise ValueError(f"samples come in blocks of {BLOCK}")
    spark = docs.sparkSession
    n_buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(docs[id].cast("long").alias("i"), docs[text].alias("t"))
    dealt = _in_order(docs, n_buckets).repartition(n_buckets, "bucket")
    order = Window.partitionBy("bucket").orderBy("edge", "k", "t")
    n = F.length("t")
    quarter = F.floor(n / 4).cast("int")
    rows = (dealt.select("bucket", "edge", "k", "t", F.lead("t").over(order).alias("next"), F.row_number().over(order).alias("row"))
            .select("bucket", "row", "edge", "k", "t", F.when(~F.col("edge"), F.concat(
                F.substring("t", F.lit(1), n - quarter), F.substring("next", F.lit(1), quarter))).alias("edited")))
    both = rows.select("bucket", "row", F.explode(F.array_compact(F.array(
        F.struct(F.lit(0).alias("edit"), F.col("t").alias("body")),
        F.when(~F.col("edge"), F.struct(F.lit(1).alias("edit"), F.col("edited").alias("body")))))).alias("_v")).select("bucket", "row", "_v.edit", "_v.body")
    keys = ["bucket", "row", "edit"]
    weights = term_rows(both, "body", keys).groupBy(*keys, "term").agg(F.count("*").alias("weight"))
    sampled = weighted_samples(weights, keys, samples)
    block = F.array(*[F.col(f"s{k}").bitwiseAND(F.lit(0xFFFFFFFF)) for k in range(BLOCK)])
    prints = (sampled.groupBy("bucket", "row").agg(F.array_sort(F.collect_list(F.struct("edit", "block", block.alias("s")))).alias("all"))
              .select("bucket", "row", F.flatten(F.col("all.s")).alias("all")))
    meta = rows.select("bucket", "row", "edge", "k", F.length("t").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    own, edited = F.slice("all", 1, samples), F.slice("all", samples + 1, samples)
    joined = (meta.join(prints, ["bucket", "row"])
              .select("bucket", "row", "edge", "k", "n_chars", "edited_sha256", own.alias("own"), edited.alias("edited")))
    following = F.lead("own").over(Window.partitionBy("bucket").orderBy("row"))
    return (joined.withColumn("following", following).where("NOT edge")
            .select(F.when(F.col("k") != _LAST, F.col("k")).alias(id), "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"),
                    as_text(F.col("edited")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("edited")).alias("near_edited"),
                    likeness(F.col("own"), F.col("following")).alias("near_next")))
