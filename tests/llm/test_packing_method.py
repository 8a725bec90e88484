"""Packing: every placement against the sum of squares written out, and columns with clashing names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetsift.llm.packing import pack, place


def least_square_gaps(sizes, capacity, width):
    """For each size the gap it goes into, by trying every open sequence; None opens a new one."""
    gaps, chosen = [], []
    for size in sizes:
        def total(left):
            counts = {}
            for g in left:
                counts[g // width] = counts.get(g // width, 0) + (g // width > 0)
            return sum(n * n for n in counts.values())
        tried = sorted((total(gaps[:k] + [g - size] + gaps[k + 1:]), g, k) for k, g in enumerate(gaps) if g >= size)
        if tried:
            _, gap, k = tried[0]
            chosen.append(gap)
            gaps[k] -= size
        else:
            chosen.append(None)
            gaps.append(capacity - size)
    return chosen, sorted(gaps)


@pytest.mark.parametrize("width", [1, 4, 16])
def test_each_placement_is_the_least_sum_of_squares(width):
    rng = np.random.default_rng(width)
    for _ in range(40):
        sizes = np.sort(rng.integers(1, 100, rng.integers(1, 60)))[::-1]
        bins, offsets, gaps = place(sizes, 100, width)
        chosen, left = least_square_gaps(sizes.tolist(), 100, width)
        assert [None if o == 0 else 100 - o for o in offsets.tolist()] == chosen
        assert sorted(gaps.tolist()) == left
        assert sum(2 * (100 - g) <= 100 for g in gaps.tolist()) <= 1
        assert np.bincount(bins, sizes).astype(int).tolist() == (100 - gaps).tolist()


def test_columns_of_any_name_are_carried(spark):
    rows = [(k, f"x{k}", 2 ** 60 + k if k % 2 else None, k % 300 + 1, "a.b") for k in range(50)]
    pieces = spark.createDataFrame(rows, "_row int, _group string, _open long, length int, c0 string")
    packed = pack(pieces)
    assert packed.columns == ["_row", "_group", "_open", "length", "c0", "sequence_id", "offset"]
    assert sorted(packed.select(*pieces.columns).collect()) == sorted(pieces.collect())
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").isEmpty()


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "id long, length long")).collect() == []


def test_words_are_looked_up_once(monkeypatch):
    import public_tokenizers
    from fleetsift.llm.packing import Encoder
    own = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["the cat sat", "the  dog's\n\nmat 12", "", "\n", "漢 é", "the cat's new hat\tsat"]
    whole = [np.array(own.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    asked = []

    class Store(dict):
        def __contains__(self, word):
            asked.append(word)
            return dict.__contains__(self, word)

    assert own.encode(texts) == whole
    own.known = Store(own.known)
    assert own.encode(texts) == whole and not asked  # all known: no second look
    assert own.encode(["the unseen zebra"]) == [np.array(own.tokenizer.encode("the unseen zebra", add_special_tokens=False).ids, "<u4").tobytes()]
