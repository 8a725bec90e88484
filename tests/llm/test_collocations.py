"""Phrase mining against its SQL and brute force, with a trie that bursts and spills and filters full of collisions."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from fleetsift.llm.collocations import Filter, Mining, build_filter, mine_collocations
from fleetsift.llm.hat_trie import HatTrie, tally

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, mining):
    counts, sizes = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            counts.update((lang, tuple(words[i:i + n])) for n in range(1, mining.longest + 1) for i in range(len(words) - n + 1))
    often = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= mining.least}
    listed = {}
    for (lang, words), a in often.items():
        inside = any(key[0] == lang and len(key[1]) > len(words) and 100 * b >= mining.cover * a
                     and any(key[1][i:i + len(words)] == words for i in range(len(key[1]))) for key, b in often.items())
        if not inside:
            score, _, l, r = min((mining.scale * a // (counts[lang, words[:k]] + counts[lang, words[k:]]), k,
                                  counts[lang, words[:k]], counts[lang, words[k:]]) for k in range(1, len(words)))
            listed.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), l, r))
    return {(lang, k, p.decode(), -a, l, r, sizes[lang], -s) for lang, found in listed.items()
            for k, (s, a, p, l, r) in enumerate(sorted(found)[:mining.top], 1)}


def awkward():
    rng = random.Random(3)
    vocabulary = [c * rng.randrange(1, 4) for c in "abcdefgé漢"] + ["\x00", "a-b", "x'y"]
    rows = [(rng.choice(["en", "de", None, "und", ""]), " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ".", ",", "\n", "\t ", "\x0b"])
             for _ in range(rng.randrange(1, 60)))) for _ in range(300)]
    rows += [("en", "The cat sat on the mat. " * 40)] * 3 + [("en", None), ("de", ""), (None, " ,. \n"), ("fr", "un deux trois quatre cinq " * 2000)]
    return rows


@pytest.mark.parametrize("mining", [Mining(least=4, top=40), Mining(least=3, top=10 ** 6, stretch=300, trie=50, part_bytes=2000, filter_bits=15),
                                    Mining(least=5, cover=50, longest=3)])
def test_against_brute_force(spark, mining):
    rows = awkward()
    frame = spark.createDataFrame([(lang, text, 1, 2) for lang, text in rows], "lang string, text string, phrase int, a int").repartition(3)
    got = mine_collocations(frame, mining).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute(rows, mining)


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    rows, mining = awkward(), Mining(least=6)
    monkeypatch.setattr(Filter, "holds", lambda self, codes: np.ones(len(codes), bool))
    frame = spark.createDataFrame(rows, "lang string, text string")
    from fleetsift.llm import collocations
    texts = [t for t in collocations._texts(frame.selectExpr("coalesce(lang, 'und') lang", "coalesce(text, '') t").toArrow().to_batches(), 10 ** 6)]
    whole = Filter(15, {})
    for t in texts:
        for n, (places, _) in enumerate(t.sift([whole] * mining.longest, mining.longest), 2):
            assert len(places) == sum(t.follows[i:i + n - 1].all() for i in range(len(t.codes) - n + 1))


def test_filter_holds_what_it_was_built_from(spark):
    codes = spark.range(5000).selectExpr("xxhash64(id) code")
    made = build_filter(codes, 28)
    inside = np.array([r["code"] for r in codes.collect()], np.int64).view(np.uint64)
    assert made.holds(inside).all() and made.holds(inside + np.uint64(1)).mean() < 0.05


@pytest.mark.parametrize("burst,limit", [(8, 100), (50, 10 ** 6), (4, 20)])
def test_trie_counts_and_spills_sorted_runs(burst, limit):
    rng = np.random.default_rng(1)
    trie, total, spilled = HatTrie(burst, limit), Counter(), Counter()
    hot = np.uint64(0xABCD) << np.uint64(48)
    for _ in range(60):
        codes = np.concatenate([hot + rng.integers(0, 300, 40).astype(np.uint64), rng.integers(0, 2 ** 63, 30).astype(np.uint64)])
        total.update(codes.tolist())
        for got, counts in trie.add(*tally(codes)):
            assert (np.diff(got.astype(object)) > 0).all()
            spilled.update(dict(zip(got.tolist(), counts.tolist())))
        assert trie.total <= limit
    for got, counts in trie.drain():
        spilled.update(dict(zip(got.tolist(), counts.tolist())))
    assert spilled == total


def test_empty_table(spark):
    assert mine_collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


@pytest.mark.parametrize("mining", [Mining(least=30, part_bytes=200_000), Mining(least=30, part_bytes=200_000, stretch=2000, trie=4000)])
def test_phrases_are_summed_up_before_they_leave_a_task(spark, monkeypatch, mining):
    from fleetsift.llm import collocations
    rng, made = random.Random(5), []
    vocabulary = [f"w{k}" for k in range(40)]
    rows = [("en", " ".join(rng.choice(vocabulary) for _ in range(200))) for _ in range(400)]
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    through = type(frame).mapInArrow
    monkeypatch.setattr(type(frame), "mapInArrow", lambda *a, **k: made.append(through(*a, **k)) or made[-1])
    counts, sizes = collocations.count_phrases(frame, mining)
    assert [r["n"] for r in sizes.collect()] == [80_000] and counts.where("words = 1").count() == 40
    assert counts.where("words = 2").agg({"a": "sum"}).first()[0] > 70_000
    assert made[-1].count() < 400  # there are 1,640 phrases of one and two words
