"""A large group of texts that are alike by less than the threshold: no pair of all with all, no link lost."""

import random

import numpy as np

from fleetsift.llm import ngram_join as J
from fleetsift.llm.shingles import shingle_set


def copies(n, rng):
    """Texts of one base with 3 to 12 of 120 words changed, so that likenesses lie around and below 85 percent."""
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    texts = []
    for _ in range(n):
        words = list(base)
        for at in rng.sample(range(120), rng.choice([1, 3, 5, 8, 12])):
            words[at] = f"x{rng.randrange(10 ** 6)}"
        texts.append(" ".join(words))
    return texts


def brute(texts, settings):
    sets = [shingle_set(t, settings.words) for t in texts]
    parent = list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if 100 * both >= settings.percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in range(len(texts))}


def test_links_around_the_threshold(spark, monkeypatch):
    rng, seen = random.Random(4), []
    texts = [t for _ in range(3) for t in copies(150, rng)]
    sift = J._sifted
    monkeypatch.setattr(J, "_sifted", lambda pairs, classes, s: seen.append(pairs.count()) or sift(pairs, classes, s))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["component_id"] for r in J.similarity_components(frame, J.Settings()).collect()}
    assert got == brute(texts, J.Settings())
    assert sum(seen) < 3 * 150 * 149 / 2  # less than all pairs within the groups


def test_sets_that_only_resemble_each_other_do_not_leave_the_join(spark, monkeypatch):
    rng, seen = random.Random(9), []
    base, texts = [f"w{rng.randrange(5000)}" for _ in range(120)], []
    for k in range(240):
        words = list(base)
        for at in rng.sample(range(4, 116, 4), 2):
            words[at] = f"x{rng.randrange(10 ** 6)}"
        texts += [" ".join(words)] + [" ".join(words[:-1] + ["end"])] * (k % 20 == 0)
    between = J._between
    monkeypatch.setattr(J, "_between", lambda *a: seen.append((found := between(*a)).count()) or found)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["component_id"] for r in J.similarity_components(frame, J.Settings()).collect()}
    assert got == brute(texts, J.Settings())
    assert len(set(got.values())) > 100 and sum(seen) < 10 * len(texts)  # 28,680 pairs share the base


def test_parities_differ_in_no_more_bits_than_sets_in_elements():
    rng = np.random.default_rng(2)
    for size in (1, 5, 100, 3000):
        whole = np.unique(rng.integers(0, 2 ** 64, size, dtype=np.uint64))
        for gone in {0, 1, size // 3, size - 1}:
            one, other = J.parities(whole), J.parities(whole[gone:])
            assert len(one) == J._PARITY and sum(int(x).bit_count() for x in (one ^ other).view(np.uint64)) <= gone


def test_links_share_as_many_signatures_as_asked_for():
    rng, checked = np.random.default_rng(5), 0
    for settings in (J.Settings(), J.Settings(words=5, percent=80)):
        bands = settings.bands(4000)
        for size in [7, 20, 33, 60, 150, 700, 2500] * 6:
            one = np.unique(rng.integers(0, 2 ** 64, size, dtype=np.uint64))
            gone = int(rng.integers(0, size * (100 - settings.percent) // 100 + 1))
            more = rng.integers(0, 2 ** 64, int(rng.integers(0, 1 + size // 20)), dtype=np.uint64)
            other = np.unique(np.concatenate([one[gone:], more]))
            both = len(np.intersect1d(one, other))
            if not gone + len(more) or 100 * both < settings.percent * (len(one) + len(other) - both):
                continue
            band = int(np.searchsorted([b[1] for b in bands], min(len(one), len(other))))
            most, slack, m, start = settings.shape(bands[band][1])
            if not most:
                continue
            v = J.allowances(rng.random(m), rng.random(m), most + 1 + slack, start)
            (a, least_a), (b, least_b) = (J._set_signatures(x, band, slack, v) for x in (one, other))
            assert len(np.intersect1d(a, b)) >= max(least_a, least_b)
            assert set((a & J._BAND).tolist()) == {band}
            checked += 1
    assert checked > 30


def test_sets_that_share_one_common_passage_are_not_compared_again(spark, monkeypatch):
    rng, seen = random.Random(3), []
    passage = [f"p{k}" for k in range(60)]
    texts = [" ".join([f"w{rng.randrange(10 ** 6)}" for _ in range(150)] + passage) for _ in range(200)]
    texts += copies(60, rng)
    between = J._between
    monkeypatch.setattr(J, "_between", lambda docs, members, *a: seen.append(members.count()) or between(docs, members, *a))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in J.similarity_components(frame, J.Settings()).collect()}
    assert got == brute(texts, J.Settings())
    assert sum(seen) <= 100  # 200 sets share the passage


def test_pairs_leave_the_join_of_rarest_shingles_about_once(spark, monkeypatch):
    rng, seen = random.Random(12), []
    texts, met = copies(150, rng), J._met

    def counted(rows, s):
        pairs = met(rows, s)
        seen.append((pairs.count(), pairs.select("cls_a", "cls_b").distinct().count()))
        return pairs

    monkeypatch.setattr(J, "_met", counted)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in J.similarity_components(frame, J.Settings()).collect()}
    assert got == brute(texts, J.Settings())
    assert seen and all(rows <= 1.5 * pairs for rows, pairs in seen), seen
