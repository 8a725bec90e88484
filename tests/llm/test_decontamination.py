"""Phrase and proximity search against its SQL and brute force, in one block or many."""

import hashlib
import random
import re
from collections import Counter

import pytest

from fleetsift.llm.decontamination import Search, build_index, decontaminate, search_index

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, search):
    texts = [words(t) for _, t in docs]
    counts = Counter(w for t in texts for w in t)
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - search.width + 1) if w else 0):
            windows.setdefault(tuple(w[i:i + search.width]), set()).add(item)
    found = []
    for (doc, _), w in zip(docs, texts):
        hit, held, near = set(), set(), set()
        for window, owners in windows.items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i:i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    held |= owners
            rarest = min(window, key=lambda x: (counts[x], x.encode()))
            near |= {p for p, x in enumerate(w) if x == rarest and set(window) <= set(w[max(0, p - search.reach):p + search.reach + 1])}
        ids = sorted((str(i) for i in held if i is not None), key=str.encode)
        found.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit), len(near)))
    return sorted(found, key=repr)


def awkward():
    rng = random.Random(2)
    vocabulary = ["a", "b", "the", "été", "漢字", "x1", "9", "of", "In", "zz"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-", "\x7f"]) for _ in range(n))
    items = [(i, text(rng.randrange(1, 9))) for i in range(12)] + [(None, text(4)), (3, text(5)), (90, ""), (91, None), (92, "?! --"), (93, "unseen word"), (94, "zz")]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(40)] + [(7, None), (None, "a b the"), (8, ""), (8, "THE, b: A!")]
    docs += [(100, " ".join(vocabulary * 3000) + " " + items[0][1]), (101, items[0][1] + items[1][1])] + [(200, "the b a")] * 5
    return docs, items


@pytest.mark.parametrize("search", [Search(width=3, reach=4), Search(width=3, reach=2, block_words=6, slab=5), Search(width=4, reach=9, block_words=20)])
@pytest.mark.parametrize("segment", [8_000_000, 50])
def test_against_brute_force(spark, search, segment):
    docs, items = awkward()
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, segment int, terms int").repartition(3)
    tests = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, w int")
    got = decontaminate(frame, tests, search).collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, items, search)
    again = search_index(build_index(frame, segment_bytes=segment), tests, search)
    assert sorted((r["doc_id"], sum(s["end"] - s["first"] for s in r["spans"]), r["items"]) for r in again.collect() if r["doc_id"] is not None) == sorted(
        (d, h, sorted({str(i) for i in ids if i is not None})) for d, h, ids in spans_of(docs, items, search) if d is not None)


def spans_of(docs, items, search):
    for doc, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, other in items:
            v = words(other)
            for i in range(max(1, len(v) - search.width + 1) if v else 0):
                window = v[i:i + search.width]
                for k in range(len(w) - len(window) + 1):
                    if w[k:k + len(window)] == window:
                        hit |= set(range(k, k + len(window)))
                        ids.add(item)
        yield doc, len(hit), ids


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "some words")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    row = decontaminate(docs, items).first()
    assert (row["n_words"], row["n_hit"], row["n_items"], row["contaminated"], row["n_near"]) == (2, 0, 0, False, 0)
    assert decontaminate(docs.limit(0), items).count() == 0
    assert decontaminate(docs.limit(0), spark.createDataFrame([(1, "some words")], "item_id long, text string")).count() == 0
