"""Components of links against union-find."""

import random

import pytest

from fleetsift.llm.components import components


def by_hand(links):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {x: root(x) for x in parent}


def shuffled(links, seed):
    mixed = random.Random(seed)
    links = [mixed.choice([(a, b), (b, a)]) for a, b in links]
    mixed.shuffle(links)
    return links


CASES = {
    "none": [],
    "path": [(k, k + 1) for k in range(40)],
    "alternating path": [(k, 100 - k) for k in range(50)] + [(100 - k, k + 1) for k in range(50)],
    "star about its largest": [(99, k) for k in range(60)],
    "repeated, own and null ends": [(1, 2), (2, 1), (1, 2), (5, 5), (None, 7), (8, None), (-3, 2)],
    "random": [(a % 97 * 10, b % 89 * 10 + 1) for a, b in zip(range(3, 900, 13), range(5, 900, 17))],
}


@pytest.mark.parametrize("case", CASES)
def test_components(spark, case):
    links = shuffled(CASES[case], len(case))
    got = [tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).select("node", "component").collect()]
    assert len(got) == len(dict(got)) and dict(got) == by_hand(links)
