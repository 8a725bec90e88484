"""The rule index against trying every rule in order, and its cost as rules grow."""

import random
import re
import time

import pytest

from fleetsift import fixed_values as V
from fleetsift.operators.templates import Rule, RuleIndex


def in_order(rules, line):
    need = len(line.strip()) * V.MIN_COVERAGE if line else 0
    for rule in rules if need else ():
        found = re.search(rule.pattern, line)
        if found and found.end() - found.start() >= need:
            return rule.event, list(found.groupdict()), list(found.groupdict().values())
    return "unstructured", [], []


def word(rng):
    return "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 5)))


def pattern(rng):
    parts = [lambda: re.escape(word(rng)), lambda: r"\w+", lambda: r"(?:%s|%s)" % (word(rng), word(rng)), lambda: r"(?:%s)?" % word(rng),
             lambda: r"(?:%s )+" % word(rng), lambda: "(?i:%s)" % word(rng).upper(), lambda: "(?=%s)" % word(rng), lambda: r"\s*", lambda: ".*"]
    body = " ".join(rng.choice(parts)() for _ in range(rng.randrange(1, 5)))
    return rng.choice(["", "", "(?i)", "^"]) + body + rng.choice(["", "(?P<rest>.*)", "$"])


@pytest.mark.parametrize("seed", range(6))
def test_as_if_every_rule_were_tried(seed):
    rng = random.Random(seed)
    rules = [r for r in (Rule.of(f"e{k}", pattern(rng)) for k in range(60)) if r]
    index = RuleIndex(tuple(rules))
    lines = [None, "", "   "] + [" ".join(word(rng) for _ in range(rng.randrange(1, 6))) for _ in range(400)]
    for line in lines:
        assert index.match(line) == in_order(rules, line)


def test_no_rules_and_rules_without_pieces():
    assert RuleIndex(()).match("a line") == ("unstructured", [], [])
    assert RuleIndex((Rule.of("any", ".*"),)).match("a line") == ("any", [], [])


def test_cost_of_a_line_does_not_grow_with_the_rules():
    rng = random.Random(1)

    def seconds(n):
        rules = [Rule.of(f"e{k}", rf"unit{k}x: (?P<a>\w+) took (?P<b>\d+) ms on (?P<c>\S+)") for k in range(n)]
        index = RuleIndex(tuple(rules))
        lines = [f"unit{rng.randrange(n)}x: job took {rng.randrange(99)} ms on host{rng.randrange(9)}" for _ in range(4000)]
        best = 9.9
        for _ in range(3):
            start = time.perf_counter()
            assert all(index.match(line)[0] != "unstructured" for line in lines)
            best = min(best, time.perf_counter() - start)
        return best

    few, many = seconds(100), seconds(10_000)
    assert many < 4 * few, (few, many)
    print(few, many)
