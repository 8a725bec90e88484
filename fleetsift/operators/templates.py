"""Ordered regex rules on lines: matching, and the rules table itself."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from re import _parser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as V
from ..functions.values import normalize_fields
from ..schema import RULE


@dataclass(frozen=True)
class Rule:
    """A rule with the pieces of literal text that every line it matches holds."""
    event: str
    pattern: str
    literals: tuple[str, ...] = ()

    @classmethod
    def of(cls, event: str, pattern: str) -> "Rule | None":
        """None for a pattern that does not compile."""
        return None if refusal(pattern) else cls(event, pattern, tuple(dict.fromkeys(_literals(_parser.parse(pattern)))))


def refusal(pattern: str) -> str | None:
    """Why a pattern is no regular expression; None if it is one."""
    try:
        re.compile(pattern)
    except (re.error, TypeError, OverflowError, RecursionError) as e:
        return str(e)
    return None


def _literals(tree) -> list[str]:
    """The runs of plain characters that a parsed pattern cannot do without."""
    if getattr(tree, "state", None) is not None and tree.state.flags & re.IGNORECASE:
        return []
    found, run = [], ""
    for op, value in tree:
        if op is _parser.LITERAL:
            run += chr(value)
            continue
        found.append(run)
        run = ""
        if op is _parser.SUBPATTERN and not value[1] & re.IGNORECASE:
            found += _literals(value[3])
        elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT) and value[0] > 0:
            found += _literals(value[2])
    return [text for text in (*found, run) if text]


def read_rules(rules: DataFrame) -> list[Rule]:
    """The rules in order. `rejected_rules` has those that do not compile."""
    rows = rules.orderBy("priority", "event").select("event", "pattern").collect()
    return [r for r in (Rule.of(row.event, row.pattern) for row in rows) if r]


def rejected_rules(rules: DataFrame) -> DataFrame:
    """(event, pattern, reason) of the rules that cannot be used."""
    rows = [(r.event, r.pattern, refusal(r.pattern)) for r in rules.orderBy("priority", "event").select("event", "pattern").collect()]
    return rules.sparkSession.createDataFrame([r for r in rows if r[2]], "event string, pattern string, reason string")


def covers(line: Column, java_pattern) -> Column:
    """The first match spans at least 70 % of the stripped line."""
    pattern = java_pattern if isinstance(java_pattern, Column) else F.lit(java_pattern)
    found = F.length(F.call_function("regexp_extract", line, pattern, F.lit(0)))
    text = F.length(F.trim(line))
    return (text > 0) & (found >= text * V.MIN_COVERAGE)


class RuleIndex:
    """Rules filed under one of their literal pieces each: the one that fewest rules share, then the longest.

    One pass of an Aho-Corasick automaton over a line finds all pieces it holds; the rules filed under those whose
    other pieces were found too are tried in order. A line so meets only rules that nearly match it, however many
    there are. Rules without a piece are tried on every line.
    """

    def __init__(self, rules: tuple):
        import ahocorasick
        shared = Counter(piece for rule in rules for piece in rule.literals)
        pieces = {piece: k for k, piece in enumerate(shared)}
        self.rules = [(rule.event, re.compile(rule.pattern).search, frozenset(pieces[p] for p in rule.literals)) for rule in rules]
        self.always, self.filed = [], {}
        for k, rule in enumerate(rules):
            key = min(rule.literals, key=lambda p: (shared[p], -len(p), p), default=None)
            (self.always if key is None else self.filed.setdefault(pieces[key], [])).append(k)
        self.automaton = ahocorasick.Automaton()
        for piece, k in pieces.items():
            self.automaton.add_word(piece, k)
        if pieces:
            self.automaton.make_automaton()

    def match(self, line: str | None) -> tuple:
        """Event, field names and values by the first rule that covers the line."""
        need = len(line.strip()) * V.MIN_COVERAGE if line else 0
        if need:
            held = {k for _, k in self.automaton.iter(line)} if len(self.automaton) else set()
            tried = sorted(chain(self.always, *(self.filed[k] for k in held if k in self.filed)))
            for k in tried:
                event, search, pieces = self.rules[k]
                if pieces <= held:
                    found = search(line)
                    if found and found.end() - found.start() >= need:
                        fields = found.groupdict()
                        return event, list(fields), list(fields.values())
        return "unstructured", [], []


@lru_cache(maxsize=8)
def _indexed(rules: tuple) -> RuleIndex:
    """The index of a rule set, built once in each Python process."""
    return RuleIndex(rules)


def match_templates(lines: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds event and kv by the first rule that covers the line; else unstructured, {}.

    Lines pass through Python in Arrow batches: the patterns are Python's, so word characters are
    Unicode, references back work, and a group that took no part is null. The plan is one step however
    many rules there are; a rule's expression runs only for lines that hold its literal pieces.
    """
    known = tuple(rules)

    @F.pandas_udf("event string, names array<string>, found array<string>")
    def first_match(raw: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        match = _indexed(known).match
        for part in raw:
            yield pd.DataFrame([match(line) for line in part], columns=["event", "names", "found"])

    fields = F.map_from_arrays("_m.names", "_m.found")
    return (lines.withColumn("_m", first_match("raw")).withColumn("event", F.col("_m.event"))
            .withColumn("kv", normalize_fields(fields)).drop("_m"))


# ---- the rules table -----------------------------------------------------------

def load_rules(base: DataFrame, runtime: DataFrame) -> DataFrame:
    """Base rules, with every learned rule new in both pattern and event in front.

    Learned rules keep their own order, newest first by priority.
    """
    fresh = _new_in_both(runtime, base)
    return fresh.withColumn("_tier", F.lit(0)).unionByName(base.withColumn("_tier", F.lit(1))
                                                           ).withColumn("priority", F.col("priority") + F.col("_tier") * 1_000_000_000).drop("_tier")


def _new_in_both(candidates: DataFrame, known: DataFrame) -> DataFrame:
    return (candidates.join(known.select("pattern"), "pattern", "left_anti")
            .join(known.select("event"), "event", "left_anti").select(*candidates.columns))


def add_rules(rules: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rules after learning candidates (seq, event, pattern, fields, created_at).

    A pattern already known, or seen earlier in the batch, is rejected. A taken
    event name gets the lowest free suffix _2, _3, ... The latest comes first.
    """
    earliest = Window.partitionBy("pattern").orderBy("seq")
    new = (candidates.withColumn("_r", F.row_number().over(earliest)).filter("_r = 1").drop("_r")
           .join(rules.select("pattern"), "pattern", "left_anti"))
    suffix = F.regexp_extract("event", r"^(.*)_(\d+)$", 2).try_cast("int")
    stem = F.regexp_extract("event", r"^(.*)_(\d+)$", 1)
    names = rules.select("event").union(candidates.select("event")).distinct()
    used = (names.filter(suffix >= 2).select(stem.alias("stem"), suffix.alias("k"))
            .groupBy("stem").agg(F.collect_set("k").alias("used")))
    held = rules.select(F.col("event").alias("held")).distinct()
    place = F.row_number().over(Window.partitionBy("event").orderBy("seq"))
    placed = (new.withColumn("_n", place).join(held, F.col("event") == F.col("held"), "left")
              .join(used, F.col("event") == F.col("stem"), "left")
              .withColumn("used", F.coalesce("used", F.array().cast("array<int>"))))
    extra = F.col("_n") - F.when(F.col("held").isNull(), 1).otherwise(0)
    free = F.array_except(F.sequence(F.lit(2), extra + F.size("used") + 2), F.col("used"))
    name = F.when(extra == 0, F.col("event")).otherwise(
        F.concat_ws("_", "event", F.get(free, extra - 1).cast("string")))
    front = rules.agg(F.min("priority")).first()[0] or 0
    learned = placed.select(
        (F.lit(front) - 1 - F.col("seq")).cast("long").alias("priority"), name.alias("event"), "pattern",
        "fields", F.lit(0).cast("long").alias("hit_count"), "created_at", F.lit("runtime").alias("origin"))
    return rules.select(*RULE.names).unionByName(learned)


def merge_rules(base: DataFrame, runtime: DataFrame) -> DataFrame:
    """Base with the learned rules that are new in event and pattern in front; `merged` marks them.

    Of several learned rules with one event or one pattern the first by priority is taken.
    """
    fresh = _new_in_both(runtime, base)
    first = lambda c: F.row_number().over(Window.partitionBy(c).orderBy("priority"))
    fresh = (fresh.withColumn("_e", first("event")).filter("_e = 1")
             .withColumn("_p", first("pattern")).filter("_p = 1").drop("_e", "_p"))
    return load_rules(base, fresh).withColumn("merged", F.col("origin") == "runtime")


def template_usage(events: DataFrame, rules: DataFrame, order_by: str = "hits", limit: int = 50) -> DataFrame:
    """Rows stored per rule, most used or newest first."""
    hits = events.groupBy("event").agg(F.count("*").alias("hits"))
    usage = rules.join(hits, "event", "left").select(
        "event", "pattern", "created_at", F.coalesce("hits", F.lit(0)).alias("hits"))
    return usage.orderBy(F.desc(order_by), "event").limit(int(limit))
