"""URL filters: pattern rules indexed by their rarest literal token.

Rules are of two kinds. A *site* rule is a host with a path prefix and fits the host and its
subdomains. A *pattern* rule is text with the marks ad-block lists use: `||` a host or subdomain
begins here, `|` the address begins or ends here, `^` a separator or the end, `*` anything. A pattern
rule whose verdict is allow is an exception.

Every rule is filed under one literal token that any address it fits must contain: of the rule's
tokens the one that the fewest distinct addresses hold. The tokens of an address fetch the rules filed
under them, and regular expressions run for those alone. A rule without a whole literal token is
filed under the empty token, which every address holds.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import lower_ascii

TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    text: str
    verdict: str
    site: bool = False


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and the path before any `?` or `#`; both empty for null or without `://`."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return (lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)),
            F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def rule_regex(rule: Rule) -> str:
    """The expression a rule stands for, in the syntax that Java and RE2 share."""
    escape = lambda s: re.sub(r"([^A-Za-z0-9])", r"\\\1", s)
    if rule.site:
        host, slash, path = rule.text.partition("/")
        return f"^([^/]*\\.)?{escape(host)}{escape(slash + path)}"
    body, out = rule.text, ""
    if body.startswith("||"):
        body, out = body[2:], "^[a-z0-9+.-]*://([^/?#]*\\.)?"
    elif body.startswith("|"):
        body, out = body[1:], "^"
    end = body.endswith("|")
    for c in body[:-1] if end else body:
        out += {"*": "[\\s\\S]*", "^": "([^a-z0-9_.%-]|\\z)"}.get(c) or escape(c)
    return out + ("\\z" if end else "")


def rule_tokens(rule: Rule) -> list[str]:
    """Tokens that stand whole in every address the rule fits; [''] where there is none."""
    text = rule.text.lower()
    if rule.site:
        host, slash, path = text.partition("/")
        found = re.findall(TOKEN, host) + re.findall(f"(?<![a-z0-9]){TOKEN}(?=[^a-z0-9])", slash + path)
    else:
        left_bound = text.startswith("|")
        body = text.strip("|")
        found = [m[0] for m in re.finditer(TOKEN, body)
                 if (m.start() > 0 and body[m.start() - 1] != "*" or m.start() == 0 and left_bound)
                 and (m.end() < len(body) and body[m.end()] != "*" or m.end() == len(body) and text.endswith("|"))]
    return sorted(set(found)) or [""]


def judge_urls(urls: DataFrame, rules: list[Rule], column: str = "url", default: str = "allow") -> DataFrame:
    """(url, host, path, rule, verdict, pattern_rule) for every distinct value of the column.

    A site rule decides if one fits, the longest first. Otherwise pattern rules do: an exception
    before a block, then the longest text; pattern_rule names it. Otherwise the default holds.
    Null is one distinct value like any other, with empty host and path. Repeated addresses give
    one row; an empty table gives none. Other columns are not looked at.
    """
    spark = urls.sparkSession
    rules = list(dict.fromkeys(rules))
    filed = spark.createDataFrame(
        [(n, token, r.text, r.verdict, r.site, rule_regex(r)) for n, r in enumerate(rules) for token in rule_tokens(r)],
        "n int, token string, rule_text string, rule_verdict string, site boolean, regex string")
    host, path = host_and_path(F.col("url"))
    known = (urls.select(F.col(column).alias("url")).distinct()
             .select("url", host.alias("host"), path.alias("path"), lower_ascii(F.coalesce("url", F.lit(""))).alias("lowered")))
    tokens = known.select("*", F.explode(F.array_distinct(F.concat(
        F.array(F.lit("")), F.regexp_extract_all("lowered", F.lit(TOKEN), F.lit(0))))).alias("token"))
    counts = tokens.join(filed.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    rarest = (filed.join(counts, "token", "left")
              .groupBy("n", "rule_text", "rule_verdict", "site", "regex")
              .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("held"), "token")).alias("least"))
              .select(F.col("least.token").alias("token"), "n", "rule_text", "rule_verdict", "site", "regex"))
    fits = (tokens.join(rarest, "token")
            .where(F.rlike(F.when(F.col("site"), F.concat("host", "path")).otherwise(F.col("lowered")), F.col("regex")))
            .groupBy("url").agg(
                F.max(F.when(F.col("site"), F.struct(F.length("rule_text").alias("len"), "rule_text", "rule_verdict"))).alias("by_site"),
                F.max(F.when(~F.col("site"), F.struct((F.col("rule_verdict") == "allow").alias("first"), F.length("rule_text").alias("len"),
                                                      "rule_text", "rule_verdict"))).alias("by_pattern")))
    return (known.alias("k").join(fits.alias("f"), F.col("k.url").eqNullSafe(F.col("f.url")), "left")
            .select("k.url", "host", "path", F.col("by_site.rule_text").alias("rule"),
                    F.coalesce("by_site.rule_verdict", "by_pattern.rule_verdict", F.lit(default)).alias("verdict"),
                    F.when(F.col("by_site").isNull(), F.col("by_pattern.rule_text")).alias("pattern_rule")))


def filter_urls(pages: DataFrame, rules: list[Rule], column: str = "url", default: str = "allow") -> DataFrame:
    """The rows of pages with host, path, rule, verdict and pattern_rule; repeated rows stay repeated.

    Of pages, columns named like the new ones are replaced.
    """
    new = ["host", "path", "rule", "verdict", "pattern_rule"]
    judged = judge_urls(pages, rules, column, default).withColumnRenamed("url", "_judged")
    kept = pages.drop(*[c for c in new if c != column])
    return (kept.join(judged, kept[column].eqNullSafe(judged["_judged"]), "left")
            .select(*[kept[c] for c in kept.columns], *[judged[c] for c in new]))
