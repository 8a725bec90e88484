"""What a client claims to be."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as V


def claims_browser(ua: Column) -> Column:
    return F.coalesce(ua.rlike(f"(?i){V.BROWSER_AGENT}"), F.lit(False))


def is_candid(ua: Column) -> Column:
    """The agent names itself as tooling."""
    return F.coalesce(ua.rlike(f"(?i){V.CANDID_AGENT}"), F.lit(False))


def is_asset(path: Column) -> Column:
    return F.coalesce(path.rlike(f"(?i){V.ASSET_PATH}"), F.lit(False))


def crawler_claim(ua: Column) -> Column:
    """First verifiable crawler named in the agent, or null."""
    low = F.lower(ua)
    return F.coalesce(*[F.when(low.contains(name), F.lit(name)) for name in V.VERIFIABLE_CRAWLERS])


def _suffixes(name: Column) -> Column:
    pairs = [x for k, v in V.VERIFIABLE_CRAWLERS.items()
             for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))]
    return F.try_element_at(F.create_map(*pairs), name)


def crawler_verdict(name: Column, rdns: Column) -> Column:
    """struct(verified, reason) of a crawler claim; null when nothing is claimed.

    A missing reverse name contradicts the claim: every operator publishes one.
    """
    host = F.rtrim(F.lower(rdns), F.lit("."))
    suffixes = _suffixes(name)
    ok = F.exists(suffixes, lambda s: F.endswith(host, s))
    missing = rdns.isNull() | (rdns == "")
    why_missing = F.concat(F.lit("claims "), name, F.lit(
        " but the address has no reverse DNS -- every real one publishes it so this check can be made"))
    why_wrong = F.concat(F.lit("claims "), name, F.lit(" but reverse DNS is "), host,
                         F.lit(", which is not "),
                         F.array_join(F.transform(suffixes, lambda s: F.ltrim(s, F.lit("."))), " or "))
    return F.when(name.isNotNull(),
                  F.when(missing, F.struct(F.lit(False).alias("verified"), why_missing.alias("reason")))
                  .when(ok, F.struct(F.lit(True).alias("verified"), F.lit("").alias("reason")))
                  .otherwise(F.struct(F.lit(False).alias("verified"), why_wrong.alias("reason"))))


def ua_anachronism(ua: Column) -> Column:
    """Why nobody could still run this agent, or null."""
    found = []
    for pattern, floor, name in V.OLDEST_LIVING_BROWSER:
        version = F.regexp_extract(ua, f"(?i){pattern}", 1).try_cast("int")
        found.append(F.when(version < floor, F.concat(
            F.lit(f"claims {name} "), version.cast("string"), F.lit(", a build no current user runs"))))
    found.append(F.when(ua.rlike(f"(?i){V.ANCIENT_PLATFORM}"),
                        F.lit("claims a platform or engine that is long out of service")))
    return F.coalesce(*found)
