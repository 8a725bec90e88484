"""Who owns an address: joins with ownership and reverse-name tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from .threats import rank_key, top_members

OWNER_COLUMNS = ["asn", "prefix", "country", "registry", "allocated", "org"]


def _clean(table: DataFrame) -> DataFrame:
    """'NA' for a number and empty text for anything mean: not known."""
    cols = {c: F.nullif(F.trim(c), F.lit("")) for c in OWNER_COLUMNS}
    cols["asn"] = F.nullif(cols["asn"], F.lit("NA"))
    return table.withColumns(cols)


def attach_owner(actors: DataFrame, owners: DataFrame, rdns: DataFrame | None = None) -> DataFrame:
    """Left join of an ownership table keyed by ip, and of reverse names (ip, rdns)."""
    out = actors.join(_clean(owners).select("ip", *OWNER_COLUMNS), "ip", "left")
    if rdns is None:
        return out.withColumn("rdns", F.lit(None).cast("string"))
    return out.join(rdns.select("ip", "rdns"), "ip", "left")


def _bits(address):
    """An IPv4 or IPv6 address as text of 32 or 128 binary digits; null for anything else."""
    octets = F.transform(F.split(address, r"\."), lambda x: F.lpad(F.bin(x.try_cast("bigint")), 8, "0"))
    halves = F.split(F.lower(address), "::")
    groups = lambda half: F.filter(F.split(F.coalesce(F.get(halves, half), F.lit("")), ":"), lambda x: x != "")
    left, right = groups(0), groups(1)
    zeros = F.array_repeat(F.lit("0"), 8 - F.size(left) - F.size(right))
    nibbles = F.split(F.array_join(F.transform(F.concat(left, zeros, right), lambda x: F.lpad(x, 4, "0")), ""), "")
    wide = F.array_join(F.transform(nibbles, lambda x: F.lpad(F.conv(F.bin(F.conv(x, 16, 10).try_cast("bigint")), 2, 2), 4, "0")), "")
    found = (F.when(address.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.array_join(octets, ""))
             .when(address.rlike(r"(?i)^[0-9a-f:]*:[0-9a-f:]*$") & (F.size(left) + F.size(right) <= 8), wide))
    return F.when(F.length(found).isin(32, 128), found)


def owners_by_prefix(addresses: DataFrame, netblocks: DataFrame) -> DataFrame:
    """Ownership of each address from a table by netblock, IPv4 or IPv6; the longest prefix wins.

    Every address meets one candidate network per prefix length in use, so this
    is an equi-join on the network's binary digits instead of a range comparison.
    """
    blocks = (_clean(netblocks).withColumn("length", F.substring_index("prefix", "/", -1).try_cast("int"))
              .withColumn("bits", _bits(F.substring_index("prefix", "/", 1)))
              .filter(F.col("length").between(0, F.length("bits")))
              .withColumn("wide", F.length("bits")).withColumn("network", F.expr("substring(bits, 1, length)")))
    used = blocks.select("wide", "length").distinct().collect()  # at most 33 + 129 rows
    probes = (addresses.select("ip").distinct().withColumn("bits", _bits(F.col("ip"))).filter("bits is not null")
              .withColumn("wide", F.length("bits"))
              .withColumn("length", F.explode(F.filter(F.array(*[F.struct(F.lit(r["wide"]).alias("w"), F.lit(r["length"]).alias("n")) for r in used]),
                                                       lambda u: u["w"] == F.col("wide"))["n"]))
              .withColumn("network", F.expr("substring(bits, 1, length)"))) if used else None
    if probes is None:
        return blocks.select(F.lit(None).cast("string").alias("ip"), *OWNER_COLUMNS).limit(0)
    found = probes.select("ip", "wide", "length", "network").join(blocks.drop("bits"), ["wide", "length", "network"])
    return found.groupBy("ip").agg(
        F.max_by(F.struct(*OWNER_COLUMNS), F.struct("length", "prefix", "asn")).alias("owner")
    ).select("ip", "owner.*")


def owners(actors: DataFrame) -> DataFrame:
    """Actors grouped by the network that owns them."""
    keyed = cut_lineage(actors.select(
        "ip", "asn", "org", "country", "prefix", "techniques", "score", "hostile_hits", "newest",
        F.coalesce("asn", F.lit("unknown")).alias("group")))
    totals = keyed.groupBy("group").agg(
        F.count("*").alias("actor_count"), F.sum("hostile_hits").alias("hits"),
        F.max(F.struct(rank_key().alias("rank"), "asn", "org", "country")).alias("top"))
    order = Window.partitionBy("group").orderBy("prefix")
    prefixes = (keyed.filter("prefix is not null").select("group", "prefix").distinct()
                .withColumn("place", F.row_number().over(order)).filter("place <= 6")
                .groupBy("group").agg(F.array_sort(F.collect_list("prefix")).alias("prefixes")))
    techniques = (keyed.select("group", F.explode(F.map_keys("techniques")).alias("t")).distinct()
                  .groupBy("group").agg(F.array_sort(F.collect_list("t")).alias("techniques")))
    return (totals.join(top_members(keyed, "group"), "group")
            .join(prefixes, "group", "left").join(techniques, "group", "left")
            .select(F.col("top.asn").alias("asn"), F.col("top.org").alias("org"),
                    F.col("top.country").alias("country"), "actor_count", "actors", "hits",
                    F.coalesce("prefixes", F.array().cast("array<string>")).alias("prefixes"),
                    "techniques"))


def order_owners(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("actor_count"), F.desc("hits"), "asn")
