"""Declared topology: nodes, edges and the node the collector runs on."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import cut_lineage

NODE = "id string, name string, type string, ip string, ips array<string>, role string"
EDGE = ("source string, target string, protocol string, channel string, "
        "expected_min_rate double")
FILE = T.StructType([
    T.StructField("self", T.StringType()),
    T.StructField("nodes", T.ArrayType(T.StructType([
        T.StructField(n, T.StringType() if n != "ips" else T.ArrayType(T.StringType()))
        for n in ("id", "name", "type", "ip", "ips", "role")]))),
    T.StructField("edges", T.ArrayType(T.StructType([
        T.StructField(n, T.StringType()) for n in
        ("source", "target", "protocol", "channel", "expected_min_rate")]))),
])


@dataclass
class Topology:
    """nodes (id, name, type, ip, ips, role), edges, and the collector's own node id."""
    nodes: DataFrame
    edges: DataFrame
    self_node: str = "hub"
    ingest_service: str = "ingest"

    def aliases(self) -> DataFrame:
        """(alias, node_id): every id and every address a node is known by.

        An id is always itself; an address claimed twice goes to the last id in
        name order.
        """
        ids = self.nodes.select(F.col("id").alias("alias"), F.col("id").alias("node_id"), F.lit(1).alias("own"))
        ips = self.nodes.select(F.explode("ips").alias("alias"), F.col("id").alias("node_id"), F.lit(0).alias("own"))
        return ids.union(ips).groupBy("alias").agg(F.max_by("node_id", F.struct("own", "node_id")).alias("node_id"))

    @cached_property
    def lookup(self) -> DataFrame:
        """aliases, written once, so that their size is known where they are joined."""
        return cut_lineage(self.aliases())

    @cached_property
    def ids(self) -> DataFrame:
        """(node_id), written once, so that their size is known where they are joined."""
        return cut_lineage(self.nodes.select(F.col("id").alias("node_id")).distinct())

    def internal_addresses(self) -> DataFrame:
        """(ip) of everything that resolves to a declared node."""
        return self.aliases().filter(~F.col("node_id").startswith("external:")).select(F.col("alias").alias("ip"))


def nothing_declared(spark: SparkSession, self_node: str = "hub") -> Topology:
    edges = spark.createDataFrame([], EDGE + ", is_declared boolean")
    return Topology(spark.createDataFrame([], NODE), edges, self_node)


def topology_of(spark: SparkSession, nodes: DataFrame, edges: DataFrame, self_node: str = "hub") -> Topology:
    """Defaults filled in; entries without an id, source or target are skipped."""
    ips = F.coalesce("ips", F.array().cast("array<string>"))
    with_ip = F.when(F.col("ip").isNull() | (F.col("ip") == "") | F.array_contains(ips, F.col("ip")), ips
                     ).otherwise(F.concat(F.array("ip"), ips))
    full_nodes = nodes.filter("id is not null").select(
        "id", F.coalesce(F.nullif("name", F.lit("")), "id").alias("name"),
        F.coalesce("type", F.lit("server")).alias("type"), "ip", with_ip.alias("ips"),
        F.coalesce("role", F.lit("")).alias("role"))
    rate = F.col("expected_min_rate").cast("string").try_cast("double")
    full_edges = (edges.filter("source is not null and target is not null")
                  .filter(F.col("expected_min_rate").isNull() | rate.isNotNull())
                  .select("source", "target", F.coalesce("protocol", F.lit("tcp")).alias("protocol"),
                          F.coalesce("channel", F.lit("default")).alias("channel"),
                          F.coalesce(rate, F.lit(0.0)).alias("expected_min_rate"),
                          F.lit(True).alias("is_declared")))
    return Topology(full_nodes, full_edges, self_node)


def read_topology(spark: SparkSession, path: str) -> Topology:
    """A missing or unreadable file declares nothing."""
    try:
        rows = spark.read.schema(FILE).option("multiLine", True).json(path)
        head = rows.select("self", F.col("nodes").isNotNull().alias("ok")).first()
    except Exception:
        return nothing_declared(spark)
    if head is None:
        return nothing_declared(spark)
    return topology_of(spark, rows.select(F.inline("nodes")), rows.select(F.inline("edges")),
                       head["self"] or "hub")
