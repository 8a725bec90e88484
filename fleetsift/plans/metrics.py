"""The numbers a fleet exports for scraping, as rows (metric, labels, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _row(df: DataFrame, metric: str, value, **labels) -> DataFrame:
    pairs = [x for k, c in labels.items() for x in (F.lit(k), F.col(c))]
    tags = F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,string>)")
    return df.select(F.lit(metric).alias("metric"), tags.alias("labels"), value.cast("double").alias("value"))


def fleet_metrics(accounting: DataFrame, rules: DataFrame, instance_totals: DataFrame,
                  anomalies: DataFrame, nodes: DataFrame, edges: DataFrame, shifts: DataFrame) -> DataFrame:
    """Ingest counters, rules, window totals per instance, anomalies and the graph."""
    number = lambda df, metric: _row(df.agg(F.count("*").alias("n")), metric, F.col("n"))
    ends = dict(source="source", target="target", protocol="protocol", channel="channel")
    parts = [
        _row(accounting, "ingest_total", F.col("total")),
        _row(accounting, "hotpath_matches_total", F.col("matched")),
        _row(accounting, "coldpath_buffered_total", F.col("unstructured")),
        number(rules, "templates_active"),
        _row(instance_totals, "events_by_instance", F.col("n"), instance="instance"),
        _row(anomalies, "anomaly_active", F.lit(1), instance="instance", event="event"),
        number(nodes, "graph_nodes_total"), number(edges, "graph_edges_total"),
        number(shifts, "graph_shifts_active"),
        _row(edges, "graph_edge_rate_1m", F.col("rate_1m"), **ends, status="status"),
        _row(edges, "graph_edge_bytes_per_sec", F.col("bytes_per_sec"), **ends),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
