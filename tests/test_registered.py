"""A sample of the registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"create view {name.split('.')[0]} as select * from '{sf}/{name}'")
    return con


def plain(v):
    return int(v) if v is not None and not isinstance(v, (str, bool)) and v == int(v) else v


SAMPLE = ["search_value", "search_value_indexed", "search_field_indexed", "search_port_indexed", "count_values_indexed", "threat_actors", "campaigns", "behaviour_profiles", "findings_upserted", "presence", "anomaly_states",
          "edges", "subgraph_search", "time_lapse", "matched_lines", "clusters", "ecs_rows", "normalized_fields",
          "stream_anomalies", "stream_unit_alerts", "stream_dedup", "stream_pages", "stream_chunks", "stream_shifts", "mixed_actors", "actors_ordered", "counts_by_window"]


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, sf, con, name):
    got = entry.queries()[name](spark, sf)
    cols = sorted(got.columns)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == cols
    index = [want.columns.index(c) for c in cols]
    rows = sorted([tuple(plain(r[c]) for c in cols) for r in got.collect()], key=repr)
    assert rows == sorted([tuple(plain(r[i]) for i in index) for r in want.fetchall()], key=repr)


def test_entry_and_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
