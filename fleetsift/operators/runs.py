"""Longest run of flagged rows per key, in order, safe for a key of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage

PIECE = "key string, at timestamp, id long, n long, lead long, tail long, best long"


def _piece(key, at, row_id, flags: np.ndarray) -> dict:
    """Length, leading run, trailing run and longest run of one stretch of rows."""
    breaks = np.flatnonzero(~flags)
    n = len(flags)
    if len(breaks) == 0:
        lead = tail = best = n
    else:
        lead, tail = int(breaks[0]), int(n - 1 - breaks[-1])
        best = int(max(lead, tail, (np.diff(breaks) - 1).max(initial=0)))
    return {"key": key, "at": at, "id": row_id, "n": n, "lead": lead, "tail": tail, "best": best}


def _merge(a: dict, b: dict) -> dict:
    return dict(a, n=a["n"] + b["n"],
                lead=a["n"] + b["lead"] if a["lead"] == a["n"] else a["lead"],
                tail=b["n"] + a["tail"] if b["tail"] == b["n"] else b["tail"],
                best=max(a["best"], b["best"], a["tail"] + b["lead"]))


def _summarize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows in, one piece per key and task out; only the open key is carried."""
    open_piece = None
    for batch in batches:
        if batch.empty:
            continue
        keys = batch["key"].to_numpy()
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        flags = batch["flag"].to_numpy(dtype=bool)
        done = []
        for lo, hi in zip(starts, np.r_[starts[1:], len(keys)]):
            piece = _piece(keys[lo], batch["at"].iloc[lo], batch["id"].iloc[lo], flags[lo:hi])
            if open_piece is not None and open_piece["key"] == piece["key"]:
                open_piece = _merge(open_piece, piece)
                continue
            if open_piece is not None:
                done.append(open_piece)
            open_piece = piece
        if done:
            yield pd.DataFrame(done)
    if open_piece is not None:
        yield pd.DataFrame([open_piece])


def longest_run(rows: DataFrame, written: bool = False) -> DataFrame:
    """(key, longest_run) of rows (key, at, id, flag), ordered by at, then id.

    Rows are range-partitioned by (key, at, id), so a key holding a third of the
    table is spread over a third of the tasks. Each task reduces its stretch of a
    key to one piece; the pieces of a key, at most one per task, are then joined
    up in order. Range partitioning reads its input twice, so the narrow input is
    written first unless it comes from written files anyway.
    """
    narrow = rows.select("key", "at", "id", "flag")
    narrow = narrow if written else cut_lineage(narrow)
    ordered = narrow.repartitionByRange("key", "at", "id").sortWithinPartitions("key", "at", "id")
    pieces = ordered.mapInPandas(_summarize, PIECE)

    def join_up(acc, p):
        full = acc["tail"] + p["lead"]
        return F.struct(
            F.when(p["tail"] == p["n"], acc["tail"] + p["n"]).otherwise(p["tail"]).alias("tail"),
            F.greatest(acc["best"], p["best"], full).alias("best"))

    zero = F.struct(F.lit(0).cast("long").alias("tail"), F.lit(0).cast("long").alias("best"))
    in_order = F.array_sort(F.collect_list(F.struct("at", "id", "n", "lead", "tail", "best")))
    return (pieces.groupBy("key").agg(in_order.alias("pieces"))
            .select("key", F.aggregate("pieces", zero, join_up, lambda a: a["best"]).alias("longest_run")))
