"""Lines in, stored rows out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.templates import Rule
from ..plans.ingest import ingest_lines, to_store
from ..sources.events import stored_rows


def ingest_stream(lines: DataFrame, rules: list[Rule], as_of=None) -> DataFrame:
    """Stored rows of a stream of lines (id, raw, labels, ts): no state, no shuffle."""
    now = F.current_timestamp() if as_of is None else as_of
    return stored_rows(to_store(ingest_lines(lines, rules, now)), as_of)


def write_stream(rows: DataFrame, path: str, checkpoint: str, available_now: bool = False):
    """Append to the partitioned table; exactly once through the checkpoint."""
    writer = (rows.writeStream.format("parquet").outputMode("append").partitionBy("event_date")
              .option("path", path).option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if available_now
            else writer.trigger(processingTime="15 seconds")).start()
