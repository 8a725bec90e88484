"""Steps several text operators share."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = re.compile(r"[^\x20\x09-\x0d]+")
WORD_GAP = r"[\x20\x09-\x0d]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, nothing else changed."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_GAP)
    return F.filter(parts, lambda w: w != "")


def one_row_each(rows: DataFrame, id: str) -> DataFrame:
    """One row of each id, the one whose other columns have the lowest hash; rows that meet are reduced before they move."""
    others = [c for c in rows.columns if c != id]
    return (rows.groupBy(id).agg(F.min_by(F.struct(*others), F.xxhash64(*others)).alias("_row"))
            .select(*[id if c == id else F.col(f"_row.{c}") for c in rows.columns]))


def arrow_schema(schema: str) -> pa.Schema:
    """The Arrow form of a schema string."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string
    kinds = _parse_datatype_string(schema)
    assert isinstance(kinds, StructType)
    return to_arrow_schema(kinds)


def map_batches(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str) -> DataFrame:
    """df through a Python function of whole column lists, batch by batch.

    make() runs once per task and returns the function; it gets {column: list} and returns the same
    shape for the new schema. A task holds one batch at a time.
    """
    arrow = arrow_schema(schema)

    def run(batches):
        work = make()
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(work(batch.to_pydict()), schema=arrow)

    return df.mapInArrow(run, schema)
