"""Keeping costly columns computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def only_where(df: DataFrame, condition: Column, computed: list[str], carried: list[str] = ()) -> DataFrame:
    """Rows that meet condition, with the carried and computed columns.

    A filter on a computed column is pushed below the projection that computes it
    and so evaluates the expression again, once per reference. A generator over an
    array of no or one struct keeps the rows without offering a filter to push.
    """
    one = F.when(condition, F.array(F.struct(*computed)))
    return df.select(*carried, F.inline(one))


def with_value(value: Column, then) -> Column:
    """then(value), with the value worked out once also where Spark shares no common parts."""
    return F.get(F.transform(F.array(value), then), F.lit(0))
