"""Evaluate costly columns exactly once per row."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that the optimizer neither copies into filters nor repeats in later columns.

    A filter on a computed column is pushed below the projection, with the whole expression copied
    into it; over a chain of text columns that grows without end.  Going through a one-element
    generator keeps the columns out of such rewrites.  Filters on other columns still move down.
    """
    made = F.struct(*[column.alias(name) for name, column in columns.items()])
    kept = [F.col(name) for name in df.columns if name not in columns]
    return df.select(*kept, F.inline(F.array(made)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)
