"""Helpers for building plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pinned(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add costly columns so that they are evaluated once per row, whatever is done with them.

    A filter on a projected column is pushed below the projection with the column's whole
    expression in it, so that a parse would run again for every filter (and, nested, many times
    over).  Filters on the output of a generator stay above it, while filters on other columns
    still reach the scan.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    rest = [c for c in df.columns if c not in columns]
    generated = df.select(*rest, F.explode_outer(F.array(row)).alias("_row"))
    return generated.select(*rest, *[F.col(f"_row.{name}").alias(name) for name in columns])
