"""Columns of an operator's own beside those of its input."""

from __future__ import annotations

from pyspark.sql import DataFrame


def set_aside(docs: DataFrame, *reserved: str) -> DataFrame:
    """``docs`` with other names for columns that bear a reserved one, in their order.

    Letter case does not part names, as in Spark.  ``toDF`` of the old names gives those back.
    """
    taken = {c.lower() for c in docs.columns} | set(reserved)
    names = []
    for column in docs.columns:
        name = column
        while column.lower() in reserved and name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return docs if names == docs.columns else docs.toDF(*names)
