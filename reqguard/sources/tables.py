"""Readers for Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_spread(spark: SparkSession, path: str, columns: list[str], key: list[str]) -> DataFrame:
    """Columns of a Parquet table, over at least as many partitions as there are cores.

    Parsing and scanning are bound by CPU, and a table in a single row group would keep all of it
    on one core.  A table with enough splits, which any large one has, is read as it lies.
    """
    table = spark.read.parquet(path).select(*columns)
    cores = spark.sparkContext.defaultParallelism
    if table.rdd.getNumPartitions() >= cores:
        return table
    return table.repartition(cores, *key)
