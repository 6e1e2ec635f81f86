"""Readers for event logs and the verdict sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADER_SCHEMA = T.StructType(
    [
        T.StructField("correlation_id", T.StringType()),
        T.StructField("request_id", T.StringType()),
        T.StructField("client_ip", T.StringType()),
        T.StructField("client_port", T.IntegerType()),
        T.StructField("server_name", T.StringType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("tls_version", T.StringType()),
        T.StructField("tls_cipher", T.StringType()),
        T.StructField("route_id", T.StringType()),
        T.StructField("upstream_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("traceparent", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("uri", T.StringType()),
        T.StructField("headers", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
        T.StructField("seq", T.LongType()),
    ]
)

CHUNK_SCHEMA = T.StructType(
    [
        T.StructField("correlation_id", T.StringType()),
        T.StructField("data", T.StringType()),
        T.StructField("is_last", T.BooleanType()),
        T.StructField("total_size", T.LongType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("bytes_received", T.LongType()),
        T.StructField("seq", T.LongType()),
    ]
)


def read_headers(spark: SparkSession, path: str, fmt: str = "parquet", stream: bool = False) -> DataFrame:
    """Request-header events; the schema is fixed, never inferred."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(HEADER_SCHEMA).format(fmt).load(path)


def read_chunks(spark: SparkSession, path: str, fmt: str = "parquet", stream: bool = False) -> DataFrame:
    """Body-chunk events."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(CHUNK_SCHEMA).format(fmt).load(path)


def write_verdicts(verdicts: DataFrame, path: str, ts: str = "ts", mode: str = "append") -> None:
    """Verdicts as Parquet, one folder per day."""
    dated = verdicts.withColumn("date", F.to_date(ts))
    dated.write.mode(mode).partitionBy("date").parquet(path)
