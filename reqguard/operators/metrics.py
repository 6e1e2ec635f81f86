"""Traffic counters over verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _counters() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("requests_total"),
        F.count_if(F.col("decision") == "block").alias("requests_blocked_total"),
        F.count_if("injection").alias("prompt_injection_detections_total"),
        F.count_if("pii").alias("pii_detections_total"),
        F.count_if("jailbreak").alias("jailbreak_detections_total"),
    ]


def traffic_metrics(verdicts: DataFrame) -> DataFrame:
    """The five counters over all verdicts (one row)."""
    return verdicts.agg(*_counters())


def traffic_metrics_per_minute(verdicts: DataFrame, ts: str = "ts", width: str = "1 minute") -> DataFrame:
    """The five counters per tumbling window of event time; for tables and for streams."""
    return (
        verdicts.groupBy(F.window(ts, width).alias("_w"))
        .agg(*_counters())
        .select(F.col("_w.start").alias("minute"), "*")
        .drop("_w")
    )


def with_in_flight(metrics: DataFrame, open_headers: DataFrame) -> DataFrame:
    """Add the gauge ``in_flight_requests`` to the one-row totals."""
    gauge = open_headers.agg(F.count(F.lit(1)).alias("in_flight_requests"))
    both = metrics.unionByName(gauge, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])
