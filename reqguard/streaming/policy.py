"""Policy evaluation, metrics and sinks for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener
from pyspark.sql.streaming.listener import (
    QueryIdleEvent,
    QueryProgressEvent,
    QueryStartedEvent,
    QueryTerminatedEvent,
)
from pyspark.sql.types import StructType

from ..config import PolicyConfig
from ..operators.metrics import traffic_metrics_per_minute
from ..operators.ratelimit import RESULT
from ..plans.policy import CHECKED, assess, decide
from .assemble import OPENED
from .ratelimit import rate_limit_stream


def evaluate_policy_stream(
    requests: DataFrame,
    config: PolicyConfig = PolicyConfig(),
    request_id: str = "request_id",
    client: str = "client_ip",
    ts: str = "ts",
) -> DataFrame:
    """Verdicts for a stream of requests that has a watermark on ``ts``.

    Without a rate limit the job is stateless.  With one, the short assessments (no text) pass
    through the limiter's keyed state; requests it does not concern pass unchanged.
    """
    keep = (request_id, client, ts)
    assessed = assess(requests, config, *keep)
    if not config.rate_limited:
        return decide(assessed.withColumn("rate", F.lit(None).cast(RESULT)), config, *keep)
    rated = rate_limit_stream(
        assessed.withColumn("asked", F.col("stage") == CHECKED),
        config.rate_limit_requests,
        config.rate_limit_tokens,
        client=client,
        ts=ts,
        request_id=request_id,
        asked="asked",
    )
    return decide(rated.drop("asked"), config, *keep)


def metrics_stream(verdicts: DataFrame, ts: str = "ts", watermark: str | None = None) -> DataFrame:
    """Counters per minute; a minute is emitted once the watermark has passed it.

    Verdicts of a watermarked request stream keep its watermark; verdicts read back from the sink
    need one here.
    """
    if watermark is not None:
        verdicts = verdicts.withWatermark(ts, watermark)
    return traffic_metrics_per_minute(verdicts, ts)


def verdict_writer(verdicts: DataFrame, path: str, checkpoint: str, ts: str = "ts") -> DataStreamWriter:
    """Append verdicts to Parquet, one folder per day; call ``start()`` on the result."""
    dated = verdicts.withColumn("date", F.to_date(ts))
    return (
        dated.writeStream.format("parquet")
        .outputMode("append")
        .partitionBy("date")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )


def request_writer(assembled: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Finished requests of ``assemble_stream`` to Parquet; ``accounted_writer`` also writes the others.

    Assembly and the limiter both keep state of their own, which one query cannot hold twice: this
    query ends at the files, and a second one reads them (``read_requests``) and judges.
    """
    ready = assembled.where("finished").withColumnRenamed("correlation_id", "request_id")
    return (
        ready.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )


def accounted_writer(
    assembled: DataFrame, path: str, aside: str, checkpoint: str, gauge: str | None = None
) -> DataStreamWriter:
    """Finished requests to ``path``, and what did not become one, with its reason, to ``aside``.

    ``assembled`` comes from ``assemble_stream`` with ``account``.  Each batch has a folder of its
    own in all places and replaces it when it is run again, so a row is written once.

    ``gauge`` gets one row a batch: ``in_flight_requests``, how many are open when the batch ends,
    which is what the batch before left and the batch's own changes.  It belongs to ``checkpoint``
    and starts with it; a batch whose forerunner has no row fails rather than count from zero.
    """

    def write(batch: DataFrame, number: int) -> None:
        # Held for all writes; a lost part is made again from the state of the batch before.
        batch = batch.persist()
        try:
            finished = batch.where("finished").drop("reason", "open_change")
            finished = finished.withColumnRenamed("correlation_id", "request_id")
            finished.write.mode("overwrite").parquet(f"{path}/batch={number}")
            others = batch.where((~F.col("finished")) & (F.col("reason") != OPENED)).drop("open_change")
            others.write.mode("overwrite").parquet(f"{aside}/batch={number}")
            if gauge is not None:
                changes = batch.select(F.col("open_change").cast("bigint").alias("n"))
                if number > 0:
                    before = batch.sparkSession.read.parquet(f"{gauge}/batch={number - 1}")
                    changes = changes.unionByName(before.select(F.col("in_flight_requests").alias("n")))
                now = changes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("in_flight_requests"))
                now.write.mode("overwrite").parquet(f"{gauge}/batch={number}")
        finally:
            batch.unpersist()

    return assembled.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint)


def read_requests(spark: SparkSession, path: str, schema: StructType, watermark: str) -> DataFrame:
    """Requests that ``request_writer`` writes, as a stream with a watermark on ``ts``."""
    return spark.readStream.schema(schema).parquet(path).withWatermark("ts", watermark)


class LateRows(StreamingQueryListener):
    """Rows that arrived behind the watermark and were dropped, counted over the whole run of each query.

    Register it with ``spark.streams.addListener`` before a query starts.
    """

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        self.dropped.setdefault(str(event.runId), 0)

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        run = str(event.progress.runId)
        late = sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
        self.dropped[run] = self.dropped.get(run, 0) + late

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        pass
