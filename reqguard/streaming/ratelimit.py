"""The rate limiter over a stream.

``rate_limit_stream`` keeps a small state value per client and takes a client's part of a
micro-batch in one task.  ``rate_limit_writer`` judges each micro-batch as a run of the batch
limiter, which spreads one client over many tasks, and carries the windows in a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ratelimit import (
    BLOCK_WINDOWS,
    RESULT,
    STATE,
    WINDOW_SECONDS,
    WindowCounter,
    last_windows,
    limited,
    open_windows,
    rate_limit,
)

_STATE = "start bigint, requests bigint, tokens bigint"
_FLAT = ["allowed", "request_count", "token_count", "reset_seconds", "exceeded"]


def rate_limit_stream(
    requests: DataFrame,
    request_limit: int = 0,
    token_limit: int = 0,
    client: str = "client_ip",
    ts: str = "ts",
    tokens: str = "tokens",
    request_id: str = "request_id",
    window_seconds: int = WINDOW_SECONDS,
    asked: str | None = None,
) -> DataFrame:
    """Add ``rate`` to every row of a stream that has a watermark on ``ts``.

    Within a micro-batch a client's requests are taken in (ts, request_id) order.  The state of a
    client is dropped once the watermark passes the end of its window: a later request would open
    a new window in any case.  Rows whose ``asked`` column is false bypass the limiter.
    """
    window = window_seconds * 1_000_000
    keep = requests.columns
    if asked is not None:
        # What the limiter does not concern never meets its keys.
        others = requests.where(~F.coalesce(F.col(asked), F.lit(False))).withColumn("rate", F.lit(None).cast(RESULT))
        judged = rate_limit_stream(
            requests.where(F.col(asked)), request_limit, token_limit, client, ts, tokens, request_id, window_seconds
        )
        return judged.unionByName(others)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        counter = WindowCounter(request_limit, token_limit, window)
        if state.exists:
            counter.start, counter.requests, counter.tokens = state.get
        batch = pd.concat(list(frames)).sort_values(["_us", "_id"], kind="stable")
        rows = []
        for us, n in zip(batch["_us"].tolist(), batch["_tokens"].tolist()):
            if counter.is_over(us):
                counter.open(us)
            rows.append(counter.admit(us, n))
        if counter.start is not None:
            state.update((counter.start, counter.requests, counter.tokens))
            end_ms = (counter.start + window) // 1000
            state.setTimeoutTimestamp(max(end_ms, state.getCurrentWatermarkMs() + 1))
        out = batch[keep].reset_index(drop=True)
        for name, values in zip(_FLAT, zip(*rows)):
            out[name] = pd.Series(values, dtype="object")
        yield out

    flat = T.StructType([*requests.schema.fields, *[RESULT[name] for name in _FLAT]])
    decided = (
        requests.withColumns(
            {
                "_us": F.coalesce(F.unix_micros(ts), F.lit(0).cast("bigint")),
                "_id": F.col(request_id),
                "_tokens": F.coalesce(F.col(tokens).cast("bigint"), F.lit(0).cast("bigint")),
            }
        )
        .groupBy(client)
        .applyInPandasWithState(step, flat, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )
    rate = F.struct(
        F.col("allowed"),
        F.col("request_count"),
        F.lit(request_limit).cast("bigint").alias("request_limit"),
        F.col("token_count"),
        F.lit(token_limit).cast("bigint").alias("token_limit"),
        F.col("reset_seconds"),
        F.col("exceeded"),
    )
    return decided.select(*keep, rate.alias("rate"))


def rate_limit_writer(
    requests: DataFrame,
    path: str,
    state: str,
    checkpoint: str,
    request_limit: int = 0,
    token_limit: int = 0,
    client: str = "client_ip",
    ts: str = "ts",
    tokens: str = "tokens",
    request_id: str = "request_id",
    window_seconds: int = WINDOW_SECONDS,
    block_windows: int = BLOCK_WINDOWS,
    lateness_seconds: int = 3600,
) -> DataStreamWriter:
    """Requests with ``rate`` and ``window_opened`` to Parquet below ``path``; call ``start()`` on the result.

    Every micro-batch is one run (see ``rate_limit_run``): a client with all of its rows is judged by
    as many tasks as its blocks of windows, and batches that follow one another in time are judged as
    one log.  No request is dropped for coming late: it counts within its client's carried window.
    Batch ``n`` reads the windows that batch ``n - 1`` left in ``state`` and replaces its own folders
    in both places when it is run again, so a restart gives the same rows once.  Only the newest
    folder of ``state`` is needed.  Windows that were over ``lateness_seconds`` before the last opening
    are left out of the next state.  With both limits 0 all is allowed, and ``window_opened`` is null.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, out = batch.sparkSession, f"{path}/batch={number}"
        if request_limit <= 0 and token_limit <= 0:
            allowed = rate_limit(batch).withColumn("window_opened", F.lit(None).cast("timestamp"))
            allowed.write.mode("overwrite").parquet(out)
            return
        before = None
        if number > 0:
            before = spark.read.schema(STATE).parquet(f"{state}/batch={number - 1}")
            latest = before.agg(F.max(F.unix_micros("opened"))).first()[0]
            if latest is not None:
                now = F.timestamp_micros(F.lit(latest - lateness_seconds * 1_000_000))
                before = open_windows(before, now, window_seconds)
        # Read more than once; a lost part is made again from the source.
        batch = batch.persist()
        try:
            names = (client, ts, tokens, request_id, window_seconds, block_windows)
            decided = limited(batch, before, request_limit, token_limit, *names)
            decided = decided.withColumn("window_opened", F.timestamp_micros("_window")).drop("_window")
            decided.write.mode("overwrite").parquet(out)
        finally:
            batch.unpersist()
        written = spark.read.schema(decided.schema).parquet(out)
        after = last_windows(written, before, client, F.col("window_opened"))
        after.write.mode("overwrite").parquet(f"{state}/batch={number}")

    return requests.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint)
