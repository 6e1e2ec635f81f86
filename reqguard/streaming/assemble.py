"""Body assembly over streams of header and chunk events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.encoding import decode_base64_strict, is_utf8

_STATE = "opened_seq bigint, header string, us bigint, body binary, events bigint"
_OUT = (
    "correlation_id string, opened_seq bigint, header string, us bigint, body binary, finished boolean,"
    " events bigint, reason string, open_change int"
)
_NAMES = ["correlation_id", "opened_seq", "header", "us", "body", "finished", "events", "reason", "open_change"]
TIMEOUT, RESET, ORPHAN, UNDECODABLE, OPENED = "timeout", "reset", "orphan", "undecodable", "opened"
# Times in a header keep their microseconds.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def header_fields(headers: DataFrame, ts: str = "timestamp") -> str:
    """What a request keeps of its header event: every field but those that place it in the stream."""
    kept = [f for f in headers.schema if f.name not in ("correlation_id", "seq", ts)]
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)


def body_events(headers: DataFrame, chunks: DataFrame, ts: str = "timestamp", watermark: str = "1 minute") -> DataFrame:
    """Both event streams as one, with a watermark on event time.

    Chunks carry the event-time column too; ``seq`` is the arrival order within an id.  The fields
    of a header travel as one JSON text, of whatever types they are.
    """
    kept = [c for c in headers.columns if c not in ("correlation_id", "seq", ts)]
    head = headers.select(
        "correlation_id",
        "seq",
        F.col(ts).alias("event_time"),
        F.lit(True).alias("is_header"),
        F.lit(False).alias("is_last"),
        F.to_json(F.struct(*kept), _JSON).alias("header"),
        F.lit(None).cast("binary").alias("bytes"),
    )
    tail = chunks.select(
        "correlation_id",
        "seq",
        F.col(ts).alias("event_time"),
        F.lit(False).alias("is_header"),
        F.coalesce("is_last", F.lit(False)).alias("is_last"),
        F.lit(None).cast("string").alias("header"),
        decode_base64_strict(F.col("data")).alias("bytes"),
    )
    return head.unionByName(tail).withWatermark("event_time", watermark)


def assemble_stream(
    events: DataFrame,
    ttl_seconds: int = 300,
    fields: str = "client_ip string, uri string",
    account: bool = False,
) -> DataFrame:
    """Requests of a stream of body events; ``fields`` are those of the header (``header_fields``).

    A header resets the state of its id, the last chunk emits the request and frees the state.  A
    request that stays unfinished for ``ttl_seconds`` of event time is emitted as far as it came,
    with ``finished`` false.

    With ``account``, every event shows in some row: ``events`` tells how many a row holds, and
    ``reason`` why it is no finished request: ``timeout``; ``reset``, an open request that another
    header cut off; ``orphan``, chunks while no request was open; ``undecodable``, chunks that are
    not canonical base64.  Rows behind the watermark never get here: ``LateRows`` counts those.
    A request that its batch opens and leaves open has a row ``opened``, without events.
    ``open_change`` is what a row adds to the number of open requests at the end of its batch.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            opened, header, us, body, events = state.get
            state.remove()
            yield pd.DataFrame([(key[0], opened, header, us, bytes(body), False, events, TIMEOUT, -1)], columns=_NAMES)
            return
        current = list(state.get) if state.exists else None
        parts = [bytes(current[3])] if current else []
        held = current[4] if current else 0
        closing = -1 if current else 0  # requests of this batch never counted as open
        done = []
        latest_us = 0
        batch = pd.concat(list(frames)).sort_values("seq", kind="stable")
        for row in batch.itertuples(index=False):
            latest_us = max(latest_us, row.us)
            if row.is_header:
                if current is not None:
                    done.append((key[0], *current[:3], b"".join(parts), False, held, RESET, closing))
                current, parts, held, closing = [row.seq, row.header, row.us, b""], [], 1, 0
            elif current is None:
                body = b"" if row.bytes is None else bytes(row.bytes)
                done.append((key[0], row.seq, None, row.us, body, False, 1, ORPHAN, 0))
            else:
                if row.bytes is not None:
                    parts.append(bytes(row.bytes))
                    held += 1
                else:
                    done.append((key[0], row.seq, None, row.us, b"", False, 1, UNDECODABLE, 0))
                if row.is_last:
                    done.append((key[0], *current[:3], b"".join(parts), True, held, None, closing))
                    current, parts, closing = None, [], 0
        if current is not None:
            if closing == 0:
                done.append((key[0], *current[:3], b"", False, 0, OPENED, 1))
            state.update((*current[:3], b"".join(parts), held))
            state.setTimeoutTimestamp(
                max(latest_us // 1000 + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1)
            )
        elif state.exists:
            state.remove()
        if done:
            yield pd.DataFrame(done, columns=_NAMES)

    assembled = (
        events.withColumn("us", F.unix_micros("event_time"))
        .groupBy("correlation_id")
        .applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )
    if not account:
        assembled = assembled.where(F.col("finished") | (F.col("reason") == TIMEOUT))
    body = F.col("body").cast("string")
    return assembled.withColumn("_h", F.from_json("header", fields, _JSON)).select(
        "correlation_id",
        "opened_seq",
        "_h.*",
        F.timestamp_micros("us").alias("ts"),
        body.alias("body"),
        is_utf8(body).alias("body_is_utf8"),
        "finished",
        *(["events", "reason", "open_change"] if account else []),
    )
