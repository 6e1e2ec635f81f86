"""Per-client rate limiting over fixed windows anchored at the first request.

A client's first request opens a window; the first request at or after its end opens the next.
Whether a request opens a window depends on arrival times alone, so the time line of a client is
cut into blocks that many tasks work on at once:

1. per (client, block): for each time at which a window may first open in the block, the start of
   the last window that then opens in it, stored as a short step function;
2. the step functions are composed in a tree: those of ``BLOCKS_TOGETHER`` blocks become one for
   all of them, per client a running pass over the composed ones gives the end of the window that
   reaches into each group of blocks, and a pass within each group gives it for each block.  A task
   meets one group's functions, or one composed function for each group of a client;
3. per (client, block): all windows that open in the block are counted to their end.  Requests in
   the first window length of a block also go to the block before, where they may belong.  With a
   limit on requests alone, counting is a rank within the window; a limit on tokens depends on what
   was denied before, and takes a pass in order.

A client with a large share of all requests is thus spread over as many tasks as it has blocks.

A log that arrives run by run is judged as if it were one: a run takes each client's open window
from the run before (``STATE``) and hands on its own.  An open window enters as one event at the
time it was opened, which makes the same windows follow from it as if all its requests were there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

WINDOW_SECONDS = 60  # fixed value: the default window
BLOCK_WINDOWS = 16
BLOCKS_TOGETHER = 256

RESULT = T.StructType(
    [
        T.StructField("allowed", T.BooleanType()),
        T.StructField("request_count", T.LongType()),
        T.StructField("request_limit", T.LongType()),
        T.StructField("token_count", T.LongType()),
        T.StructField("token_limit", T.LongType()),
        T.StructField("reset_seconds", T.LongType()),
        T.StructField("exceeded", T.StringType()),
    ]
)

#: The last window of each client: when it opened, and what it has admitted.
STATE = T.StructType(
    [
        T.StructField("client", T.StringType()),
        T.StructField("opened", T.TimestampType()),
        T.StructField("requests", T.LongType()),
        T.StructField("tokens", T.LongType()),
    ]
)


def last_window_steps(times: np.ndarray, block_start: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Step function of one block: (latest permitted opening time, start of the last window).

    ``times`` are the block's distinct request times, ascending.  Only requests in the first
    window length, and the first one after it, can be the first to open a window here.
    """
    n_first = min(int(np.searchsorted(times, block_start + window)) + 1, len(times))
    last = np.arange(n_first)
    while True:
        following = np.searchsorted(times, times[last] + window)
        moving = following < len(times)
        if not moving.any():
            break
        last = np.where(moving, following, last)
    ends = times[last]
    keep = np.append(ends[1:] != ends[:-1], True)
    return times[:n_first][keep], ends[keep]


def _block_steps(window: int, block_us: int):
    """mapInArrow: rows sorted by (client, block, ts) -> one row of steps per (client, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        times: list[np.ndarray] = []
        done: list[tuple] = []

        def close() -> None:
            if key is not None:
                distinct = np.concatenate(times)
                latest, last = last_window_steps(distinct, key[1] * block_us, window)
                done.append((key[0], key[1], latest.tolist(), last.tolist()))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done))
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], pa.string()),
                    pa.array(columns[1], pa.int64()),
                    pa.array(columns[2], pa.list_(pa.int64())),
                    pa.array(columns[3], pa.list_(pa.int64())),
                ],
                ["_client", "_block", "latest", "last"],
            )
            done.clear()
            return batch

        for batch in batches:
            if batch.num_rows == 0:
                continue
            clients = batch.column("_client")
            blocks = batch.column("_block").to_numpy()
            ts = batch.column("_us").to_numpy()
            codes = clients.dictionary_encode().indices.fill_null(-1).to_numpy()
            new_group = (blocks[1:] != blocks[:-1]) | (codes[1:] != codes[:-1])
            changes = (np.flatnonzero(new_group) + 1).tolist()
            for a, b in zip([0, *changes], [*changes, batch.num_rows]):
                this = (clients[a].as_py(), int(blocks[a]))
                if this != key:
                    close()
                    key, times = this, []
                new = np.unique(ts[a:b])
                if times and new[0] == times[-1][-1]:
                    new = new[1:]
                if len(new):
                    times.append(new)
            if len(done) >= 1000:
                yield flush()
        close()
        if done:
            yield flush()

    return run


def composed(steps: list[tuple[np.ndarray, np.ndarray]], window: int) -> tuple[np.ndarray, np.ndarray]:
    """One step function for consecutive blocks.

    An opening time that none of the first block's requests reach is before all of the second's, so
    what the first block tells apart, and one case more, is all there is to tell apart.
    """
    latest, last = steps[0]
    if len(steps) > 1:
        latest, last = np.append(latest, steps[1][0][0]), np.append(last, steps[1][1][0])
        for k, (times, ends) in enumerate(steps[1:], 1):
            at = np.searchsorted(times, last + window)
            moves = at < len(times)
            if k == 1:
                moves[-1] = False  # it is there already
            last = np.where(moves, ends[np.minimum(at, len(ends) - 1)], last)
    keep = np.append(last[1:] != last[:-1], True)
    return latest[keep], last[keep]


def _numbers(column: pa.Array, i: int) -> np.ndarray:
    return column[i].values.to_numpy()


def _group_steps(window: int):
    """mapInArrow: steps sorted by (client, group, block) -> the group's composed steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def closed() -> pa.RecordBatch:
            latest, last = composed(held, window)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([key[0]], pa.string()),
                    pa.array([key[1]], pa.int64()),
                    pa.array([latest.tolist()], pa.list_(pa.int64())),
                    pa.array([last.tolist()], pa.list_(pa.int64())),
                ],
                ["_client", "_group", "latest", "last"],
            )

        for batch in batches:
            keys = zip(batch.column("_client").to_pylist(), batch.column("_group").to_pylist(), strict=True)
            for i, this in enumerate(keys):
                if this != key:
                    if key is not None:
                        yield closed()
                    key, held = this, []
                held.append((_numbers(batch.column("latest"), i), _numbers(batch.column("last"), i)))
        if key is not None:
            yield closed()

    return run


def _openings(window: int, within: str | None, unit: str):
    """mapInArrow: steps in order -> when a new window may open in each block, or group of blocks.

    A running pass over the rows of a client, or of a group (``within``), which then starts from
    the opening that the group's rows carry.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        opening = 0
        for batch in batches:
            out = []
            clients = batch.column("_client").to_pylist()
            groups = batch.column(within).to_pylist() if within else [None] * batch.num_rows
            start = batch.column("_start").to_pylist() if within else [np.iinfo(np.int64).min] * batch.num_rows
            for i, this in enumerate(zip(clients, groups, strict=True)):
                if this != key:
                    key, opening = this, start[i]
                out.append(opening)
                latest = _numbers(batch.column("latest"), i)
                at = int(np.searchsorted(latest, opening))
                if at < len(latest):
                    opening = int(_numbers(batch.column("last"), i)[at]) + window
            yield pa.RecordBatch.from_arrays(
                [batch.column("_client"), batch.column(unit), pa.array(out, pa.int64())], ["_client", unit, "_opening"]
            )

    return run


def _markers(steps: DataFrame, window: int) -> DataFrame:
    """_client, _block, _opening for every block with requests."""
    group = F.floor(F.col("_block") / F.lit(BLOCKS_TOGETHER)).cast("bigint")
    dealt = steps.withColumn("_group", group).repartition("_client", "_group")
    groups = dealt.sortWithinPartitions("_client", "_group", "_block").mapInArrow(
        _group_steps(window), "_client string, _group bigint, latest array<bigint>, last array<bigint>"
    )
    starts = (
        groups.repartition("_client")
        .sortWithinPartitions("_client", "_group")
        .mapInArrow(_openings(window, None, "_group"), "_client string, _group bigint, _opening bigint")
        .withColumnRenamed("_opening", "_start")
    )
    return (
        dealt.join(starts, ["_client", "_group"])
        .sortWithinPartitions("_client", "_group", "_block")
        .mapInArrow(_openings(window, "_group", "_block"), "_client string, _block bigint, _opening bigint")
    )


class WindowCounter:
    """Budget of the current window of one client."""

    __slots__ = ("request_limit", "token_limit", "window", "start", "requests", "tokens")

    def __init__(self, request_limit: int, token_limit: int, window: int) -> None:
        self.request_limit, self.token_limit, self.window = request_limit, token_limit, window
        self.start: int | None = None
        self.requests = self.tokens = 0

    def open(self, ts: int, requests: int = 0, tokens: int = 0) -> None:
        self.start, self.requests, self.tokens = ts, requests, tokens

    def is_over(self, ts: int) -> bool:
        return self.start is None or ts >= self.start + self.window

    def admit(self, ts: int, tokens: int) -> tuple:
        """(allowed, requests, tokens, reset_seconds, exceeded); denied requests add nothing."""
        reset = (self.start + self.window - ts) // 1_000_000
        if 0 < self.request_limit <= self.requests:
            return False, self.requests, self.tokens, reset, "requests"
        if 0 < self.token_limit < self.tokens + tokens:
            return False, self.requests, self.tokens, reset, "tokens"
        self.requests += 1
        self.tokens += tokens
        return True, self.requests, self.tokens, reset, None


def decisions_array(rows: list[tuple], request_limit: int, token_limit: int) -> pa.StructArray:
    """Decisions as an Arrow struct column of type ``RESULT``."""
    allowed, requests, tokens, reset, exceeded = zip(*rows) if rows else ((), (), (), (), ())
    n = len(rows)
    return pa.StructArray.from_arrays(
        [
            pa.array(allowed, pa.bool_()),
            pa.array(requests, pa.int64()),
            pa.array([request_limit] * n, pa.int64()),
            pa.array(tokens, pa.int64()),
            pa.array([token_limit] * n, pa.int64()),
            pa.array(reset, pa.int64()),
            pa.array(exceeded, pa.string()),
        ],
        RESULT.names,
    )


def _count_windows(request_limit: int, token_limit: int, window: int, keep: list[str]):
    """mapInArrow: rows sorted by (client, block, marker first, ts, carried first, id) -> decided rows.

    Holds one window's counters at a time, whatever the size of a group.  A carried row opens the
    window of a run before with what that has admitted, and does not come out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = WindowCounter(request_limit, token_limit, window)
        key: tuple | None = None
        opening: int | None = None  # None: no window can open in this group
        for batch in batches:
            clients = batch.column("_client").to_pylist()
            blocks = batch.column("_block").to_pylist()
            openings = batch.column("_opening").to_pylist()
            times = batch.column("_us").to_pylist()
            tokens = batch.column("_tokens").to_pylist()
            tails = batch.column("_tail").to_pylist()
            carried = batch.column("_carried").to_pylist()
            taken: list[int] = []
            rows: list[tuple] = []
            opened: list[int] = []
            for i, ts in enumerate(times):
                if blocks[i] != (key and key[1]) or clients[i] != key[0]:
                    key, opening = (clients[i], blocks[i]), None
                    counter.start = None
                if openings[i] is not None:
                    opening = openings[i]
                elif opening is not None and ts >= opening:
                    if carried[i] is not None:
                        if not tails[i]:
                            counter.open(ts, carried[i], tokens[i])
                        continue
                    if counter.is_over(ts):
                        if tails[i]:
                            opening = None  # the rest belongs to the next block
                            continue
                        counter.open(ts)
                    taken.append(i)
                    rows.append(counter.admit(ts, tokens[i]))
                    opened.append(counter.start)
            kept = batch.select(keep).take(pa.array(taken, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, decisions_array(rows, request_limit, token_limit), pa.array(opened, pa.int64())],
                [*keep, "rate", "_window"],
            )

    return run


def rate_limit(
    requests: DataFrame,
    request_limit: int = 0,
    token_limit: int = 0,
    client: str = "client_ip",
    ts: str = "ts",
    tokens: str = "tokens",
    request_id: str = "request_id",
    window_seconds: int = WINDOW_SECONDS,
    block_windows: int = BLOCK_WINDOWS,
    state: DataFrame | None = None,
) -> DataFrame:
    """Add ``rate``, the limiter's decision, to every row (order: ``ts``, then ``request_id``).

    Requests without a client are one client; requests without a time count as at the epoch, in one
    window of their client.  All columns travel through one shuffle on (client, block).  The source is read up to four times,
    but once for two narrow columns only; pass a stored or checkpointed table when it is costly to
    recompute.  With both limits 0 everything is allowed and nothing is shuffled.

    ``state`` (see ``STATE``) holds the windows that were open when these requests began.  A request
    from before its client's carried window counts as at the opening of that window.
    """
    if request_limit <= 0 and token_limit <= 0:
        zero = F.lit(0).cast("bigint")
        return requests.withColumn(
            "rate",
            F.struct(
                F.lit(True).alias("allowed"),
                *[zero.alias(n) for n in RESULT.names[1:6]],
                F.lit(None).cast("string").alias("exceeded"),
            ),
        )
    decided = limited(
        requests, state, request_limit, token_limit, client, ts, tokens, request_id, window_seconds, block_windows
    )
    return decided.drop("_window")


def _client_key(client: Column) -> Column:
    """Never null, so that it can be joined on."""
    return F.coalesce(F.concat(F.lit("c"), client.cast("string")), F.lit("none"))


def limited(
    requests: DataFrame,
    state: DataFrame | None,
    request_limit: int,
    token_limit: int,
    client: str,
    ts: str,
    tokens: str,
    request_id: str,
    window_seconds: int,
    block_windows: int,
) -> DataFrame:
    """``requests`` with ``rate`` and ``_window``, the microsecond at which the window of each was opened."""
    window = window_seconds * 1_000_000
    block_us = window * block_windows
    us = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(0).cast("bigint"))
    block = F.expr(f"(_us - pmod(_us, {block_us}L)) div {block_us}L")
    timed = requests.withColumns({"_client": _client_key(F.col(client)), "_us": us})
    carried = None
    if state is not None:
        carried = state.select(
            _client_key(F.col("client")).alias("_client"),
            F.unix_micros("opened").alias("_us"),
            F.col("requests").alias("_carried"),
            F.col("tokens").alias("_tokens"),
        ).withColumn("_block", block)
        opened = carried.select(
            "_client",
            F.col("_us").alias("_opened"),
            F.col("_carried").alias("_had"),
            F.col("_tokens").alias("_had_tokens"),
        )
        timed = timed.join(opened, "_client", "left").withColumn("_us", F.greatest("_us", "_opened"))

    slim = timed.select("_client", "_us").withColumn("_block", block)
    if carried is not None:
        slim = slim.unionByName(carried.select("_client", "_us", "_block"))
    steps = (
        slim.repartition("_client", "_block")
        .sortWithinPartitions("_client", "_block", "_us")
        .mapInArrow(
            _block_steps(window, block_us),
            "_client string, _block bigint, latest array<bigint>, last array<bigint>",
        )
    )
    markers = _markers(steps, window)

    keep = requests.columns
    own = timed.withColumn("_own", block)
    near_start = F.col("_us") - F.col("_own") * F.lit(block_us) < window
    blocks = F.when(near_start, F.array(F.col("_own"), F.col("_own") - 1)).otherwise(F.array("_own"))
    before = ["_opened", "_had", "_had_tokens"] if carried is not None else []
    rows = own.withColumn("_block", F.explode(blocks)).select(
        *keep,
        "_client",
        "_us",
        "_block",
        (F.col("_block") != F.col("_own")).alias("_tail"),
        F.coalesce(F.col(tokens).cast("bigint"), F.lit(0)).alias("_tokens"),
        F.col(request_id).alias("_id"),
        *before,
    )
    if token_limit <= 0:
        return _ranked(rows, _block_openings(slim, markers, window), request_limit, token_limit, window, keep)
    rows = rows.drop(*before).withColumns(
        {"_opening": F.lit(None).cast("bigint"), "_carried": F.lit(None).cast("bigint")}
    )
    if carried is not None:
        rows = rows.unionByName(carried.withColumn("_tail", F.lit(False)), allowMissingColumns=True)
    decided = (
        rows.unionByName(markers, allowMissingColumns=True)
        .repartition("_client", "_block")
        .sortWithinPartitions(
            "_client", "_block", F.col("_opening").desc_nulls_last(), "_us", F.col("_carried").isNull(), "_id"
        )
    )
    schema = T.StructType(
        [*requests.schema.fields, T.StructField("rate", RESULT), T.StructField("_window", T.LongType())]
    )
    return decided.mapInArrow(_count_windows(request_limit, token_limit, window, keep), schema)


def _block_openings(times: DataFrame, markers: DataFrame, window: int) -> DataFrame:
    """_client, _block and ``_starts``, when the windows that open in the block do: one per window length."""
    sets = (
        times.unionByName(markers, allowMissingColumns=True)
        .repartition("_client", "_block")
        .sortWithinPartitions("_client", "_block", F.col("_opening").desc_nulls_last(), "_us")
    )
    return sets.mapInArrow(_window_starts(window), "_client string, _block bigint, _starts array<bigint>")


def _window_starts(window: int):
    """mapInArrow: rows sorted by (client, block, marker first, time) -> the openings in each block.

    A step goes to the next opening, not to the next request.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        opening = 0
        starts: list[int] = []
        for batch in batches:
            done: list[tuple] = []
            clients, blocks = batch.column("_client"), batch.column("_block").to_numpy()
            codes = clients.dictionary_encode().indices.to_numpy()
            new_group = (blocks[1:] != blocks[:-1]) | (codes[1:] != codes[:-1])
            changes = (np.flatnonzero(new_group) + 1).tolist()
            times = batch.column("_us").fill_null(0).to_numpy()
            for a, b in zip([0, *changes], [*changes, batch.num_rows]):
                if a == b:
                    continue
                this = (clients[a].as_py(), int(blocks[a]))
                if this != key:
                    if starts:
                        done.append((*key, starts))
                    key, starts = this, []
                    # The first row of a block is its marker.
                    opening = batch.column("_opening")[a].as_py()
                    a += 1
                at = a + int(np.searchsorted(times[a:b], opening))
                while at < b:
                    starts.append(int(times[at]))
                    opening = starts[-1] + window
                    at += int(np.searchsorted(times[at:b], opening))
            if done:
                yield _starts_batch(done)
        if starts:
            yield _starts_batch([(*key, starts)])

    return run


def _starts_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()))
    columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(columns, ["_client", "_block", "_starts"])


def _ranked(
    rows: DataFrame, openings: DataFrame, request_limit: int, token_limit: int, window: int, keep: list[str]
) -> DataFrame:
    """Decisions by rank within each window, which is all that a limit on requests alone asks for.

    Of the two blocks that a request near the start of one goes to, one has its window.  The
    windows of a block lie where its rows were joined, so ranking moves nothing again.
    """
    start = F.array_max(F.filter("_starts", lambda x: x <= F.col("_us")))
    placed = rows.join(openings, ["_client", "_block"]).withColumn("_window", start)
    placed = placed.where(F.col("_us") < F.col("_window") + window)
    had, had_tokens = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    if "_had" in rows.columns:
        in_carried = F.col("_window") == F.col("_opened")
        had = F.coalesce(F.when(in_carried, F.col("_had")), had)
        had_tokens = F.coalesce(F.when(in_carried, F.col("_had_tokens")), had_tokens)
    order = Window.partitionBy("_client", "_block", "_window").orderBy("_us", "_id")
    ranked = placed.withColumn("_rank", had + F.row_number().over(order))
    allowed = F.col("_rank") <= request_limit
    taken = F.sum(F.when(allowed, F.col("_tokens"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rate = F.struct(
        allowed.alias("allowed"),
        F.when(allowed, F.col("_rank")).otherwise(F.greatest(had, F.lit(request_limit))).alias("request_count"),
        F.lit(request_limit).alias("request_limit"),
        (had_tokens + F.coalesce(taken, F.lit(0))).alias("token_count"),
        F.lit(token_limit).alias("token_limit"),
        F.expr(f"(_window + {window}L - _us) div 1000000").alias("reset_seconds"),
        F.when(~allowed, "requests").alias("exceeded"),
    )
    return ranked.withColumn("rate", rate.cast(RESULT)).select(*keep, "rate", "_window")


def rate_limit_run(
    requests: DataFrame,
    state: DataFrame | None = None,
    request_limit: int = 0,
    token_limit: int = 0,
    client: str = "client_ip",
    ts: str = "ts",
    tokens: str = "tokens",
    request_id: str = "request_id",
    window_seconds: int = WINDOW_SECONDS,
    block_windows: int = BLOCK_WINDOWS,
) -> tuple[DataFrame, DataFrame]:
    """One run of a log that arrives in runs: its decisions, and the state for the next run.

    Runs that follow one another in time are judged as their union would be; all requests of one
    time belong to one run.  ``state`` is what the run before handed on (none: no window is open).
    A client that sent nothing keeps its window; ``open_windows`` drops those that are over.  Both
    results are read from tables written here, once each.  With both limits 0 no window is kept.
    """
    session = requests.sparkSession
    if request_limit <= 0 and token_limit <= 0:
        return rate_limit(requests), state if state is not None else session.createDataFrame([], STATE)
    names = (client, ts, tokens, request_id, window_seconds, block_windows)
    decided = stored(limited(requests, state, request_limit, token_limit, *names))
    return decided.drop("_window"), stored(last_windows(decided, state, client, F.timestamp_micros("_window")))


def last_windows(decided: DataFrame, state: DataFrame | None, client: str, opened: Column) -> DataFrame:
    """``STATE`` after a run: the last window of each client among its decisions and the state before."""
    windows = decided.select(
        F.col(client).cast("string").alias("client"),
        opened.alias("opened"),
        F.col("rate.request_count").alias("requests"),
        F.col("rate.token_count").alias("tokens"),
    )
    if state is not None:
        windows = windows.unionByName(state.select(*STATE.names))
    # Within a window both counts only grow, so the greatest row is the last one.
    last = windows.groupBy("client").agg(F.max(F.struct("opened", "requests", "tokens")).alias("w"))
    return last.select("client", "w.*")


def open_windows(state: DataFrame, now: Column, window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """``state`` without the windows that are over by ``now``; requests before then must all be judged."""
    return state.where(F.unix_micros("opened") + window_seconds * 1_000_000 > F.unix_micros(now))


def denials_per_client(decided: DataFrame, client: str = "client_ip") -> DataFrame:
    """Requests and denials by client and exceeded limit."""
    return decided.groupBy(client).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("rate.exceeded") == "requests").alias("denied_requests"),
        F.count_if(F.col("rate.exceeded") == "tokens").alias("denied_tokens"),
    )
