"""The block-wise limiter against a plain sequential one."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reqguard.operators import ratelimit as R


def plain(rows, request_limit, token_limit, window):
    state, out = {}, {}
    for client, t, rid, tokens in sorted(rows, key=lambda r: (r[1], r[2])):
        entry = state.get(client)
        if entry is None or t - entry[0] >= window:
            entry = state[client] = [t, 0, 0]
        reset = (entry[0] + window - t) // 10**6
        if request_limit and entry[1] >= request_limit:
            out[rid] = (False, entry[1], entry[2], reset, "requests")
        elif token_limit and entry[2] + tokens > token_limit:
            out[rid] = (False, entry[1], entry[2], reset, "tokens")
        else:
            entry[1] += 1
            entry[2] += tokens
            out[rid] = (True, entry[1], entry[2], reset, None)
    return out


def limited(spark, rows, request_limit, token_limit, window_seconds=60, **kwargs):
    df = spark.createDataFrame(rows, "client_ip string, us long, request_id string, tokens int")
    df = df.withColumn("ts", F.timestamp_micros("us")).repartition(5)
    out = R.rate_limit(df, request_limit, token_limit, window_seconds=window_seconds, **kwargs)
    rows = out.collect()
    got = {
        r.request_id: (r.rate.allowed, r.rate.request_count, r.rate.token_count, r.rate.reset_seconds, r.rate.exceeded)
        for r in rows
    }
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("block_windows, step_seconds, together", [(1, 20, 3), (2, 3, 2), (64, 20, 256), (3, 200, 5)])
def test_random_arrivals(spark, monkeypatch, block_windows, step_seconds, together):
    monkeypatch.setattr(R, "BLOCKS_TOGETHER", together)
    rng = random.Random(block_windows)
    rows = []
    for c in range(4):
        t = rng.randrange(-(10**9), 10**9)
        # One client sends as much as all others together.
        for j in range(3000 if c == 1 else 1000):
            t += rng.choice([0, 0, rng.randrange(step_seconds * 10**6)])
            rows.append((f"c{c}" if c else None, t, f"r{c}-{j:05d}", rng.randrange(60)))
    for limits in ((4, 0), (0, 100), (4, 100)):
        assert limited(spark, rows, *limits, block_windows=block_windows) == plain(rows, *limits, 60 * 10**6)


CASES = {
    "requests": (3, 0, [(0, 1)] * 4, [(True, 1), (True, 2), (True, 3), (False, 3)]),
    "tokens": (0, 1000, [(0, 500), (0, 400), (0, 200)], [(True, 1), (True, 2), (False, 2)]),
    "both": (10, 500, [(0, 100)] * 3 + [(0, 300)], [(True, 1), (True, 2), (True, 3), (False, 3)]),
    "greedy": (0, 100, [(0, 50), (10, 60), (20, 40), (60, 100)], [(True, 1), (False, 1), (True, 2), (True, 1)]),
    "reset": (2, 0, [(0, 1), (0, 1), (0, 1), (61, 1)], [(True, 1), (True, 2), (False, 2), (True, 1)]),
    "denied anchors": (1, 0, [(0, 1), (30, 1), (60, 1), (119, 1), (120, 1)],
                       [(True, 1), (False, 1), (True, 1), (False, 1), (True, 1)]),
}


@pytest.mark.parametrize("name", CASES)
def test_documented_sequences(spark, name):
    request_limit, token_limit, events, want = CASES[name]
    rows = [("c", t * 10**6, f"r{i}", n) for i, (t, n) in enumerate(events)]
    got = limited(spark, rows, request_limit, token_limit)
    assert [got[f"r{i}"][:2] for i in range(len(rows))] == want


def test_clients_are_independent_and_off_means_off(spark):
    rows = [("a", 0, "1", 1), ("a", 0, "2", 1), ("a", 0, "3", 1), ("b", 0, "4", 1)]
    got = limited(spark, rows, 2, 0)
    assert [got[k][0] for k in "1234"] == [True, True, False, True]
    assert set(limited(spark, rows, 0, 0).values()) == {(True, 0, 0, 0, None)}
    df = spark.createDataFrame(rows, "client_ip string, us long, request_id string, tokens int")
    df = df.withColumn("ts", F.timestamp_micros("us"))
    denied = {r.client_ip: r.denied_requests for r in R.denials_per_client(R.rate_limit(df, 2, 0)).collect()}
    assert denied == {"a": 1, "b": 0}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=60), st.integers(1, 40), st.integers(1, 4))
def test_last_window_steps(times, window, windows_per_block):
    """For every permitted opening time, the steps name the start of the block's last window."""
    block = window * windows_per_block
    inside = np.unique([t % block for t in times]).astype(np.int64)
    latest, last = R.last_window_steps(inside, 0, window)
    for opening in range(-1, window):
        start = None
        for t in inside:
            if t >= opening if start is None else t >= start + window:
                start = int(t)
        at = int(np.searchsorted(latest, opening))
        assert (int(last[at]) if at < len(latest) else None) == start


def test_one_client_with_all_requests(spark, monkeypatch):
    """Composed step functions stay as short as those of a block, however many blocks there are."""
    rng = random.Random(9)
    times = np.cumsum([rng.randrange(3) for _ in range(60_000)]) * 100_000
    window, width = 60 * 10**6, 2 * 60 * 10**6
    blocks = [np.unique(times[times // width == b]) for b in np.unique(times // width)]
    steps = [R.last_window_steps(x, int(x[0] // width * width), window) for x in blocks]
    latest, last = R.composed(steps, window)
    assert len(latest) <= len(steps[0][0]) + 1
    for opening in [*range(0, window, 777_777), -(10**18)]:
        want, at = opening, None
        for times_, ends in steps:
            k = int(np.searchsorted(times_, want))
            if k < len(times_):
                at = int(ends[k])
                want = at + window
        assert int(last[np.searchsorted(latest, opening)]) == at
    monkeypatch.setattr(R, "BLOCKS_TOGETHER", 4)
    rows = [("only", int(t), f"r{i:05d}", 1) for i, t in enumerate(times[:20_000].tolist())]
    assert limited(spark, rows, 50, 0, block_windows=2) == plain(rows, 50, 0, window)


def in_runs(spark, rows, cuts, request_limit, token_limit, window_seconds=60, **kwargs):
    """Decisions of a log that is judged run by run, and the state after the last."""
    got, state = {}, None
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        part = [r for r in rows if (lo is None or r[1] >= lo) and (hi is None or r[1] < hi)]
        df = spark.createDataFrame(part, "client_ip string, us long, request_id string, tokens int")
        df = df.withColumn("ts", F.timestamp_micros("us")).repartition(3)
        out, state = R.rate_limit_run(df, state, request_limit, token_limit, window_seconds=window_seconds, **kwargs)
        assert out.columns == [*df.columns, "rate"] and state.schema.names == R.STATE.names
        for r in out.collect():
            assert r.request_id not in got
            rate = r.rate
            got[r.request_id] = (rate.allowed, rate.request_count, rate.token_count, rate.reset_seconds, rate.exceeded)
    return got, state


@pytest.mark.parametrize("block_windows, step_seconds, limits", [(1, 20, (4, 0)), (2, 7, (0, 100)), (16, 90, (3, 90))])
def test_runs_are_judged_as_one_log(spark, block_windows, step_seconds, limits):
    rng = random.Random(step_seconds)
    rows = []
    for c in range(5):
        t = rng.randrange(10**9)
        for j in range(700 if c == 1 else 150):
            t += rng.choice([0, 0, rng.randrange(step_seconds * 10**6)])
            rows.append((f"c{c}" if c else None, t, f"r{c}-{j:05d}", rng.randrange(60)))
    # One client is silent in the middle, another comes late.
    times = sorted({r[1] for r in rows})
    cuts = [times[len(times) * k // 5] for k in (1, 2, 3, 4)]
    rows = [r for r in rows if not (r[0] == "c3" and cuts[0] <= r[1] < cuts[2]) and not (r[0] == "c4" and r[1] < cuts[1])]
    got, state = in_runs(spark, rows, cuts, *limits, block_windows=block_windows)
    want = plain(rows, *limits, 60 * 10**6)
    assert got == want
    last = {}
    for client, us, rid, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        last[client] = want[rid][1:3]
    assert {r.client: (r.requests, r.tokens) for r in state.collect()} == last


def test_carried_windows_by_cases(spark):
    rows = [("a", 0, "1", 5), ("a", 50 * 10**6, "2", 5), ("b", 59 * 10**6, "3", 5)]
    later = [("a", 59 * 10**6, "4", 5), ("a", 60 * 10**6, "5", 5), ("b", 100 * 10**6, "6", 5)]
    got, state = in_runs(spark, rows + later, [59 * 10**6], 2, 0)
    assert [got[k][0] for k in "123456"] == [True, True, True, False, True, True]
    assert [got[k][1] for k in "456"] == [2, 1, 2]
    over = R.open_windows(state, F.timestamp_seconds(F.lit(119)))
    assert {r.client for r in over.collect()} == {"a"}
    # A request that comes after its time counts within the carried window.
    df = spark.createDataFrame([("a", 10 * 10**6, "7", 1)], "client_ip string, us long, request_id string, tokens int")
    out, after = R.rate_limit_run(df.withColumn("ts", F.timestamp_micros("us")), state, 2, 0)
    rate = out.first().rate
    assert (rate.allowed, rate.request_count, rate.reset_seconds) == (True, 2, 60)
    assert {r.client: r.requests for r in after.collect()} == {"a": 2, "b": 2}


def test_runs_without_rows_or_limits(spark):
    empty = spark.createDataFrame([], "client_ip string, ts timestamp, request_id string, tokens int")
    out, state = R.rate_limit_run(empty, None, 2, 0)
    assert out.count() == state.count() == 0
    given = spark.createDataFrame([(None, 1, 2)], "client string, requests bigint, tokens bigint")
    given = given.withColumn("opened", F.timestamp_seconds(F.lit(5))).select(*R.STATE.names)
    out, state = R.rate_limit_run(empty, given, 2, 0)
    assert out.count() == 0 and [tuple(r)[2:] for r in state.collect()] == [(1, 2)]
    assert R.rate_limit_run(empty, given)[1] is given


def test_columns_of_any_name_stay(spark):
    rows = [("a", 0, "1", 1, "s", "o"), ("a", 0, "2", 1, "s", "o"), ("a", 61 * 10**6, "3", 1, "s", "o")]
    df = spark.createDataFrame(rows, "client_ip string, us long, request_id string, tokens int, starts string, opened string")
    df = df.withColumn("ts", F.timestamp_micros("us"))
    for limits in ((1, 0), (1, 5)):
        out, _ = R.rate_limit_run(df, None, *limits)
        assert out.columns == [*df.columns, "rate"]
        got = {r.request_id: (r.rate.allowed, r.starts, r.opened) for r in out.collect()}
        assert got == {"1": (True, "s", "o"), "2": (False, "s", "o"), "3": (True, "s", "o")}
