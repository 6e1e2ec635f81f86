"""Body assembly against a plain state machine."""

import base64
import random

import pytest
from pyspark.sql import functions as F

from reqguard.functions.encoding import decode_base64_strict
from reqguard.operators import assemble as A


def canonical(data):
    try:
        raw = base64.b64decode(data, validate=True)
    except ValueError:
        return None
    return raw if base64.b64encode(raw).decode() == data else None


def plain(events):
    state, done = {}, {}
    for seq, rid, kind, value, last in sorted(events):
        if kind == "h":
            state[rid] = [seq, value, b""]
        elif rid in state:
            state[rid][2] += canonical(value) or b""
            if last:
                opened, uri, body = state.pop(rid)
                done[(rid, opened)] = (uri, body)
    return done, {(rid, s[0]) for rid, s in state.items()}


def random_events(seed, n_events=4000):
    rng = random.Random(seed)
    events, seq = [], -500
    for n in range(n_events):
        seq += rng.choice([1, 1, 1, 2, 9])
        rid = f"id{int(rng.random() ** 3 * 40)}"  # the first ids hold most events
        if rng.random() < 0.25:
            events.append((seq, rid, "h", f"u{n}", False))
        else:
            piece = rng.choice([b"abc", b"\xc3", b"\xa9", b"x" * 200, b""])
            data = rng.choice([base64.b64encode(piece).decode()] * 9 + ["aGk"])
            events.append((seq, rid, "c", data, rng.random() < 0.3))
    return events


def tables(spark, events):
    headers = spark.createDataFrame(
        [(i, v, s) for s, i, k, v, _ in events if k == "h"], "correlation_id string, uri string, seq bigint"
    )
    chunks = spark.createDataFrame(
        [(i, v, last, s) for s, i, k, v, last in events if k == "c"],
        "correlation_id string, data string, is_last boolean, seq bigint",
    )
    return headers, chunks


@pytest.mark.parametrize("block_size", [3, 50, A.BLOCK_SIZE])
def test_random_events(spark, block_size):
    events = random_events(block_size)
    headers, chunks = tables(spark, events)
    done, open_ = plain(events)
    rows = A.assemble_requests(headers, chunks, block_size=block_size).withColumn("body", F.col("body").cast("binary"))
    assert {(r.correlation_id, r.opened_seq): (r.uri, bytes(r.body)) for r in rows.collect()} == done
    flying = A.in_flight(headers, chunks, block_size=block_size)
    assert {(r.correlation_id, r.opened_seq) for r in flying.collect()} == open_


def test_chunk_index_order_and_encoding(spark):
    headers = spark.createDataFrame([("a", "/x"), ("b", "/y"), ("c", "/z")], "correlation_id string, uri string")
    text = "é" * 300
    raw = text.encode()
    chunks = [("a", base64.b64encode(raw[301:]).decode(), True, 1), ("a", base64.b64encode(raw[:301]).decode(), False, 0)]
    chunks += [("b", "/w==", True, 0), ("orphan", "aGk=", True, 0), ("c", "!", True, 0)]
    df = spark.createDataFrame(chunks, "correlation_id string, data string, is_last boolean, chunk_index int")
    rows = {r.correlation_id: r for r in A.assemble_requests(headers, df, seq=None).withColumn("n", F.octet_length("body")).collect()}
    assert rows["a"].body == text and rows["a"].body_is_utf8
    assert not rows["b"].body_is_utf8 and rows["b"].n == 1
    assert rows["c"].body == "" and "orphan" not in rows


def test_strict_base64(spark):
    good = [base64.b64encode(b"x" * n).decode() for n in (0, 1, 2, 3, 57, 58, 1000)]
    bad = ["aGk", "aG k=", "aGl=", "aGk=\n", "====", "a", "aGk=aGk=", "é"]
    df = spark.createDataFrame([(s,) for s in good + bad] + [(None,)], "s string")
    got = {r.s: r.b for r in df.select("s", decode_base64_strict(F.col("s")).alias("b")).collect()}
    assert [s for s in good if got[s] is None or bytes(got[s]) != base64.b64decode(s)] == []
    assert [s for s in bad if got[s] is not None] == [] and got[None] is None


@pytest.mark.parametrize("block_size, n_runs", [(3, 4), (A.BLOCK_SIZE, 3)])
def test_any_cut_into_runs_gives_the_same_requests(spark, block_size, n_runs):
    events = random_events(17 + n_runs, 1200)
    rng = random.Random(n_runs)
    cuts = sorted(rng.sample(range(events[0][0], events[-1][0]), n_runs - 1))
    # One run has no event at all.
    runs = [[e for e in events if lo < e[0] <= hi] for lo, hi in zip([-(10**9), *cuts, cuts[-1]], [*cuts, cuts[-1], 10**9])]
    done, carried, seen = {}, None, []
    for run in runs:
        seen += run
        finished, carried = A.assemble_run(*tables(spark, run), carried, block_size=block_size)
        for r in finished.withColumn("body", F.col("body").cast("binary")).collect():
            assert (r.correlation_id, r.opened_seq) not in done
            done[(r.correlation_id, r.opened_seq)] = (r.uri, bytes(r.body))
        whole, open_ = plain(seen)
        assert done == whole
        assert {(r.correlation_id, r.seq) for r in carried[0].collect()} == open_


def test_abandoned_requests_are_told_and_left_out(spark):
    headers = spark.createDataFrame([("a", "u", 1), ("b", "v", 2)], "correlation_id string, uri string, seq bigint")
    headers = headers.withColumn("timestamp", F.timestamp_seconds(F.col("seq") * 100))
    chunks = spark.createDataFrame(
        [("a", "YQ==", False, 3), ("b", "Yg==", None, 4)], "correlation_id string, data string, is_last boolean, seq bigint"
    )
    finished, carried = A.assemble_run(headers, chunks)
    gone, left = A.abandoned(carried, F.timestamp_seconds(F.lit(150)))
    assert finished.count() == 0 and [r.correlation_id for r in gone.collect()] == ["a"]
    later = spark.createDataFrame([("a", "YQ==", True, 5), ("b", "Yg==", True, 6)], chunks.schema)
    finished, carried = A.assemble_run(headers.limit(0), later, left)
    assert [(r.correlation_id, r.body) for r in finished.collect()] == [("b", "bb")]
    assert carried[0].count() == carried[1].count() == 0


def plain_fates(events):
    """Fate of every event by its place in the list."""
    fates, open_ = {}, {}
    for seq, rid, kind, value, last in sorted(events):
        if kind == "h":
            for s in open_.pop(rid, []):
                fates[s] = "reset"
            open_[rid] = [seq]
        elif rid not in open_:
            fates[seq] = "orphan"
        else:
            open_[rid].append(seq)
            if last:
                data = {s: v for s, _, k, v, _ in events if k == "c"}
                for s in open_.pop(rid):
                    fates[s] = "undecodable" if s in data and canonical(data[s]) is None else "finished"
    return fates | {s: "open" for held in open_.values() for s in held}


def test_every_event_has_a_fate(spark):
    events = random_events(5, 900)
    rows = A.event_fates(*tables(spark, events), block_size=7).collect()
    assert len(rows) == len(events)
    want = plain_fates(events)
    assert {r.seq: r.fate for r in rows} == want and set(want.values()) == {"finished", "undecodable", "open", "reset", "orphan"}
