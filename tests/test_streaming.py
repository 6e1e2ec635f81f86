"""Streams must give what the batch jobs give."""

import random

import pytest
from pyspark.sql import functions as F

from reqguard.config import PolicyConfig
from reqguard.operators.assemble import assemble_requests, in_flight
from reqguard.operators.metrics import traffic_metrics_per_minute
from reqguard.operators.ratelimit import rate_limit
from reqguard.plans.policy import evaluate_policy
from reqguard.sources import corpus
from reqguard.streaming.assemble import assemble_stream, body_events, header_fields
from reqguard.streaming.policy import (
    LateRows,
    accounted_writer,
    evaluate_policy_stream,
    metrics_stream,
    read_requests,
    request_writer,
    verdict_writer,
)
from reqguard.streaming.ratelimit import rate_limit_stream, rate_limit_writer

from conftest import SF


def replay(spark, df, path, order, batches):
    """Write a table as files in event order and stream it, one file per micro-batch."""
    ordered = df.orderBy(*order).toPandas()
    size = -(-len(ordered) // batches)
    for i in range(batches):
        part = spark.createDataFrame(ordered.iloc[i * size : (i + 1) * size], df.schema)
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(df, name):
    spark, late = df.sparkSession, LateRows()
    spark.streams.addListener(late)
    query = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    query.awaitTermination()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    spark.streams.removeListener(late)
    return spark.table(name), sum(late.dropped.values())


def rows(df, *cols):
    return sorted((tuple(map(str, r)) for r in df.select(*cols).collect()))


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    us = 1_704_067_200_000_000
    data = []
    for i in range(800):
        us += rng.randrange(4_000_000)
        data.append((f"r{i:04d}", f"c{int(rng.random() ** 2 * 5)}", us, rng.randrange(60)))
    table = spark.createDataFrame(data, "request_id string, client_ip string, us long, tokens long")
    table = table.select("request_id", "client_ip", F.timestamp_micros("us").alias("ts"), "tokens")
    stream = replay(spark, table, str(tmp_path / "in"), ["ts"], 4).withWatermark("ts", "10 minutes")
    got, dropped = run(rate_limit_stream(stream, 4, 100), "limited")
    cols = ["request_id", "rate.allowed", "rate.request_count", "rate.token_count", "rate.reset_seconds", "rate.exceeded"]
    want = rows(rate_limit(table, 4, 100), *cols)
    assert dropped == 0
    assert rows(got, *cols) == want
    assert {r[1] for r in want} == {"True", "False"}


def test_assemble_stream_equals_batch(spark, tmp_path):
    headers, chunks = corpus.body_events(spark, SF)
    times = headers.groupBy("correlation_id").agg(F.min("timestamp").alias("timestamp"))
    chunks = chunks.join(times, "correlation_id")
    head = replay(spark, headers, str(tmp_path / "h"), ["timestamp", "seq"], 1)
    tail = replay(spark, chunks, str(tmp_path / "c"), ["timestamp", "seq"], 1)
    events = body_events(head, tail, watermark="1 hour")
    got, _ = run(assemble_stream(events), "assembled")
    # The memory sink cannot hold bytes that are not UTF-8, so those bodies are compared by flag.
    digest = F.when(F.col("body_is_utf8"), F.md5("body"))
    cols = ["correlation_id", "opened_seq", "client_ip", "uri", digest, "body_is_utf8"]
    want = rows(assemble_requests(headers, chunks.drop("timestamp")), *cols)
    assert rows(got, *cols) == want and len(want) > 100


def test_assemble_stream_keeps_state_between_batches(spark, tmp_path):
    headers, chunks = corpus.body_events(spark, SF)
    chunks = chunks.withColumn("timestamp", F.timestamp_seconds(F.lit(corpus.BASE_EPOCH) + 3600))
    events = body_events(headers, chunks, watermark="3 hours").sort("seq")
    stream = replay(spark, events, str(tmp_path / "e"), ["seq"], 3).withWatermark("event_time", "3 hours")
    got, _ = run(assemble_stream(stream, ttl_seconds=86_400), "assembled_in_parts")
    cols = ["correlation_id", "opened_seq", F.when(F.col("body_is_utf8"), F.md5("body"))]
    assert rows(got, *cols) == rows(assemble_requests(headers, chunks.drop("timestamp")), *cols)


@pytest.mark.parametrize("limits", [(0, 0), (4, 3000)])
def test_policy_stream_equals_batch(spark, tmp_path, limits):
    config = PolicyConfig(rate_limit_requests=limits[0], rate_limit_tokens=limits[1], pii_action="block")
    log = corpus.request_log(spark, SF)
    stream = replay(spark, log, str(tmp_path / "log"), ["ts", "request_id"], 3).withWatermark("ts", "1 day")
    got, _ = run(evaluate_policy_stream(stream, config), f"verdicts_{limits[0]}")
    cols = ["request_id", "decision", "status", "block_reason", "request_headers", "response_headers", "tags", "reason_codes"]
    assert rows(got, *cols) == rows(evaluate_policy(log, config), *cols)


def test_metrics_stream_emits_closed_minutes(spark, tmp_path):
    log = corpus.request_log(spark, SF)
    verdicts = evaluate_policy(log)
    stream = replay(spark, log, str(tmp_path / "log"), ["ts"], 4).withWatermark("ts", "1 minute")
    got, _ = run(metrics_stream(evaluate_policy_stream(stream)), "minutes")
    want = {r["minute"]: r for r in traffic_metrics_per_minute(verdicts).collect()}
    seen = got.collect()
    assert 0 < len(seen) < len(want) + 1
    assert all(want[r["minute"]] == r for r in seen)


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    path = str(tmp_path / "late")
    schema = "request_id string, client_ip string, ts timestamp, tokens long"
    for batch in (["10:00:00", "10:30:00"], ["10:31:00"], ["10:00:30"]):
        data = [(t, "c") for t in batch]
        df = spark.createDataFrame(data, "t string, c string").select(
            F.col("t").alias("request_id"),
            F.col("c").alias("client_ip"),
            F.to_timestamp(F.concat(F.lit("2024-01-01 "), "t")).alias("ts"),
            F.lit(1).cast("bigint").alias("tokens"),
        )
        df.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got, dropped = run(rate_limit_stream(stream.withWatermark("ts", "1 minute"), 5), "late")
    assert dropped == 1
    assert {r.request_id for r in got.collect()} == {"10:00:00", "10:30:00", "10:31:00"}


def test_verdict_writer(spark, tmp_path):
    log = corpus.request_log(spark, SF)
    stream = replay(spark, log, str(tmp_path / "log"), ["ts"], 2)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    query = verdict_writer(evaluate_policy_stream(stream), out, checkpoint).start()
    query.processAllAvailable()
    query.stop()
    written = spark.read.parquet(out)
    assert written.count() == log.count() and "date" in written.columns


def test_assemble_stream_keeps_every_header_field(spark, tmp_path):
    headers, chunks = corpus.full_events(spark, SF)
    times = headers.groupBy("correlation_id").agg(F.min("timestamp").alias("timestamp"))
    chunks = chunks.join(times, "correlation_id")
    streams = []
    for name, events in (("h", headers), ("c", chunks)):
        events.write.parquet(str(tmp_path / name))
        streams.append(spark.readStream.schema(events.schema).parquet(str(tmp_path / name)))
    head, tail = streams
    got, _ = run(assemble_stream(body_events(head, tail, watermark="1 hour"), fields=header_fields(headers)), "full")
    cols = ["correlation_id", "opened_seq", "request_id", "client_port", "route_id", "headers", "server_name", "tls_cipher"]
    want = rows(assemble_requests(headers, chunks.drop("timestamp")), *cols)
    assert rows(got.where("finished"), *cols) == want and len(want) > 100


def test_unfinished_requests_get_a_row(spark, tmp_path):
    path = str(tmp_path / "events")
    schema = "correlation_id string, seq long, event_time timestamp, is_header boolean, is_last boolean, header string, bytes binary"
    header = '{"client_ip":"c","uri":"/u"}'
    batches = [
        [("a", 1, "10:00:00", True, False, header, None), ("a", 2, "10:00:01", False, False, None, b"half")],
        [("b", 1, "11:00:00", True, False, header, None), ("b", 2, "11:00:00", False, True, None, b"all")],
        [("b", 3, "12:00:00", False, False, None, b"stray")],
    ]
    for batch in batches:
        data = [(i, n, f"2024-01-01 {t}", h, last, head, b) for i, n, t, h, last, head, b in batch]
        df = spark.createDataFrame(data, schema.replace("event_time timestamp", "event_time string"))
        df.withColumn("event_time", F.to_timestamp("event_time")).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got, _ = run(assemble_stream(stream.withWatermark("event_time", "1 minute")), "unfinished")
    assert rows(got, "correlation_id", "body", "finished") == [("a", "half", "False"), ("b", "all", "True")]


def test_every_event_is_accounted_for(spark, tmp_path):
    """Events in are events of finished requests, events written aside with a reason, and open ones."""
    path = str(tmp_path / "events")
    schema = "correlation_id string, seq long, event_time timestamp, is_header boolean, is_last boolean, header string, bytes binary"
    header = '{"client_ip":"c","uri":"/u"}'
    batches = [
        [("a", 1, "10:00:00", True, False, header, None), ("a", 2, "10:00:01", False, False, None, b"cut off")],
        [("a", 3, "10:00:02", True, False, header, None), ("a", 4, "10:00:02", False, False, None, None),
         ("a", 5, "10:00:03", False, True, None, b"whole"), ("a", 6, "10:00:03", False, True, None, b"late piece"),
         ("b", 1, "10:00:03", False, False, None, b"stray"), ("c", 1, "10:00:03", True, False, header, None)],
        [("d", 1, "12:00:00", True, False, header, None), ("d", 2, "12:00:00", False, False, None, b"open")],
        [("e", 1, "12:00:01", False, False, None, b"stray")],
    ]
    for batch in batches:
        data = [(i, n, f"2024-01-01 {t}", h, last, head, b) for i, n, t, h, last, head, b in batch]
        df = spark.createDataFrame(data, schema.replace("event_time timestamp", "event_time string"))
        df.withColumn("event_time", F.to_timestamp("event_time")).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    assembled = assemble_stream(stream.withWatermark("event_time", "1 minute"), account=True)
    places = [str(tmp_path / name) for name in ("requests", "aside", "checkpoint")]
    query = accounted_writer(assembled, *places).trigger(availableNow=True).start()
    query.awaitTermination()
    finished, aside = (spark.read.parquet(p) for p in places[:2])
    assert rows(finished, "request_id", "body", "events") == [("a", "whole", "2")]
    assert rows(aside, "correlation_id", "opened_seq", "reason", "body", "events") == sorted([
        ("a", "1", "reset", "cut off", "2"), ("a", "4", "undecodable", "", "1"), ("a", "6", "orphan", "late piece", "1"),
        ("b", "1", "orphan", "stray", "1"), ("c", "1", "timeout", "", "1"), ("e", "1", "orphan", "stray", "1"),
    ])
    still_open = 2
    total = finished.unionByName(aside, allowMissingColumns=True).agg(F.sum("events")).first()[0]
    assert total + still_open == sum(map(len, batches))


def test_gauge_equals_batch_at_every_batch_end(spark, tmp_path):
    """Also when the stream is stopped and goes on; a request that times out is in flight no more."""
    rng = random.Random(4)
    events, size = [], 30
    for n in range(5 * size):
        is_header, key = rng.random() < 0.3, f"k{rng.randrange(12)}"
        events.append((key, n, is_header, not is_header and rng.random() < 0.4))
    schema = "correlation_id string, seq long, is_header boolean, is_last boolean"
    path = str(tmp_path / "events")

    def arrive(some, at):
        df = spark.createDataFrame(some, schema).withColumn("event_time", F.to_timestamp(F.lit(at)))
        df = df.withColumn("header", F.when(F.col("is_header"), F.lit('{"client_ip":"c","uri":"/u"}')))
        df = df.withColumn("bytes", F.when(~F.col("is_header"), F.lit(b"x")))
        df.coalesce(1).write.mode("append").parquet(path)
        return df.schema

    for k in range(5):
        written = arrive(events[k * size : (k + 1) * size], "2024-01-01 10:00:00")
    places = [str(tmp_path / name) for name in ("requests", "aside", "checkpoint", "gauge")]

    def go():
        stream = spark.readStream.schema(written).option("maxFilesPerTrigger", 1).parquet(path)
        assembled = assemble_stream(stream.withWatermark("event_time", "1 minute"), account=True)
        query = accounted_writer(assembled, *places).trigger(availableNow=True).start()
        query.awaitTermination()
        return {r.batch: r.in_flight_requests for r in spark.read.parquet(places[3]).collect()}

    gauge = go()
    seen = []
    for k in range(5):
        seen += events[k * size : (k + 1) * size]
        df = spark.createDataFrame(seen, schema)
        headers = df.where("is_header").select("correlation_id", "seq", F.lit("c").alias("client_ip"))
        chunks = df.where("not is_header").select("correlation_id", "seq", "is_last", F.lit("eA==").alias("data"))
        assert gauge[k] == in_flight(headers, chunks).count() > 0, k
    assert "opened" not in {r.reason for r in spark.read.parquet(places[1]).collect()}
    arrive([("z", 1000, True, False)], "2024-01-01 12:00:00")
    arrive([("z", 1001, False, True)], "2024-01-01 12:00:01")
    later = go()
    assert {k: later[k] for k in gauge} == gauge and later[max(later)] == 0


def test_chunks_to_rate_limited_verdicts_to_metrics(spark, tmp_path):
    """Three queries in a row give what the batch jobs give."""
    log = corpus.request_log(spark, SF)
    headers, chunks = corpus.chunked(log)
    chunks = chunks.join(headers.select("correlation_id", "timestamp"), "correlation_id")
    head = replay(spark, headers, str(tmp_path / "h"), ["timestamp"], 1)
    tail = replay(spark, chunks, str(tmp_path / "c"), ["timestamp", "seq"], 1)
    assembled = assemble_stream(body_events(head, tail, watermark="1 day"), ttl_seconds=86_400)

    def finish(writer):
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()

    requests, verdicts = str(tmp_path / "requests"), str(tmp_path / "verdicts")
    finish(request_writer(assembled, requests, str(tmp_path / "cp1")))
    config = PolicyConfig(rate_limit_requests=4, rate_limit_tokens=3000, pii_action="block")
    stream = read_requests(spark, requests, spark.read.parquet(requests).schema, "1 day")
    finish(verdict_writer(evaluate_policy_stream(stream, config), verdicts, str(tmp_path / "cp2")))
    want = evaluate_policy(log, config)
    cols = ["request_id", "decision", "status", "block_reason", "response_headers", "tags", "reason_codes"]
    written = spark.read.parquet(verdicts)
    assert rows(written, *cols) == rows(want, *cols)
    back = spark.readStream.schema(written.schema).parquet(verdicts)
    got, _ = run(metrics_stream(back, watermark="1 minute"), "chain_minutes")
    minutes = {r["minute"]: r for r in traffic_metrics_per_minute(want).collect()}
    seen = got.collect()
    assert seen and all(minutes[r["minute"]] == r for r in seen)


@pytest.mark.parametrize("limits", [(4, 0), (3, 100), (0, 0)])
def test_rate_limit_writer_equals_batch(spark, tmp_path, limits):
    """A hot client, clients without a name, a restart, and a last batch that is run twice."""
    rng = random.Random(sum(limits))
    us = 1_704_067_200_000_000
    data = []
    for i in range(900):
        us += rng.randrange(1, 6_000_000)
        client = "hot" if rng.random() < 0.7 else rng.choice(["a", "b", None])
        data.append((f"r{i:04d}", client, us, rng.randrange(60)))
    table = spark.createDataFrame(data, "request_id string, client_ip string, us long, tokens long")
    table = table.select("request_id", "client_ip", F.timestamp_micros("us").alias("ts"), "tokens")
    stream = replay(spark, table, str(tmp_path / "in"), ["ts"], 3)
    places = [str(tmp_path / name) for name in ("out", "state", "checkpoint")]

    def finish():
        writer = rate_limit_writer(stream, *places, *limits, block_windows=2)
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        finish()
        # As if the job had ended before it could say that the last batch was done.
        for name in ("2", ".2.crc"):
            (tmp_path / "checkpoint" / "commits" / name).unlink(missing_ok=True)
        finish()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    cols = ["request_id", "client_ip", "rate.allowed", "rate.request_count", "rate.token_count", "rate.reset_seconds", "rate.exceeded"]
    got = spark.read.parquet(places[0])
    assert rows(got, *cols) == rows(rate_limit(table, *limits), *cols)
    if any(limits):
        # One client's rows of a batch come from several tasks.
        files = got.where("client_ip = 'hot' and batch = 0").select(F.input_file_name()).distinct()
        assert files.count() > 1
        assert got.where("window_opened is null or window_opened > ts").count() == 0


def test_rate_limit_writer_drops_no_late_request_and_forgets_old_windows(spark, tmp_path):
    path = str(tmp_path / "late")
    schema = "request_id string, client_ip string, ts timestamp, tokens long"
    batches = [[("a", "10:00:00"), ("b", "10:00:05"), ("c", "10:00:05")], [("b", "12:00:00")], [("b", "11:59:58"), ("a", "12:00:10")], [("b", "12:00:20")]]
    for batch in batches:
        df = spark.createDataFrame(batch, "c string, t string").select(
            F.concat("c", "t").alias("request_id"),
            F.col("c").alias("client_ip"),
            F.to_timestamp(F.concat(F.lit("2024-01-01 "), "t")).alias("ts"),
            F.lit(None).cast("bigint").alias("tokens"),
        )
        df.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    places = [str(tmp_path / name) for name in ("out", "state", "checkpoint")]
    rate_limit_writer(stream, *places, 2, lateness_seconds=600).trigger(availableNow=True).start().awaitTermination()
    got = {r.request_id: (r.rate.allowed, r.rate.request_count) for r in spark.read.parquet(places[0]).collect()}
    assert got == {
        "a10:00:00": (True, 1), "b10:00:05": (True, 1), "c10:00:05": (True, 1), "b12:00:00": (True, 1),
        "b11:59:58": (True, 2), "a12:00:10": (True, 1), "b12:00:20": (False, 2),
    }
    kept = [{r.client for r in spark.read.parquet(f"{places[1]}/batch={n}").collect()} for n in range(4)]
    assert kept == [{"a", "b", "c"}, {"a", "b", "c"}, {"a", "b"}, {"a", "b"}]
    late = spark.read.parquet(f"{places[1]}/batch=2").where("client = 'a'").first()
    assert late.opened.strftime("%H:%M") == "12:00"
