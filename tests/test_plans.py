"""What the physical plans must look like."""

from pyspark.sql import functions as F

import __spark_entry__ as contract
from reqguard.config import PolicyConfig
from reqguard.operators import normalize as N
from reqguard.operators import ratelimit as R
from reqguard.operators import scan as S
from reqguard.operators import usage as U
from reqguard.plans.policy import evaluate_policy
from reqguard.sources.logs import CHUNK_SCHEMA, HEADER_SCHEMA, read_chunks, read_headers, write_verdicts
from reqguard.sources import corpus

from conftest import SF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stored_log(spark, tmp_path):
    path = str(tmp_path / "log")
    corpus.request_log(spark, SF).write.parquet(path)
    return spark.read.parquet(path)


def test_policy_without_limits_never_shuffles(spark, tmp_path):
    config = PolicyConfig(schema_validation_enabled=True, allowed_models=("gpt-4",), max_tokens_per_request=10)
    text = plan(evaluate_policy(stored_log(spark, tmp_path), config))
    assert "Exchange" not in text
    # The scan; parsing takes none.
    assert text.count("ArrowEvalPython") == 1


def test_filters_reach_the_scan_and_do_not_parse_twice(spark, tmp_path):
    log = stored_log(spark, tmp_path)
    parsed = N.normalize_requests(log).where(F.col("req").isNotNull() & (F.col("client_ip") == "203.0.113.1"))
    text = plan(parsed)
    assert "EqualTo(client_ip,203.0.113.1)" in text
    parse = "from_json("
    once = plan(N.normalize_requests(log)).count(parse)
    assert text.count(parse) == once > 0


def test_usage_report_combines_before_its_only_shuffle(spark, tmp_path):
    text = plan(U.usage_report(N.normalize_requests(stored_log(spark, tmp_path))))
    assert text.count("Exchange") == 1 and "partial_sum" in text


def test_scan_reads_only_its_columns(spark):
    # A table that another test has cached would be read from there, with all of its columns.
    spark.catalog.clearCache()
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    text = plan(S.with_flags(documents).select("doc_id", "injection"))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text and "Exchange" not in text


def test_limiter_bodies_stay_out_of_the_shuffle(spark, tmp_path):
    verdicts = evaluate_policy(stored_log(spark, tmp_path), PolicyConfig(rate_limit_requests=3))
    text = plan(verdicts)
    assert "body#" not in text.replace("block_body#", "") and "CartesianProduct" not in text


def test_a_limit_on_requests_alone_is_a_rank(spark, tmp_path):
    usage = stored_log(spark, tmp_path).select("request_id", "client_ip", "ts", F.lit(1).alias("tokens"))
    after = plan(R.rate_limit(usage, 4, 0))
    # No request goes through Python: what does, has times and step functions alone.
    python = [line for line in after.splitlines() if "MapInArrow" in line]
    assert "row_number()" in after and python and not any("rate#" in line or "request_id#" in line for line in python)
    both = [line for line in plan(R.rate_limit(usage, 4, 9)).splitlines() if "MapInArrow" in line]
    assert any("rate#" in line for line in both)


def test_no_query_has_a_cross_join(spark):
    for name, query in contract.queries().items():
        if name.startswith(("rate_", "flags_", "assemble", "in_flight", "metrics_per")):
            text = plan(query(spark, SF))
            assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_sources_and_sink(spark, tmp_path):
    headers, chunks = str(tmp_path / "h"), str(tmp_path / "c")
    spark.createDataFrame([], HEADER_SCHEMA).write.json(headers)
    spark.createDataFrame([("a", "aGk=", True, 2, 0, 2, 1)], CHUNK_SCHEMA).write.parquet(chunks)
    assert read_headers(spark, headers, "json").schema == HEADER_SCHEMA
    assert read_chunks(spark, chunks).count() == 1
    out = str(tmp_path / "v")
    verdicts = evaluate_policy(corpus.request_log(spark, SF))
    write_verdicts(verdicts, out)
    assert spark.read.parquet(out).count() == verdicts.count()
