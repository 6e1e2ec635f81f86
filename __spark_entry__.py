
from __future__ import annotations

import sys
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import oracles  # noqa: E402
from reqguard.config import PolicyConfig  # noqa: E402
from reqguard.functions import providers as PV  # noqa: E402
from reqguard.functions.estimate import cost_text  # noqa: E402
from reqguard.operators import allowlist as AL  # noqa: E402
from reqguard.operators import assemble as A  # noqa: E402
from reqguard.operators import metrics as M  # noqa: E402
from reqguard.operators import normalize as N  # noqa: E402
from reqguard.operators import ratelimit as R  # noqa: E402
from reqguard.operators import scan as S  # noqa: E402
from reqguard.operators import usage as U  # noqa: E402
from reqguard.operators import validate as V  # noqa: E402
from reqguard.plans import policy as PO  # noqa: E402
from reqguard.session import shared_folder, ship_package, stored  # noqa: E402
from reqguard.sources import corpus as C  # noqa: E402
from reqguard.sources.logs import write_verdicts  # noqa: E402
from reqguard.sources.tables import read_spread  # noqa: E402

Query = Callable[[SparkSession, str], DataFrame]

STRICT = PolicyConfig(
    schema_validation_enabled=True,
    allowed_models=("gpt-4", "claude"),
    max_tokens_per_request=1000,
    pii_action="block",
    rate_limit_requests=4,
    rate_limit_tokens=3000,
)
DETECT_ONLY = PolicyConfig(block_mode=False, schema_validation_enabled=True, pii_action="block")


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return C.request_log(spark, sf)


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return N.normalize_requests(_log(spark, sf)).where(F.col("req").isNotNull())


def _joined(column: str) -> F.Column:
    return F.array_join(column, ",")


def provider_counts(spark: SparkSession, sf: str) -> DataFrame:
    log = _log(spark, sf).select("uri", PV.detect_provider(F.col("uri")).alias("provider"))
    return log.groupBy("uri", "provider").agg(F.count(F.lit(1)).alias("requests"))


def message_table(spark: SparkSession, sf: str) -> DataFrame:
    return N.messages_table(N.normalize_requests(_log(spark, sf)), "request_id")


def flat_content(spark: SparkSession, sf: str) -> DataFrame:
    contents = PV.all_content(F.col("req"))
    return _parsed(spark, sf).select(
        "request_id", F.md5(F.array_join(contents, "\u0001")).alias("content_md5"), F.size(contents).alias("n")
    )


def legacy_prompt(spark: SparkSession, sf: str) -> DataFrame:
    prompt_only = F.get_json_object("body", "$.messages").isNull()
    parsed = N.parse_requests(_log(spark, sf).where(prompt_only)).where(F.col("req").isNotNull())
    first = F.col("req.messages")[0]
    return parsed.select(
        "request_id",
        first["role"].alias("role"),
        F.md5(first["content"]).alias("content_md5"),
        F.size("req.messages").alias("n"),
    )


def strict_parse(spark: SparkSession, sf: str) -> DataFrame:
    return N.normalize_requests(_log(spark, sf)).select("request_id", F.col("req").isNotNull().alias("parsed"))


def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return U.with_estimates(_parsed(spark, sf)).select("request_id", "tokens")


def cost_by_model(spark: SparkSession, sf: str) -> DataFrame:
    return _by_model(U.with_estimates(_parsed(spark, sf)))


def _by_model(estimated: DataFrame) -> DataFrame:
    return estimated.select("provider", "req.model", "tokens", "cost").groupBy("provider", "model").agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("tokens").alias("tokens"),
        F.round(F.sum("cost"), 9).alias("cost"),
    )


def cost_by_price_table(spark: SparkSession, sf: str) -> DataFrame:
    """``cost_by_model`` with the fixed prices as a table."""
    parsed = stored(_parsed(spark, sf).select("provider", "req", "ts"))
    return _by_model(U.with_prices(parsed, U.todays_prices(spark)))


def cost_by_price_change(spark: SparkSession, sf: str) -> DataFrame:
    """Costs when one price doubles, and one model gets a price of its own, in the middle of a day."""
    parsed = stored(_parsed(spark, sf).select("provider", "req", "ts"))
    changed = spark.createDataFrame(
        [("openai", "gpt-4", 2, 0.06), ("anthropic", "claude-3-haiku", -1, 0.5)],
        "provider string, part string, priority int, per_1k double",
    ).withColumn("valid_from", F.lit("2024-01-01 00:10:00").cast("timestamp"))
    return _by_model(U.with_prices(parsed, U.todays_prices(spark).unionByName(changed)))


def cost_texts(spark: SparkSession, sf: str) -> DataFrame:
    return U.with_estimates(_parsed(spark, sf)).select("request_id", cost_text(F.col("cost")).alias("cost"))


def usage_by_hour(spark: SparkSession, sf: str) -> DataFrame:
    report = U.usage_report(N.normalize_requests(_log(spark, sf)))
    return report.withColumn("cost", F.round("cost", 9))


def allowlist(spark: SparkSession, sf: str) -> DataFrame:
    denied = PO.model_denied(F.col("req.model"), ("gpt-4", "claude-3-opus-latest"))
    return _parsed(spark, sf).select("request_id", (~denied).alias("allowed"))


def allowlist_table(spark: SparkSession, sf: str) -> DataFrame:
    """``allowlist`` with the allowed names as a table."""
    models = stored(_parsed(spark, sf).select("request_id", "req.model"))
    names = spark.createDataFrame([("gpt-4",), ("claude-3-opus-latest",)], "name string")
    return AL.with_allowlist(models, names).select("request_id", (~F.col("model_denied")).alias("allowed"))


def token_limit(spark: SparkSession, sf: str) -> DataFrame:
    denied = PO.token_limit_denied(F.col("req.max_tokens"), 1000)
    return _parsed(spark, sf).select("request_id", denied.alias("denied"))


def injection_flags(spark: SparkSession, sf: str) -> DataFrame:
    return S.with_flags(C.texts(spark, sf)).select("request_id", "injection")


def jailbreak_flags(spark: SparkSession, sf: str) -> DataFrame:
    return S.with_flags(C.texts(spark, sf)).select("request_id", "jailbreak")


def request_flags(spark: SparkSession, sf: str) -> DataFrame:
    joined = _parsed(spark, sf).select("request_id", F.array_join(PV.all_content(F.col("req")), "\u0000").alias("text"))
    return S.with_flags(joined).select("request_id", "injection", "jailbreak", _joined("pii_types").alias("pii_types"))


def page_flags(spark: SparkSession, sf: str) -> DataFrame:
    pages = read_spread(spark, f"{sf}/pages.parquet", ["page_id", "html"], ["page_id"])
    return S.with_flags(pages, "html").select(
        "page_id", "injection", "jailbreak", _joined("pii_types").alias("pii_types")
    )


def flags_by_label(spark: SparkSession, sf: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic")
    flags = S.with_flags(C.read_documents(spark, sf)).select("doc_id", "jailbreak", F.size("pii_types").alias("n"))
    return (
        flags.join(labels, "doc_id")
        .groupBy("quality", "toxic")
        .agg(
            F.count(F.lit(1)).alias("documents"),
            F.count_if("jailbreak").alias("jailbreak"),
            F.count_if(F.col("n") > 0).alias("pii"),
        )
    )


def pattern_hits(spark: SparkSession, sf: str) -> DataFrame:
    hits = S.pattern_hits(C.rule_texts(spark, sf), "request_id")
    return hits.groupBy("family", "pattern_id", "category").agg(F.count(F.lit(1)).alias("texts"))


def pii_findings(spark: SparkSession, sf: str) -> DataFrame:
    return S.pii_findings(C.texts(spark, sf), "request_id").select("request_id", "pii_type", "matched")


def has_pii(spark: SparkSession, sf: str) -> DataFrame:
    return S.with_flags(C.texts(spark, sf)).select("request_id", "has_pii")


def pii_types(spark: SparkSession, sf: str) -> DataFrame:
    return S.with_flags(C.texts(spark, sf)).select("request_id", _joined("pii_types").alias("pii_types"))


def pii_redact(spark: SparkSession, sf: str) -> DataFrame:
    return S.redact_table(C.texts(spark, sf)).select("request_id", F.md5("text").alias("text_md5"))


def redact_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """What requests say after their bodies were redacted in place."""
    redacted = S.redact_bodies(_log(spark, sf)).drop("redactions")
    contents = PV.all_content(F.col("req"))
    return N.normalize_requests(redacted).where(F.col("req").isNotNull()).select(
        "request_id", F.md5(F.array_join(contents, "\u0001")).alias("content_md5"), F.size(contents).alias("n")
    )


def finding_counts(spark: SparkSession, sf: str) -> DataFrame:
    return S.finding_counts(C.texts(spark, sf))


def schema_violations(spark: SparkSession, sf: str) -> DataFrame:
    found = V.validate_requests(_log(spark, sf), "request_id")
    return found.select("request_id", "provider", "path", "keyword").distinct()


def schema_counts(spark: SparkSession, sf: str) -> DataFrame:
    return V.violation_counts(schema_violations(spark, sf)).withColumnRenamed("violations", "requests")


def _assembled(spark: SparkSession, sf: str) -> DataFrame:
    return A.assemble_requests(*C.body_events(spark, sf))


def assemble_bodies(spark: SparkSession, sf: str) -> DataFrame:
    return _assembled(spark, sf).where("body_is_utf8").select(
        "correlation_id",
        "opened_seq",
        F.md5("body").alias("body_md5"),
        F.octet_length("body").alias("n_bytes"),
    )


def utf8_policy(spark: SparkSession, sf: str) -> DataFrame:
    config = PolicyConfig(
        prompt_injection_enabled=False, jailbreak_detection_enabled=False, pii_detection_enabled=False
    )
    requests = _assembled(spark, sf).select(
        F.col("correlation_id").alias("request_id"),
        "client_ip",
        F.col("timestamp").alias("ts"),
        "uri",
        "body",
        "body_is_utf8",
    )
    assessed = PO.assess(requests, config, "request_id", "body_is_utf8")
    verdicts = PO.decide(assessed.withColumn("rate", F.lit(None).cast(R.RESULT)), config, "request_id", "body_is_utf8")
    return verdicts.groupBy("body_is_utf8", "status").agg(F.count(F.lit(1)).alias("requests"))


def in_flight(spark: SparkSession, sf: str) -> DataFrame:
    return A.in_flight(*C.body_events(spark, sf)).select("correlation_id", "opened_seq")


def _in_runs(events: tuple[DataFrame, DataFrame]) -> list[tuple[DataFrame, DataFrame]]:
    """Header and chunk events as they arrive in three runs, which cut requests anywhere."""
    seq = F.col("seq")
    parts = (seq <= 40, (seq > 40) & (seq <= 1_000_020), seq > 1_000_020)
    return [tuple(table.where(part) for table in events) for part in parts]


def assemble_runs(spark: SparkSession, sf: str) -> DataFrame:
    """``assemble_bodies`` over a log that arrives in runs."""
    whole, carried = None, None
    for headers, chunks in _in_runs(C.body_events(spark, sf)):
        finished, carried = A.assemble_run(headers, chunks, carried)
        whole = finished if whole is None else whole.unionByName(finished)
    return whole.where("body_is_utf8").select(
        "correlation_id",
        "opened_seq",
        F.md5("body").alias("body_md5"),
        F.octet_length("body").alias("n_bytes"),
    )


def in_flight_runs(spark: SparkSession, sf: str) -> DataFrame:
    """What is open after the last run."""
    carried = None
    for headers, chunks in _in_runs(C.body_events(spark, sf)):
        _, carried = A.assemble_run(headers, chunks, carried)
    return carried[0].select("correlation_id", F.col("seq").alias("opened_seq"))


def event_fates(spark: SparkSession, sf: str) -> DataFrame:
    """Every header and chunk event by what became of it."""
    return A.event_fates(*C.body_events(spark, sf)).groupBy("fate").agg(F.count(F.lit(1)).alias("events"))


def _usage(spark: SparkSession, sf: str) -> DataFrame:
    return stored(U.with_estimates(_parsed(spark, sf)).select("request_id", "client_ip", "ts", "tokens"))


def _rated(spark: SparkSession, sf: str, requests: int, tokens: int) -> DataFrame:
    return _decisions(R.rate_limit(_usage(spark, sf), requests, tokens))


def _decisions(rated: DataFrame) -> DataFrame:
    return rated.select(
        "request_id",
        "client_ip",
        "rate.allowed",
        "rate.request_count",
        "rate.token_count",
        "rate.reset_seconds",
        "rate.exceeded",
    )


def rate_requests(spark: SparkSession, sf: str) -> DataFrame:
    return _rated(spark, sf, 4, 0)


def rate_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _rated(spark, sf, 0, 3000)


def rate_both(spark: SparkSession, sf: str) -> DataFrame:
    return _rated(spark, sf, 4, 3000)


def _user_events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").select(
        "event_id", "user_id", "ts", F.ceil("value").alias("tokens")
    )


_DAILY = {"client": "user_id", "request_id": "event_id", "window_seconds": 86_400, "block_windows": 8}


def rate_events_daily(spark: SparkSession, sf: str) -> DataFrame:
    return R.denials_per_client(R.rate_limit(_user_events(spark, sf), 3, 300, **_DAILY), "user_id")


def _run_by_run(log: DataFrame, runs: int, requests: int, tokens: int, **names) -> DataFrame:
    """Decisions of a log that is judged in runs of equal time, each from the state of the one before."""
    first, last = log.agg(F.min("ts"), F.max("ts")).first()
    whole, state = None, None
    for k in range(runs):
        part = log if k == 0 else log.where(F.col("ts") >= F.lit(first + (last - first) * k / runs))
        if k < runs - 1:
            ends = F.col("ts") < F.lit(first + (last - first) * (k + 1) / runs)
            part = part.where(ends | F.col("ts").isNull() if k == 0 else ends)
        decided, state = R.rate_limit_run(part, state, requests, tokens, **names)
        whole = decided if whole is None else whole.unionByName(decided)
    return whole


def rate_runs(spark: SparkSession, sf: str) -> DataFrame:
    """``rate_both`` over a log that arrives in three runs."""
    return _decisions(_run_by_run(_usage(spark, sf), 3, 4, 3000))


def rate_events_runs(spark: SparkSession, sf: str) -> DataFrame:
    """``rate_events_daily`` over a log that arrives in four runs."""
    return R.denials_per_client(_run_by_run(_user_events(spark, sf), 4, 3, 300, **_DAILY), "user_id")


def _verdicts(spark: SparkSession, sf: str, config: PolicyConfig) -> DataFrame:
    return PO.evaluate_policy(_log(spark, sf), config)


def _shown(verdicts: DataFrame) -> DataFrame:
    return verdicts.select(
        "request_id",
        "provider",
        "decision",
        "status",
        "block_reason",
        _joined("reason_codes").alias("reason_codes"),
        _joined("tags").alias("tags"),
    )


def verdicts_block(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(_verdicts(spark, sf, STRICT))


def verdicts_detect_only(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(_verdicts(spark, sf, DETECT_ONLY))


def verdicts_default(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(_verdicts(spark, sf, PolicyConfig()))


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    return M.traffic_metrics(_verdicts(spark, sf, STRICT))


def metrics_per_minute(spark: SparkSession, sf: str) -> DataFrame:
    return M.traffic_metrics_per_minute(_verdicts(spark, sf, PolicyConfig()))


def verdicts_from_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The whole way: bodies cut into chunks, assembled, judged."""
    requests = A.assemble_requests(*C.chunked(_log(spark, sf))).select(
        F.col("correlation_id").alias("request_id"), F.col("timestamp").alias("ts"), "client_ip", "uri", "body"
    )
    return _shown(PO.evaluate_policy(requests))


def metrics_in_flight(spark: SparkSession, sf: str) -> DataFrame:
    """Counters over assembled requests, with the gauge of those whose last piece is still out."""
    log = _log(spark, sf)
    headers, chunks = C.chunked(log, unfinished=C.key_of(log) % 19 == 1)
    requests = A.assemble_requests(headers, chunks).select(
        F.col("correlation_id").alias("request_id"), F.col("timestamp").alias("ts"), "client_ip", "uri", "body"
    )
    totals = M.traffic_metrics(PO.evaluate_policy(requests))
    return M.with_in_flight(totals, A.in_flight(headers, chunks))


def assemble_events(spark: SparkSession, sf: str) -> DataFrame:
    """Assembly over the full event schemas; bodies that are not UTF-8 are reported by their bytes."""
    whole = A.assemble_requests(*C.full_events(spark, sf))
    return whole.select(
        "correlation_id",
        "opened_seq",
        "request_id",
        "client_port",
        "method",
        "route_id",
        F.try_element_at("headers", F.lit("host"))[0].alias("host"),
        F.array_join(F.try_element_at("headers", F.lit("x-doc")), "/").alias("doc"),
        F.md5(F.col("body").cast("binary")).alias("body_md5"),
        F.octet_length("body").alias("n_bytes"),
        "body_is_utf8",
    )


def utf8_fail_open(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies that are not UTF-8 pass, and are told by their tag, when the policy fails open."""
    config = PolicyConfig(
        prompt_injection_enabled=False, jailbreak_detection_enabled=False, pii_detection_enabled=False, fail_open=True
    )
    requests = _assembled(spark, sf).select(
        F.concat("correlation_id", F.lit("/"), "opened_seq").alias("request_id"),
        "client_ip",
        F.col("timestamp").alias("ts"),
        "uri",
        "body",
    )
    verdicts = PO.evaluate_policy(requests, config)
    return verdicts.groupBy("decision", _joined("tags").alias("tags"), _joined("reason_codes").alias("reason_codes")).agg(
        F.count(F.lit(1)).alias("requests")
    )


def _lines(headers: str, hidden: str = "") -> F.Column:
    """A header map as sorted lines; the value of ``hidden`` is our own wording and left out."""
    lines = F.transform(
        F.map_entries(headers),
        lambda e: F.concat(e["key"], F.lit("="), F.when(e["key"] == hidden, "").otherwise(e["value"])),
    )
    return F.array_join(F.array_sort(lines), "\n")


def verdict_headers(spark: SparkSession, sf: str) -> DataFrame:
    return _verdicts(spark, sf, STRICT).select(
        "request_id",
        _lines("request_headers").alias("request_headers"),
        _lines("response_headers", PO.H_SCHEMA_ERRORS).alias("response_headers"),
        "block_body",
    )


def verdict_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts written by day and read back."""
    path = f"{shared_folder(spark).rstrip('/')}/reqguard-verdicts-{uuid.uuid4().hex}"
    write_verdicts(_verdicts(spark, sf, PolicyConfig()), path)
    back = spark.read.parquet(path)
    return back.groupBy("date", "decision", "status").agg(F.count(F.lit(1)).alias("requests"))


def pii_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Where each finding lies: its number in the text and its bytes."""
    return S.pii_findings(C.texts(spark, sf), "request_id").select(
        "request_id", "pii_type", F.col("position").cast("bigint").alias("position"), "start", "end"
    )


_QUERIES: dict[str, Query] = {
    "provider_counts": provider_counts,
    "message_table": message_table,
    "flat_content": flat_content,
    "legacy_prompt": legacy_prompt,
    "strict_parse": strict_parse,
    "token_estimate": token_estimate,
    "cost_by_model": cost_by_model,
    "cost_by_price_table": cost_by_price_table,
    "cost_by_price_change": cost_by_price_change,
    "cost_text": cost_texts,
    "usage_by_hour": usage_by_hour,
    "allowlist": allowlist,
    "allowlist_table": allowlist_table,
    "token_limit": token_limit,
    "injection_flags": injection_flags,
    "jailbreak_flags": jailbreak_flags,
    "request_flags": request_flags,
    "page_flags": page_flags,
    "flags_by_label": flags_by_label,
    "pattern_hits": pattern_hits,
    "pii_findings": pii_findings,
    "has_pii": has_pii,
    "pii_types": pii_types,
    "pii_redact": pii_redact,
    "redact_bodies": redact_bodies,
    "finding_counts": finding_counts,
    "schema_violations": schema_violations,
    "schema_counts": schema_counts,
    "assemble_bodies": assemble_bodies,
    "utf8_policy": utf8_policy,
    "in_flight": in_flight,
    "rate_requests": rate_requests,
    "rate_tokens": rate_tokens,
    "rate_both": rate_both,
    "rate_events_daily": rate_events_daily,
    "rate_runs": rate_runs,
    "rate_events_runs": rate_events_runs,
    "assemble_runs": assemble_runs,
    "in_flight_runs": in_flight_runs,
    "event_fates": event_fates,
    "verdicts_block": verdicts_block,
    "verdicts_detect_only": verdicts_detect_only,
    "verdicts_default": verdicts_default,
    "metrics": metrics,
    "metrics_per_minute": metrics_per_minute,
    "verdicts_from_chunks": verdicts_from_chunks,
    "metrics_in_flight": metrics_in_flight,
    "assemble_events": assemble_events,
    "utf8_fail_open": utf8_fail_open,
    "verdict_headers": verdict_headers,
    "verdict_sink": verdict_sink,
    "pii_spans": pii_spans,
}


# The training-data operators are an optional part; without them the rest stands.
try:
    from reqguard.llm.queries import ORACLE_SQL as _LLM_SQL
    from reqguard.llm.queries import QUERIES as _LLM_QUERIES
except ImportError:
    _LLM_QUERIES, _LLM_SQL = {}, {}
_QUERIES |= _LLM_QUERIES
try:
    import corpus_pipeline
except ImportError:
    pass
else:
    _QUERIES["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL is not None:
        _LLM_SQL = _LLM_SQL | {"pipeline": corpus_pipeline.ORACLE_SQL}


def _prepared(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
        ship_package(spark)
        return query(spark, sf_dir)

    return run


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: every request of the log judged, counters per minute."""
    return queries()["metrics_per_minute"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    return {name: _prepared(query) for name, query in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql() | _LLM_SQL
