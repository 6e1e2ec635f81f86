"""The policy job: requests and a config -> one verdict per request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PolicyConfig
from ..functions import detect as D
from ..functions import patterns as P
from ..functions import providers as PV
from ..functions.encoding import is_utf8
from ..functions.estimate import cost_text, estimate_cost, estimate_tokens
from ..operators.normalize import parse_requests
from ..operators.ratelimit import RESULT, rate_limit
from ..operators.validate import error_text, with_validation
from ..session import stored

# --- Fixed values: header names, tags, reason codes, block texts ------------------------------
H_PROVIDER = "X-AI-Gateway-Provider"
H_MODEL = "X-AI-Gateway-Model"
H_SCHEMA_VALID = "X-AI-Gateway-Schema-Valid"
H_SCHEMA_ERRORS = "X-AI-Gateway-Schema-Errors"
H_TOKENS = "X-AI-Gateway-Tokens-Estimated"
H_COST = "X-AI-Gateway-Cost-Estimated"
H_PII = "X-AI-Gateway-PII-Detected"
H_BLOCKED = "X-AI-Gateway-Blocked"
H_BLOCKED_REASON = "X-AI-Gateway-Blocked-Reason"
H_LIMIT_REQUESTS = "X-RateLimit-Limit-Requests"
H_REMAINING_REQUESTS = "X-RateLimit-Remaining-Requests"
H_LIMIT_TOKENS = "X-RateLimit-Limit-Tokens"
H_REMAINING_TOKENS = "X-RateLimit-Remaining-Tokens"
H_RESET = "X-RateLimit-Reset"
H_RETRY_AFTER = "Retry-After"

BASE_TAG = "ai-gateway"

INVALID_UTF8 = "INVALID_UTF8"
SCHEMA_VALIDATION_FAILED = "SCHEMA_VALIDATION_FAILED"
MODEL_NOT_ALLOWED = "MODEL_NOT_ALLOWED"
TOKEN_LIMIT_EXCEEDED = "TOKEN_LIMIT_EXCEEDED"
RATE_LIMIT_EXCEEDED = "RATE_LIMIT_EXCEEDED"
PROMPT_INJECTION = "PROMPT_INJECTION"
JAILBREAK_ATTEMPT = "JAILBREAK_ATTEMPT"
PII_DETECTED = "PII_DETECTED"

TEXT_400_BODY = "Invalid request body"
TEXT_400_SCHEMA = "Schema validation failed"
TEXT_403 = "Forbidden"
TEXT_429 = "Too Many Requests"
# --- end of fixed values ----------------------------------------------------------------------

_STRINGS = "array<string>"
_HEADERS = "map<string,string>"

# What a request is before limits and detectors: how far through the pipeline it gets.
CHECKED, UNRECOGNISED, BAD_ENCODING, BAD_SCHEMA = "checked", "unrecognised", "bad-encoding", "bad-schema"


def model_denied(model: Column, allowed: tuple[str, ...]) -> Column:
    """A model that neither contains nor is contained in an allowed name; no model passes."""
    if not allowed:
        return F.lit(False)
    names = F.array(*[F.lit(a) for a in allowed])
    fits = F.exists(names, lambda a: F.contains(model, a) | F.contains(a, model))
    return F.coalesce(~fits, F.lit(False))


def token_limit_denied(max_tokens: Column, limit: int | None) -> Column:
    """The request asks for more tokens than the limit; it is the request, not the estimate."""
    return F.lit(False) if limit is None else F.coalesce(max_tokens > limit, F.lit(False))


def assess(requests: DataFrame, config: PolicyConfig, *keep: str) -> DataFrame:
    """Everything that a request's own content tells, without its text: one narrow stage.

    Output: the kept columns, provider, stage, model, tokens, cost, schema columns and raw flags.
    """
    df = parse_requests(requests, keep_doc=config.schema_validation_enabled)
    df = df.withColumn("_utf8", is_utf8(F.col("body")))
    if config.schema_validation_enabled:
        df = with_validation(df)
        df = df.withColumn("schema_errors", F.when(~F.col("schema_valid"), error_text(F.col("errors"))))
    else:
        df = df.withColumn("schema_valid", F.lit(None).cast("boolean"))
        df = df.withColumn("schema_errors", F.lit(None).cast("string"))

    stops_at_schema = F.lit(False)
    if config.schema_validation_enabled and config.block_mode:
        stops_at_schema = ~F.col("schema_valid")
    df = df.withColumn(
        "stage",
        F.when(~F.col("_utf8"), BAD_ENCODING)
        .when(stops_at_schema, BAD_SCHEMA)
        .when(F.col("req").isNull(), UNRECOGNISED)
        .otherwise(CHECKED),
    )
    req = F.col("req")
    checked = F.col("stage") == CHECKED
    df = df.select(
        *keep,
        "provider",
        "stage",
        "schema_valid",
        "schema_errors",
        F.when(checked, req["model"]).alias("model"),
        F.when(checked, req["max_tokens"]).alias("max_tokens"),
        F.when(checked, estimate_tokens(req)).alias("tokens"),
        F.when(checked, F.array_join(PV.all_content(req), D.SEPARATOR)).alias("_text"),
    )
    df = df.withColumns(
        {
            "cost": estimate_cost(F.col("provider"), F.col("model"), F.col("tokens")),
            "model_denied": model_denied(F.col("model"), config.allowed_models),
            "token_limit_denied": token_limit_denied(F.col("max_tokens"), config.max_tokens_per_request),
        }
    )
    scans = config.prompt_injection_enabled or config.jailbreak_detection_enabled or config.pii_detection_enabled
    df = df.withColumn("_mask", D.scan_mask(F.col("_text")) if scans else F.lit(0))
    hit = {
        "injection_hit": config.prompt_injection_enabled,
        "jailbreak_hit": config.jailbreak_detection_enabled,
    }
    bits = {"injection_hit": D.INJECTION_BIT, "jailbreak_hit": D.JAILBREAK_BIT}
    df = df.withColumns({n: D.has_bit(F.col("_mask"), bits[n]) if on else F.lit(False) for n, on in hit.items()})
    pii_candidate = D.has_bit(F.col("_mask"), D.PII_BIT) if config.pii_detection_enabled else F.lit(False)
    df = df.withColumn("pii_types", D.pii_types(F.col("_text"), pii_candidate))
    return df.drop("_text", "_mask")


def _texts(*items: Column) -> Column:
    """The non-NULL items, as an array of strings."""
    return F.array_compact(F.array(*items)).cast(_STRINGS)


def _headers(items: dict[str, Column]) -> Column:
    """The headers whose value is not NULL, as a map."""
    entries = [
        F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")))
        for k, v in items.items()
    ]
    return F.map_from_entries(F.array_compact(F.array(*entries))).cast(_HEADERS)


def _no_headers() -> Column:
    return F.create_map().cast(_HEADERS)


def decide(assessed: DataFrame, config: PolicyConfig, *keep: str) -> DataFrame:
    """Verdicts from assessed requests that carry the limiter's decision in ``rate``.

    ``rate`` is NULL where the limiter was not asked.
    """
    c = F.col
    off = F.lit(False)
    checked = c("stage") == CHECKED
    limited = F.coalesce(~c("rate.allowed"), off)
    scanned = checked & ~limited
    policy_block = c("model_denied") | c("token_limit_denied")
    injection = scanned & ~policy_block & c("injection_hit")
    blocks = F.lit(config.block_mode)
    df = assessed.withColumns({"_limited": limited, "_policy": policy_block, "injection": injection})
    jailbreak = scanned & ~c("_policy") & ~(c("injection") & blocks) & c("jailbreak_hit")
    pii = scanned & (F.size("pii_types") > 0)
    df = df.withColumns(
        {"jailbreak": jailbreak, "pii": pii, "_pii_list": F.array_join("pii_types", ",")}
    )
    pii_blocks = c("pii") & F.lit(config.pii_action == "block" and config.block_mode)
    blocked = scanned & (c("_policy") | ((c("injection") | c("jailbreak")) & blocks) | pii_blocks)
    df = df.withColumn("_blocked", blocked)
    df = df.withColumn(
        "block_reason",
        F.when(
            c("_blocked"),
            F.coalesce(
                F.when(pii_blocks, F.concat(F.lit("pii-detected:"), c("_pii_list"))),
                F.when(c("jailbreak") & blocks, P.JAILBREAK),
                F.when(c("injection") & blocks, P.INJECTION),
                F.when(c("token_limit_denied"), "token-limit-exceeded"),
                F.when(c("model_denied"), "model-not-allowed"),
            ),
        ),
    )

    bad_encoding = c("stage") == BAD_ENCODING
    bad_schema = c("stage") == BAD_SCHEMA
    status = (
        F.when(bad_encoding & F.lit(not config.fail_open), 400)
        .when(bad_schema, 400)
        .when(c("_limited"), 429)
        .when(c("_blocked"), 403)
    )
    block_body = (
        F.when(c("status").isNull(), F.lit(None).cast("string"))
        .when(bad_encoding, TEXT_400_BODY)
        .when(bad_schema, TEXT_400_SCHEMA)
        .when(c("_limited"), TEXT_429)
        .otherwise(TEXT_403)
    )
    schema_tag = F.when(F.coalesce(c("schema_valid"), off), "schema-valid")
    base = F.lit(BASE_TAG)
    tags = (
        F.when(bad_encoding, _texts(base, F.lit("error" if config.fail_open else "blocked")))
        .when(bad_schema, _texts(base, F.lit("blocked"), F.lit("schema-invalid")))
        .when(~checked, _texts(base))
        .otherwise(
            _texts(
                base,
                F.concat(F.lit("provider:"), c("provider")),
                F.concat(F.lit("model:"), c("model")),
                schema_tag,
                F.when(c("_limited"), "rate-limited"),
                F.when(c("injection"), "detected:prompt-injection"),
                F.when(c("jailbreak"), "detected:jailbreak"),
                F.when(c("pii"), F.concat(F.lit("pii:"), c("_pii_list"))),
                F.when(c("_blocked"), "blocked"),
            )
        )
    )
    reason_codes = _texts(
        F.when(bad_encoding, INVALID_UTF8),
        F.when(bad_schema, SCHEMA_VALIDATION_FAILED),
        F.when(c("model_denied"), MODEL_NOT_ALLOWED),
        F.when(c("token_limit_denied"), TOKEN_LIMIT_EXCEEDED),
        F.when(c("_limited"), RATE_LIMIT_EXCEEDED),
        F.when(c("injection"), PROMPT_INJECTION),
        F.when(c("jailbreak"), JAILBREAK_ATTEMPT),
        F.when(c("pii"), PII_DETECTED),
    )
    request_headers = F.when(
        checked & c("status").isNull(),
        _headers(
            {
                H_PROVIDER: c("provider"),
                H_MODEL: c("model"),
                H_SCHEMA_VALID: c("schema_valid").cast("string"),
                H_TOKENS: c("tokens").cast("string"),
                H_COST: cost_text(c("cost")) if config.add_cost_headers else F.lit(None).cast("string"),
                H_PII: F.when(c("pii"), c("_pii_list")),
            }
        ),
    ).otherwise(_no_headers())
    asked = c("rate").isNotNull()
    by_requests = asked & F.lit(config.rate_limit_requests > 0)
    by_tokens = asked & F.lit(config.rate_limit_tokens > 0)
    reset = c("rate.reset_seconds")
    response_headers = (
        F.when(
            bad_schema, _headers({H_SCHEMA_VALID: F.lit("false"), H_SCHEMA_ERRORS: c("schema_errors")})
        )
        .when(
            c("_limited"),
            _headers(
                {
                    H_LIMIT_REQUESTS: c("rate.request_limit"),
                    H_REMAINING_REQUESTS: F.lit("0"),
                    H_RESET: reset,
                    H_RETRY_AFTER: reset,
                }
            ),
        )
        .when(c("_blocked"), _headers({H_BLOCKED: F.lit("true"), H_BLOCKED_REASON: c("block_reason")}))
        .when(
            asked,
            _headers(
                {
                    H_LIMIT_REQUESTS: F.when(by_requests, c("rate.request_limit")),
                    H_REMAINING_REQUESTS: F.when(
                        by_requests, F.greatest(c("rate.request_limit") - c("rate.request_count"), F.lit(0))
                    ),
                    H_LIMIT_TOKENS: F.when(by_tokens, c("rate.token_limit")),
                    H_REMAINING_TOKENS: F.when(
                        by_tokens, F.greatest(c("rate.token_limit") - c("rate.token_count"), F.lit(0))
                    ),
                    H_RESET: reset,
                }
            ),
        )
        .otherwise(_no_headers())
    )
    return df.withColumn("status", status).select(
        *keep,
        "provider",
        F.when(c("status").isNull(), "allow").otherwise("block").alias("decision"),
        "status",
        block_body.alias("block_body"),
        "block_reason",
        request_headers.alias("request_headers"),
        response_headers.alias("response_headers"),
        tags.alias("tags"),
        reason_codes.alias("reason_codes"),
        "injection",
        "jailbreak",
        "pii",
    )


def evaluate_policy(
    requests: DataFrame,
    config: PolicyConfig = PolicyConfig(),
    request_id: str = "request_id",
    client: str = "client_ip",
    ts: str = "ts",
    materialize: bool = True,
) -> DataFrame:
    """One verdict per request.

    ``requests`` has the id, client and time columns plus ``uri`` and ``body``.  Bodies are read,
    parsed and scanned in one narrow stage and never shuffled.  Only with a rate limit are the
    short assessments (no text) written to the checkpoint folder, since the limiter reads them
    more than once; ``materialize=False`` recomputes them instead.
    """
    keep = (request_id, client, ts)
    assessed = assess(requests, config, *keep)
    if not config.rate_limited:
        return decide(assessed.withColumn("rate", F.lit(None).cast(RESULT)), config, *keep)
    if materialize:
        assessed = stored(assessed)
    asked = rate_limit(
        assessed.where(F.col("stage") == CHECKED),
        config.rate_limit_requests,
        config.rate_limit_tokens,
        client=client,
        ts=ts,
        request_id=request_id,
    )
    others = assessed.where(F.col("stage") != CHECKED).withColumn("rate", F.lit(None).cast(RESULT))
    return decide(asked.unionByName(others), config, *keep)
