"""Requests -> parsed requests -> messages table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import providers as PV
from ..functions.columns import pinned

_KNOWN = ("model", "messages", "max_tokens", "prompt", "system")
# The limit on the size of a VARIANT holds for each leaf, not for the body.
_FIELDS = (
    "struct<model variant, messages array<struct<role variant, content variant>>,"
    " max_tokens variant, prompt variant, system variant>"
)
_PLAIN_MESSAGES = "array<struct<role string, content string>>"


def _text(body: str) -> Column:
    """The body if it is valid UTF-8."""
    text = F.coalesce(F.col(body), F.lit(""))
    return F.when(F.is_valid_utf8(text), text)


def with_document(requests: DataFrame, body: str = "body") -> DataFrame:
    """Add ``doc``, the body as a VARIANT, and ``doc_too_large``.

    ``doc`` is NULL unless the body is exactly one JSON document; a document beyond the size of a
    VARIANT has none either, and is told by ``doc_too_large``.
    """
    df = requests.withColumn("_text", _text(body))
    df = df.withColumn("_doc", PV.read_document(F.col("_text"), "variant"))
    bad = F.col("_doc.bad").isNotNull()
    return (
        df.withColumn("doc", F.when(~bad & PV.is_one_value(F.col("_text")), F.col("_doc.b")))
        .withColumn("doc_too_large", F.coalesce(PV.is_beyond_variant(F.col("_text"), bad), F.lit(False)))
        .drop("_text", "_doc")
    )


def _request(provider: Column, f: Column, msgs: Column) -> Column:
    """The parsed request, or NULL when a field has a type that the wire format rules out."""
    is_anthropic = provider == "anthropic"
    prompt = PV.string_value(f["prompt"])
    max_tokens = F.when(PV.json_kind(f["max_tokens"]) == "BIGINT", f["max_tokens"].try_cast("bigint"))
    no_messages = msgs.isNull()

    typed = (
        (PV.is_absent_or_null(f["model"]) | PV.is_string(f["model"]))
        & (PV.is_absent_or_null(f["prompt"]) | PV.is_string(f["prompt"]))
        & (PV.is_absent_or_null(f["max_tokens"]) | F.coalesce(max_tokens.between(0, PV.U32_MAX), F.lit(False)))
        & (
            no_messages
            | F.coalesce(
                F.forall(msgs, lambda m: m.isNotNull() & PV.is_string(m["role"]) & PV.content_ok(m["content"])),
                F.lit(False),
            )
        )
        & (~is_anthropic | PV.is_absent_or_null(f["system"]) | PV.content_ok(f["system"]))
    )

    plain = F.coalesce(
        F.transform(
            msgs,
            lambda m: F.struct(
                PV.string_value(m["role"]).alias("role"), PV.content_text(m["content"]).alias("content")
            ),
        ),
        F.array(),
    ).cast(_PLAIN_MESSAGES)
    as_user = F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))).cast(_PLAIN_MESSAGES)
    turns = PV.legacy_turns(prompt)
    from_prompt = (
        F.when(prompt.isNull(), F.array().cast(_PLAIN_MESSAGES))
        .when(~is_anthropic, as_user)
        .when((F.size(plain) == 0) & (F.size(turns) == 0), as_user)
        .otherwise(turns)
    )
    last_system = F.try_element_at(F.filter(plain, lambda m: m["role"] == "system"), F.lit(-1))["content"]
    system = F.when(
        is_anthropic,
        F.when(~PV.is_absent_or_null(f["system"]), PV.content_text(f["system"])),
    ).otherwise(last_system)
    req = F.struct(
        PV.string_value(f["model"]).alias("model"),
        F.concat(plain, from_prompt).alias("messages"),
        max_tokens.alias("max_tokens"),
        system.alias("system_prompt"),
    ).cast(PV.REQ_TYPE)
    return F.when(f.isNotNull() & typed, req)


def parse_requests(requests: DataFrame, body: str = "body", uri: str = "uri", keep_doc: bool = False) -> DataFrame:
    """Add ``provider`` and ``req``; ``req`` is NULL when the body is not a recognised request.

    All steps are narrow projections: the body is passed over once to see that it is one document,
    and read once into typed fields whose leaves are VARIANTs, which never reach a shuffle.  Members
    that are not known may be repeated; a known one at the top may not.  A well-formed body with a
    single value that Spark cannot hold stops the job rather than pass as something else.
    ``keep_doc`` adds ``doc`` and ``doc_too_large`` for callers that validate in the same chain.
    """
    df = with_document(requests, body) if keep_doc else requests
    df = df.withColumn("_text", _text(body)).withColumn("provider", PV.detect_provider(F.col(uri)))
    df = df.withColumn("_read", PV.read_document(F.col("_text"), _FIELDS))
    bad = F.col("_read.bad").isNotNull()
    fits = ~bad & PV.is_one_value(F.col("_text")) & ~PV.repeats(F.col("_text"), _KNOWN)
    df = df.withColumn("_f", F.when(fits, F.col("_read.b")))
    held = F.when(
        PV.is_beyond_variant(F.col("_text"), bad), F.raise_error(F.lit("a request body holds a value beyond 128 MiB"))
    )
    df = df.withColumn("_req", F.coalesce(held, _request(F.col("provider"), F.col("_f"), F.col("_f.messages"))))
    df = df.select(
        *requests.columns,
        "provider",
        *(["doc", "doc_too_large"] if keep_doc else []),
        F.when(F.size("_req.messages") > 0, F.col("_req")).alias("_req"),
    )
    return pinned(df, {"req": F.col("_req")}).drop("_req")


def normalize_requests(requests: DataFrame, body: str = "body", uri: str = "uri") -> DataFrame:
    """Parsed requests without the raw body."""
    return parse_requests(requests, body, uri).drop(body)


def messages_table(parsed: DataFrame, *keys: str) -> DataFrame:
    """One row per message: the key columns, position (from 0), role and content."""
    return parsed.select(*keys, F.posexplode("req.messages").alias("position", "_m")).select(
        *keys, "position", F.col("_m.role").alias("role"), F.col("_m.content").alias("content")
    )
