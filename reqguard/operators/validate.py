"""Requests -> schema violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import schema_rules as R
from ..functions.columns import pinned
from ..functions.providers import detect_provider
from .normalize import with_document


def violations(provider: str = "provider", doc: str = "doc") -> Column:
    """Violations of the schema that a document is held to, given its provider (column names)."""

    def has(name: str) -> str:
        return f"try_variant_get({doc}, '$.{name}', 'variant') IS NOT NULL"

    model = f"try_variant_get({doc}, '$.model', 'variant')"
    names_gpt = f"coalesce({R.is_string(model)} AND startswith(try_cast({model} AS string), 'gpt'), false)"
    openai_like = f"{provider} IN ('openai', 'azure')"
    use_messages = (
        f"{provider} = 'anthropic'"
        f" OR (NOT {openai_like} AND {has('messages')} AND {has('max_tokens')} AND NOT {names_gpt})"
    )
    root = "''"
    neither = "Missing required field: 'messages' or 'prompt'"
    return F.expr(
        f"""CASE
        WHEN {doc}_too_large THEN {R.violation(root, "size", "Body is too large to be validated")}
        WHEN {doc} IS NULL THEN {R.violation(root, "json", "Invalid JSON")}
        WHEN {use_messages} THEN {R.MESSAGES(doc, root)}
        WHEN {has("messages")} THEN {R.CHAT(doc, root)}
        WHEN {has("prompt")} THEN {R.COMPLETION(doc, root)}
        WHEN {openai_like} THEN {R.violation(root, "format", neither)}
        ELSE {R.violation(root, "format", "Unable to determine request format")} END"""
    )


def with_validation(df: DataFrame) -> DataFrame:
    """Add ``errors`` and ``schema_valid`` to rows that carry ``provider``, ``doc`` and ``doc_too_large``."""
    out = pinned(df, {"errors": violations()})
    return out.withColumn("schema_valid", F.size("errors") == 0)


def error_text(errors: Column) -> Column:
    """All errors in one line: ``<pointer>: <text>`` joined by ``; ``."""
    lines = F.transform(
        errors,
        lambda e: F.when(e["path"] == "", e["message"]).otherwise(
            F.concat(e["path"], F.lit(": "), e["message"])
        ),
    )
    return F.array_join(lines, "; ")


def validate_requests(requests: DataFrame, *keys: str, body: str = "body", uri: str = "uri") -> DataFrame:
    """The violations table: keys, provider, path, keyword, message; valid requests give no row."""
    df = with_document(requests.select(*keys, uri, body), body)
    df = df.withColumn("provider", detect_provider(F.col(uri)))
    df = pinned(df, {"_errors": violations()})
    return df.select(*keys, "provider", F.explode("_errors").alias("_e")).select(*keys, "provider", "_e.*")


def violation_counts(violations_table: DataFrame) -> DataFrame:
    """Counts by provider, path with positions generalised, and keyword."""
    path = F.regexp_replace("path", r"/\d+(?=/|$)", "/*")
    return violations_table.groupBy("provider", path.alias("path"), "keyword").agg(
        F.count(F.lit(1)).alias("violations")
    )
