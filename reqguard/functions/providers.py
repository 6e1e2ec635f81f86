"""Provider detection and body parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: request paths by provider --------------------------------------------------
AZURE_PATH_PART = "/openai/deployments/"
OPENAI_PATHS = ("/v1/chat/completions", "/v1/completions", "/v1/embeddings")
ANTHROPIC_PATHS = ("/v1/messages", "/v1/complete")
# --- end of fixed values ----------------------------------------------------------------------

REQ_TYPE = (
    "struct<model string, messages array<struct<role string, content string>>,"
    " max_tokens bigint, system_prompt string>"
)
U32_MAX = 4294967295


def _starts_with_any(path: Column, prefixes: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | path.startswith(p)
    return hit


def detect_provider(path: Column) -> Column:
    """azure, openai, anthropic or unknown, from the request path; headers play no part."""
    return (
        F.when(path.contains(AZURE_PATH_PART), "azure")
        .when(_starts_with_any(path, OPENAI_PATHS), "openai")
        .when(_starts_with_any(path, ANTHROPIC_PATHS), "anthropic")
        .otherwise("unknown")
    )


# --- JSON value tests on VARIANT columns ------------------------------------------------------


def json_kind(v: Column) -> Column:
    """Spark's type text of a JSON value: STRING, BIGINT, VOID, ARRAY<...>, ...; NULL if absent."""
    return F.schema_of_variant(v)


def is_absent_or_null(v: Column) -> Column:
    return F.coalesce(json_kind(v) == "VOID", F.lit(True))


def is_string(v: Column) -> Column:
    return F.coalesce(json_kind(v) == "STRING", F.lit(False))


def string_value(v: Column) -> Column:
    """The text of a JSON string; NULL for everything else (no coercion)."""
    return F.when(is_string(v), v.try_cast("string"))


# A VARIANT holds values up to this size.
VARIANT_BYTES = 128 * 1024 * 1024
_READ_OPTIONS = {"maxStringLen": "2147483647", "allowSingleQuotes": "false", "columnNameOfCorruptRecord": "bad"}


def read_document(text: Column, kind: str) -> Column:
    """struct<b, bad>: a JSON text read as ``kind``, strings of any length; ``bad`` is set if it does not fit.

    The text is read as a member of an object, so that whatever follows its value makes it bad,
    unless it closes the object; ``is_one_value`` tells that.
    """
    whole = F.concat(F.lit('{"b":'), text, F.lit("}"))
    return F.from_json(whole, f"b {kind}, bad string", _READ_OPTIONS)


def is_one_value(text: Column) -> Column:
    """Whether a text is one element between square brackets; it is passed over, not built up."""
    return F.coalesce(F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1, F.lit(False))


def is_beyond_variant(text: Column, bad: Column) -> Column:
    """A JSON text that is well-formed, and does not fit for the size of a value in it."""
    whole = F.concat(F.lit('{"b":'), text, F.lit("}"))
    alone = F.coalesce(F.json_object_keys(whole) == F.array(F.lit("b")), F.lit(False))
    return (F.octet_length(text) > VARIANT_BYTES) & bad & is_one_value(text) & alone


def repeats(text: Column, names: tuple[str, ...]) -> Column:
    """Whether an object has one of the names more than once."""
    found = F.filter(F.json_object_keys(text), lambda k: k.isin(*names))
    return F.coalesce(F.size(found) > F.size(F.array_distinct(found)), F.lit(False))


PARTS = "array<struct<type variant, text variant>>"


def _parts(v: Column) -> Column:
    return v.try_cast(PARTS)


def _parts_ok(v: Column) -> Column:
    return F.forall(
        _parts(v),
        lambda p: p.isNotNull()
        & is_string(p["type"])
        & (is_absent_or_null(p["text"]) | is_string(p["text"])),
    )


def content_ok(v: Column) -> Column:
    """A string, or an array of parts with a string type and, if any, a string text."""
    return is_string(v) | F.coalesce(_parts_ok(v), F.lit(False))


def content_text(v: Column) -> Column:
    """The string itself, or the texts of the text parts joined by a space."""
    texts = F.filter(
        F.transform(_parts(v), lambda p: F.when(string_value(p["type"]) == "text", string_value(p["text"]))),
        lambda t: t.isNotNull(),
    )
    return F.when(is_string(v), string_value(v)).otherwise(F.array_join(texts, " "))


def trim_unicode(s: Column) -> Column:
    """Strip Unicode white space on both ends."""
    return F.regexp_replace(s, r"(?U)\A\s++|(?<!\s)\s++\z", "")


def legacy_turns(prompt: Column) -> Column:
    """Messages of a ``Human:`` / ``Assistant:`` prompt; paragraphs without a prefix are lost."""
    message = "struct<role string, content string>"

    def turn(paragraph: Column) -> Column:
        p = trim_unicode(paragraph)

        def as_role(prefix: str, role: str) -> Column:
            text = trim_unicode(F.substring(p, F.lit(len(prefix) + 1), F.length(p)))
            return F.when(
                p.startswith(prefix) & (text != ""),
                F.struct(F.lit(role).alias("role"), text.alias("content")).cast(message),
            )

        return F.coalesce(as_role("Human:", "user"), as_role("Assistant:", "assistant"))

    turns = F.transform(F.split(prompt, "\n\n", -1), turn)
    return F.filter(turns, lambda m: m.isNotNull())


def all_content(req: Column) -> Column:
    """Contents in message order, then the system prompt if there is one."""
    contents = F.transform(req["messages"], lambda m: m["content"])
    return F.concat(contents, F.array_compact(F.array(req["system_prompt"])))
