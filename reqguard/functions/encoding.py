"""Body encoding: strict base64 and UTF-8 checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode_base64_strict(data: Column) -> Column:
    """Bytes of a standard base64 text, or NULL unless it is canonical.

    Spark's decoder tolerates missing padding, white space and stray trailing bits; encoding the
    result again tells those apart.  The encoder wraps long output at 76 columns, so the line
    breaks are removed before comparing.
    """
    decoded = F.try_to_binary(data, F.lit("base64"))
    canonical = F.replace(F.base64(decoded), F.lit("\r\n"), F.lit(""))
    return F.when(canonical == data, decoded)


def is_utf8(text: Column) -> Column:
    """Whether the bytes of a string are valid UTF-8; NULL counts as the empty string."""
    return F.coalesce(F.is_valid_utf8(text), F.lit(True))
