"""Content scanning and redaction over any table with a text column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import detect as D
from ..functions import patterns as P
from ..functions import providers as PV


def with_flags(df: DataFrame, text: str = "text", engine: str = "arrow") -> DataFrame:
    """Add ``injection``, ``jailbreak`` (booleans), ``pii_types`` (array) and ``has_pii``.

    ``engine`` picks how the one full pass over the text is made: ``arrow`` (default) or ``jvm``
    (built-in expressions only).  Both give the same flags.
    """
    source = F.col(text)
    mask = D.scan_mask(source) if engine == "arrow" else D.jvm_scan_mask(source)
    return (
        df.withColumn("_mask", mask)
        .withColumns(
            {
                "injection": D.has_bit(F.col("_mask"), D.INJECTION_BIT),
                "jailbreak": D.has_bit(F.col("_mask"), D.JAILBREAK_BIT),
                "pii_types": D.pii_types(source, D.has_bit(F.col("_mask"), D.PII_BIT)),
            }
        )
        .withColumn("has_pii", D.has_pii(F.col("pii_types")))
        .drop("_mask")
    )


def pattern_hits(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """One row per text and matching rule: keys, family, pattern_id, category.

    Single rules are tried only on texts that the family flag marks.
    """
    source = F.col(text)
    any_family = F.lit(D.INJECTION_BIT | D.JAILBREAK_BIT)
    marked = df.select(*keys, source.alias("_text"), D.scan_mask(source).alias("_mask"))
    marked = marked.where(F.col("_mask").bitwiseAND(any_family) != 0)
    rules = F.array(
        *[
            F.struct(F.lit(f).alias("family"), F.lit(i).alias("pattern_id"), F.lit(c).alias("category"))
            for f, i, c in D.RULES
        ]
    )
    numbers = marked.select(*keys, F.explode(D.rule_numbers("_text", "_mask")).alias("_n"))
    return numbers.select(*keys, F.get(rules, F.col("_n")).alias("_r")).select(*keys, "_r.*")


def pii_findings(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """One row per match: keys, position in the text's findings, type, byte span, matched text."""
    return df.select(*keys, F.posexplode(D.pii_spans(F.col(text))).alias("position", "_s")).select(
        *keys, "position", "_s.pii_type", "_s.start", "_s.end", "_s.matched"
    )


def finding_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Counts of texts by family: injection, jailbreak, and each personal-data type."""
    flagged = with_flags(df, text)
    names = F.concat(
        F.array_compact(
            F.array(
                F.when(F.col("injection"), F.lit(P.INJECTION)), F.when(F.col("jailbreak"), F.lit(P.JAILBREAK))
            )
        ),
        F.col("pii_types"),
    )
    return flagged.select(F.explode(names).alias("finding")).groupBy("finding").agg(
        F.count(F.lit(1)).alias("texts")
    )


def redact_table(df: DataFrame, text: str = "text", count: str = "redactions") -> DataFrame:
    """Same rows with personal data in ``text`` replaced by labels, and the number replaced.

    Only texts that the scan marks are sent to the rewriting step; the others pass through.
    """
    source = F.col(text)
    is_candidate = D.has_bit(F.col("_mask"), D.PII_BIT)
    out = df.withColumn("_mask", D.scan_mask(source)).withColumn(
        "_r", D.redacted(F.when(is_candidate, source))
    )
    return out.withColumns(
        {
            text: F.when(is_candidate, F.col("_r.text")).otherwise(source),
            count: F.coalesce(F.col("_r.replaced"), F.lit(0)),
        }
    ).drop("_mask", "_r")


def redact_bodies(requests: DataFrame, body: str = "body", count: str = "redactions") -> DataFrame:
    """Same rows with personal data in the string values of JSON bodies replaced by labels, and the number replaced.

    Bodies are edited where they stand: every other character stays as it was, escapes and spacing
    included, and a JSON document stays one.  A match is looked for in what a string says, so one
    written with escapes is found; names of members, numbers and text across two strings are left.
    A body that is not one JSON document is treated as plain text.  NULL stays NULL; a body that is
    not valid UTF-8 is not read and stays as it is.
    """
    source = F.col(body)
    text = F.when(F.is_valid_utf8(source), source)
    is_json = F.col("_json")
    candidate = D.has_bit(F.col("_mask"), D.PII_BIT)
    out = requests.withColumn("_text", text).withColumn("_json", PV.is_one_value(F.col("_text")))
    out = out.withColumn("_mask", F.when(is_json, D.json_scan_mask(F.col("_text"))).otherwise(D.scan_mask(F.col("_text"))))
    out = out.withColumns(
        {
            "_r": D.redacted_json(F.when(candidate & is_json, F.col("_text"))),
            "_p": D.redacted(F.when(candidate & ~is_json, F.col("_text"))),
        }
    )
    new = F.when(is_json, F.col("_r.text")).otherwise(F.col("_p.text"))
    return out.withColumns(
        {
            body: F.when(candidate, new).otherwise(source),
            count: F.coalesce(F.col("_r.replaced"), F.lit(0)) + F.coalesce(F.col("_p.replaced"), F.lit(0)),
        }
    ).drop("_text", "_json", "_mask", "_r", "_p")
