"""Text detection: injection and jailbreak flags, personal-data types, spans and redaction.

One vectorised pass (``scan_mask``) reads every text once with Arrow's linear-time RE2 kernels and
returns a small bit mask; everything costlier runs only on the texts that the mask points at.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import patterns as P

INJECTION_BIT, JAILBREAK_BIT, PII_BIT = 1, 2, 4

# Texts of one request are joined by NUL before scanning.  No pattern can match a NUL, and NUL is
# neither a space nor a word character, so the joined text hits iff one of its parts does.
SEPARATOR = "\u0000"

_INJECTION_RE2 = P.re2_any([p for _, p in P.INJECTION_PATTERNS])
_JAILBREAK_RE2 = P.re2_any([p for _, p in P.JAILBREAK_PATTERNS])
_PII_RE2 = P.re2_candidates([p for _, p in P.PII_PATTERNS])
_INJECTION_JAVA = P.java_any([p for _, p in P.INJECTION_PATTERNS])
_JAILBREAK_JAVA = P.java_any([p for _, p in P.JAILBREAK_PATTERNS])

SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("pii_type", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("matched", T.StringType()),
        ]
    )
)
REDACTED = T.StructType([T.StructField("text", T.StringType()), T.StructField("replaced", T.IntegerType())])


@F.arrow_udf(T.IntegerType())
def scan_mask(text: pa.Array) -> pa.Array:
    """Bits: injection (exact), jailbreak (exact), personal data (candidate).  NULL stays NULL."""

    def bit(regex: str, value: int) -> pa.Array:
        hits = pc.match_substring_regex(text, regex).cast(pa.int32())
        return pc.multiply(hits, pa.scalar(value, pa.int32()))

    mask = pc.add(bit(_INJECTION_RE2, INJECTION_BIT), bit(_JAILBREAK_RE2, JAILBREAK_BIT))
    return pc.add(mask, bit(_PII_RE2, PII_BIT))


def jvm_scan_mask(text: Column) -> Column:
    """The same mask from built-in expressions only (no Python worker, several times slower)."""
    pii = F.lit(False)
    for name in P.PII_TYPES:
        pii = pii | text.rlike(P.JAVA_PII[name])
    return (
        F.when(text.rlike(_INJECTION_JAVA), INJECTION_BIT).otherwise(0)
        + F.when(text.rlike(_JAILBREAK_JAVA), JAILBREAK_BIT).otherwise(0)
        + F.when(pii, PII_BIT).otherwise(0)
    )


def has_bit(mask: Column, bit: int) -> Column:
    """Whether a mask carries a bit; a NULL mask (text not scanned) carries none."""
    return F.coalesce(mask.bitwiseAND(F.lit(bit)) != 0, F.lit(False))


def _is_public_ip(ip: Column) -> Column:
    skipped = F.lit(False)
    for prefix in P.SKIPPED_IP_PREFIXES:
        skipped = skipped | ip.startswith(prefix)
    return ~skipped


def pii_types(text: Column, candidate: Column) -> Column:
    """Distinct personal-data types of a text, in type order; empty unless ``candidate``."""
    hits = []
    for name in P.PII_TYPES:
        regex = P.JAVA_PII[name]
        if name == "ip-address":
            hit = F.exists(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), _is_public_ip)
        else:
            hit = text.rlike(regex)
        hits.append(F.when(hit, F.lit(name)))
    found = F.array_compact(F.array(*hits))
    return F.when(candidate, found).otherwise(F.array().cast("array<string>"))


def has_pii(types: Column) -> Column:
    """Email, social security number, phone or card; an address alone does not count."""
    return F.exists(types, lambda t: t != "ip-address")


_RULE_RE2 = (
    (INJECTION_BIT, [P.re2_any([p]) for _, p in P.INJECTION_PATTERNS]),
    (JAILBREAK_BIT, [P.re2_any([p]) for _, p in P.JAILBREAK_PATTERNS]),
)

# All rules in one list: families in order, then patterns in order.
RULES: list[tuple[str, int, str]] = [
    (family, i, category)
    for family, patterns in ((P.INJECTION, P.INJECTION_PATTERNS), (P.JAILBREAK, P.JAILBREAK_PATTERNS))
    for i, (category, _) in enumerate(patterns)
]


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def rule_numbers(text: pa.Array, mask: pa.Array) -> pa.Array:
    """Positions in ``RULES`` of the rules each text matches, for the families its mask marks."""
    rows, numbers, first = [], [], 0
    for bit, regexes in _RULE_RE2:
        marked = pc.not_equal(pc.bit_wise_and(mask, pa.scalar(bit, pa.int32())), 0)
        at = pc.indices_nonzero(pc.fill_null(marked, False))
        part = text.take(at)
        for i, regex in enumerate(regexes):
            hits = pc.indices_nonzero(pc.match_substring_regex(part, regex))
            rows.append(at.take(hits).to_numpy().astype(np.int64))
            numbers.append(np.full(len(hits), first + i, np.int32))
        first += len(regexes)
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    offsets = np.searchsorted(row[order], np.arange(len(text) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(numbers)[order]))


_LOCAL_EDGE = re.compile(rf"(?<!{P.EMAIL_LOCAL})")
_EMAIL = re.compile(P.PII_PATTERNS[0][1].replace("+@", "++@"))
_EMAIL_AT_RUN_START = re.compile(_LOCAL_EDGE.pattern + _EMAIL.pattern)


def _email_matches(text: str) -> Iterator[re.Match[str]]:
    """Left-to-right matches; a search starts only at run starts, or where the last match ended."""
    pos = 0
    while m := _EMAIL.match(text, pos) or _EMAIL_AT_RUN_START.search(text, pos):
        yield m
        pos = m.end()


def _bounded_matches(text: str, regex: re.Pattern[str]) -> Iterator[re.Match[str]]:
    """Matches between word boundaries, left to right.

    Each of these patterns matches at most one way from a given start, so testing the boundaries
    after the match finds what the pattern with its boundaries would.
    """

    def boundary(at: int) -> bool:
        before = at > 0 and P.is_word(text[at - 1])
        return before != (at < len(text) and P.is_word(text[at]))

    pos = 0
    while m := regex.search(text, pos):
        if boundary(m.start()) and boundary(m.end()):
            yield m
            pos = m.end()
        else:
            pos = m.start() + 1


def _text_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(character start, end, type, matched), by start and then by type order."""
    spans = []
    for name, regex in P.PYTHON_PII.items():
        for m in _email_matches(text) if name == "email" else _bounded_matches(text, regex):
            if name != "ip-address" or not m.group().startswith(P.SKIPPED_IP_PREFIXES):
                spans.append((m.start(), m.end(), name, m.group()))
    return sorted(spans, key=lambda s: s[0])


def _byte_offsets(text: str, positions: list[int]) -> dict[int, int]:
    offsets, at, total = {}, 0, 0
    for p in sorted(set(positions)):
        total += len(text[at:p].encode("utf-8", "surrogatepass"))
        at = p
        offsets[p] = total
    return offsets


# Text whose values and matches are Python objects at once; a longer single text stands alone.
PART_BYTES = 1 << 20


def _by_parts(work: Callable[[pa.Array], pa.Array], text: pa.Array) -> pa.Array:
    """``work`` on parts of a batch, so that what is made of it takes no multiple of the batch's room."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(text), 0), np.int64)
    edges = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // PART_BYTES)) + 1).tolist(), len(text)]
    return pa.concat_arrays([work(text.slice(a, b - a)) for a, b in zip(edges, edges[1:])])


@F.arrow_udf(SPANS)
def pii_spans(text: pa.Array) -> pa.Array:
    """Matches of every detector with byte offsets, sorted by start, ties in type order.

    Only texts that may hold some are searched; the others, and NULL, have none.
    """
    return _by_parts(_spans, text)


def _spans(text: pa.Array) -> pa.Array:
    out = []
    for value, hit in zip(text, pc.match_substring_regex(text, _PII_RE2).to_pylist()):
        if not hit:
            out.append([])
            continue
        value = value.as_py()
        spans = _text_spans(value)
        at = _byte_offsets(value, [p for s in spans for p in s[:2]])
        out.append(
            [{"pii_type": n, "start": at[a], "end": at[b], "matched": m} for a, b, n, m in spans]
        )
    span = pa.struct(
        [("pii_type", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("matched", pa.string())]
    )
    return pa.array(out, pa.list_(span))


@F.arrow_udf(REDACTED)
def redacted(text: pa.Array) -> pa.Array:
    """Text with each match replaced by its label, and how many were.

    Where matches overlap, the earliest start wins, then detector order; the others are dropped.
    """
    return _by_parts(_redacted, text)


def _redacted(text: pa.Array) -> pa.Array:
    texts, counts = [], []
    for value in text.to_pylist():
        if value is None:
            texts.append(None)
            counts.append(0)
            continue
        pieces, end, replaced = [], 0, 0
        for a, b, name, _ in _text_spans(value):
            if a >= end:
                pieces += [value[end:a], P.PII_LABELS[name]]
                end = b
                replaced += 1
        texts.append("".join(pieces) + value[end:])
        counts.append(replaced)
    return pa.StructArray.from_arrays(
        [pa.array(texts, pa.string()), pa.array(counts, pa.int32())], ["text", "replaced"]
    )


# A JSON string and, after the name of a member, its colon.
_LITERAL = re.compile(r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"([ \t\n\r]*+:)?', re.S)
_ESCAPE = re.compile(
    r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\.", re.S
)
_ESCAPED = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


def _unescaped(escape: str) -> str:
    if len(escape) == 2:
        return _ESCAPED.get(escape[1], escape[1])
    return bytes.fromhex(escape.replace("\\u", "")).decode("utf-16-be", "surrogatepass")


def _decoded(raw: str) -> tuple[str, list[int], list[int]]:
    """What the inside of a JSON string says, and where its pieces start, there and in ``raw``."""
    pieces, at, raw_at = [], [0], [0]
    length = end = 0
    for m in _ESCAPE.finditer(raw):
        character = _unescaped(m.group())
        pieces += [raw[end : m.start()], character]
        length += m.start() - end
        end = m.end()
        at += [length, length + 1]
        raw_at += [m.start(), end]
        length += 1
    return "".join(pieces) + raw[end:], at, raw_at


def _json_spans(body: str) -> list[tuple[int, int, str]]:
    """(start, end, label) in a JSON text of what is replaced in the string values it holds."""
    found = []
    for literal in _LITERAL.finditer(body):
        raw = literal[1]
        if literal[2] or not raw:
            continue
        value, at, raw_at = _decoded(raw) if "\\" in raw else (raw, [0], [0])
        end = 0
        for a, b, name, _ in _text_spans(value):
            if a >= end:
                i, j = bisect_right(at, a) - 1, bisect_right(at, b) - 1
                start = literal.start(1)
                found.append((start + raw_at[i] + a - at[i], start + raw_at[j] + b - at[j], P.PII_LABELS[name]))
                end = b
    return found


@F.arrow_udf(REDACTED)
def redacted_json(body: pa.Array) -> pa.Array:
    """JSON texts with each match within a string value replaced by its label, and how many were."""
    return _by_parts(_redacted_json, body)


def _redacted_json(body: pa.Array) -> pa.Array:
    texts, counts = [], []
    for value in body.to_pylist():
        spans = _json_spans(value) if value is not None else []
        if spans:
            edges = [0, *[b for _, b, _ in spans]]
            pieces = [value[edge:a] + label for edge, (a, _, label) in zip(edges, spans)]
            value = "".join(pieces) + value[edges[-1] :]
        texts.append(value)
        counts.append(len(spans))
    return pa.StructArray.from_arrays(
        [pa.array(texts, pa.string()), pa.array(counts, pa.int32())], ["text", "replaced"]
    )


def json_scan_mask(body: Column) -> Column:
    """``scan_mask`` of a JSON text whose personal-data bit is set if one of its strings may hold some.

    An escape stands for one character that is no part of a match but, at most, the white space in
    one; where escapes may stand for any character, the bit is set.
    """
    plain = F.regexp_replace(body, r"(?s)\\.", " ")
    return F.when(body.contains("\\u"), F.lit(PII_BIT)).otherwise(scan_mask(plain))
