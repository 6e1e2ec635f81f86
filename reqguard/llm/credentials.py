"""Secret scans: single credentials, and credentials whose parts stand apart in a text.

A credential often has several parts: an identifier that says who, a secret, and an endpoint it is
for.  Taken alone, an identifier, a random-looking string or an address is weak evidence.  Parts are
joined when they lie in one scope: a run of lines without an empty line between them, and at most
``REACH`` characters apart.  Within a scope the join goes over intervals in order of their start: the
secret of each identifier or endpoint is its nearest, so that a scope with n parts gives n links at
most and never n squared.  A weak candidate is reported only when a part of a complementary kind
stands in its scope.

A document's parts never leave the task that scans it, and texts never move.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

# --- Fixed values: kinds and their patterns ------------------------------------------------------
# Single credentials.  Letters of the key words are taken in either case, ASCII only.
ASSIGN = re.compile(
    r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
# Weak candidates: identifiers, secrets and endpoints.
IDENTIFIER = re.compile(
    r"""(?ai:\b(?:user(?:_?name)?|login|account(?:_?id)?|client_?id|access_?key(?:_?id)?|key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]{3,})"""
)
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"""(?ai:(?:https?|wss?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://)[^\s"'<>]{4,}""")
# What RE2 looks for first: texts without any of these have no span.
FIRST = (
    r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]|(?-i)AKIA[A-Z0-9]{16}|[0-9a-f]{24}"""
    r"""|[A-Za-z0-9+/_-]{32}|(?i)://|(user|login|account|client|key)[a-z_]*["']?\x20*[:=]"""
)
# --- end of fixed values -------------------------------------------------------------------------
#: In this order spans of one start are listed.
KINDS = ("assign", "access", "hex", "identifier", "random", "endpoint")
_ROLE = {"access": "who", "identifier": "who", "assign": "secret", "hex": "secret", "random": "secret", "endpoint": "where"}
# A scope is a block of lines: an empty line ends it.
_SCOPE_END = re.compile(r"\n[\x20\t\r]*\n")

SCHEMA = (
    "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string,"
    " n_linked bigint, links string"
)

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Single credentials: leftmost matches of each kind that do not overlap within the kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def _mixed(s: str) -> bool:
    """Letters of both cases and digits, as encoded random bytes have."""
    return any(c.islower() for c in s) and any(c.isupper() for c in s) and any(c.isdigit() for c in s)


def weak_spans(text: str, base: list[Span]) -> list[Span]:
    """Candidates that mean something only next to others; those within a single credential are left out."""
    found = [(m.start(), m.end(), "identifier") for m in IDENTIFIER.finditer(text)]
    found += [(m.start(), m.end(), "random") for m in RANDOM.finditer(text) if _mixed(m.group())]
    found += [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)]
    if not found or not base:
        return found
    taken = sorted((s, e) for s, e, _ in base)
    starts = np.array([s for s, _ in taken])
    ends = np.maximum.accumulate(np.array([e for _, e in taken]))
    at = np.searchsorted(starts, [e for _, e, _ in found])
    return [x for x, k in zip(found, at, strict=True) if not (k and ends[k - 1] > x[0])]


def link(text: str, spans: list[Span]) -> list[tuple[Span, Span]]:
    """Pairs (identifier or endpoint, secret): the nearest complementary part in the scope.

    The interval join: a part's interval is its whole scope, however long.  Parts stand in order of
    start; for every part that is not a secret the nearest secret before and after it is looked up
    by bisection, and likewise an owner for every secret, so each part costs a logarithm.
    """
    secrets = sorted(x for x in spans if _ROLE[x[2]] == "secret")
    others = sorted(x for x in spans if _ROLE[x[2]] != "secret")
    if not secrets or not others:
        return []
    cuts = np.array([m.start() for m in _SCOPE_END.finditer(text)])

    def nearest(of: list[Span], among: list[Span]) -> list[Span | None]:
        starts = np.array([x[0] for x in among])
        # Of those that begin before, the one that reaches furthest.
        furthest = np.maximum.accumulate(np.array([x[1] for x in among]))
        owner = np.zeros(len(among), np.int64)
        for i in range(1, len(among)):
            owner[i] = i if among[i][1] >= furthest[i] else owner[i - 1]
        out: list[Span | None] = []
        for x, k in zip(of, np.searchsorted(starts, [x[0] for x in of]), strict=True):
            options = [among[owner[k - 1]]] if k else []
            options += [among[k]] if k < len(among) else []
            fit = []
            for y in options:
                gap = max(y[0] - x[1], x[0] - y[1], 0)
                lo, hi = min(x[1], y[1]), max(x[0], y[0])
                parted = len(cuts) and np.searchsorted(cuts, lo) != np.searchsorted(cuts, hi)
                if not parted:
                    fit.append((gap, y))
            out.append(min(fit)[1] if fit else None)
        return out

    pairs = {(x, y) for x, y in zip(others, nearest(others, secrets), strict=True) if y}
    pairs |= {(y, x) for x, y in zip(secrets, nearest(secrets, others), strict=True) if y}
    return sorted(pairs)


def _joined(spans: list[Span]) -> str:
    order = sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in order)


def scan_text(text: str) -> tuple[int, int, int, str, str, int, str]:
    base = base_spans(text)
    pairs = link(text, base + weak_spans(text, base))
    linked = {x for pair in pairs for x in pair}
    listed = _joined(base)
    every = _joined(list(set(base) | linked))
    kinds = [k for _, _, k in base]
    return (
        kinds.count("assign"),
        kinds.count("access"),
        kinds.count("hex"),
        hashlib.sha256(listed.encode()).hexdigest(),
        every,
        len(pairs),
        ",".join(f"{a[2]}:{a[0]}-{b[2]}:{b[0]}" for a, b in pairs),
    )


_NOTHING = scan_text("")


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = (*[pa.int64()] * 3, pa.string(), pa.string(), pa.int64(), pa.string())
    for batch in batches:
        for lo, hi in slices(batch.column(1), 4_000_000):
            texts = pc.fill_null(batch.column(1).slice(lo, hi - lo), "")
            hit = pc.match_substring_regex(texts, FIRST)
            rows = [_NOTHING] * len(texts)
            for i in np.flatnonzero(np.asarray(hit)).tolist():
                rows[i] = scan_text(texts[i].as_py())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns], names)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: counts, digest and list of spans, links between parts.

    Spans are ``kind:start:end`` in code points, end exclusive, by start, then kind.  ``spans`` has
    the single credentials and the weak candidates that have a partner; ``links`` names the pairs.
    A null or empty text has no spans.  Ids may be null or repeated; other columns are not read; an
    empty table gives no rows.
    """
    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(_scanned, SCHEMA)
