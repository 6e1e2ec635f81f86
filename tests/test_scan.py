"""Findings, types and redaction against brute force."""

import json
import random
import tracemalloc

import pyarrow as pa
import regex
from pyspark.sql import functions as F

from reqguard.functions import detect as D
from reqguard.functions import patterns as P
from reqguard.operators import scan as S

WORD = r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\p{Join_Control}]"
BOUNDARY = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def brute_spans(text):
    spans = []
    for name, p in P.PII_PATTERNS:
        p = p.replace(r"[-.\s]", r"[-.\p{White_Space}]").replace(r"[-\s]", r"[-\p{White_Space}]")
        p = p.replace(r"\d", r"\p{Nd}").replace(r"\b", BOUNDARY)
        for m in regex.finditer(p, text):
            if name != "ip-address" or not m.group().startswith(P.SKIPPED_IP_PREFIXES):
                at = [len(text[:k].encode()) for k in m.span()]
                spans.append((at[0], at[1], name, m.group()))
    return sorted(spans, key=lambda s: s[0])


def noise(rng):
    bits = [
        "a@b.co", "x.y+z@mail.example.org", "a@b.co9x@d.com", "@", "é", " ", ", ", "123-45-6789", "1123-45-6789",
        "555-123-4567", "(555) 123-4567", "+1 555.123.4567", "x(555)123-4567", "x+1-555-123-4567", "5551234567",
        "4111-1111-1111-1111", "4111 1111 1111 1111", "41111111111111112", "8.8.8.8", "10.0.0.1", "256.1.1.1",
        "1.2.3.199x", "127.0.0.1", "192.168.1.1", "172.16.0.1", "0.1.2.3", "١٢٣-45-6789", " ", "\n", "z",
    ]
    return "".join(rng.choices(bits, k=rng.randrange(1, 9)))


def test_findings_types_and_redaction(spark):
    rng = random.Random(11)
    texts = [noise(rng) for _ in range(3000)] + ["", "é a@b.co, 555-123-4567@x.com 8.8.8.8"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = {i: brute_spans(t) for i, t in enumerate(texts)}
    got = {}
    for r in S.pii_findings(df, "id").orderBy("id", "position").collect():
        got.setdefault(r.id, []).append((r.start, r.end, r.pii_type, r.matched))
    assert got == {i: s for i, s in want.items() if s}
    flags = {r.id: r for r in S.with_flags(df).collect()}
    for i, spans in want.items():
        types = [n for n in P.PII_TYPES if n in {s[2] for s in spans}]
        assert flags[i].pii_types == types
        assert flags[i].has_pii == any(t != "ip-address" for t in types)

    for r in S.redact_table(df).collect():
        data, out, end, n = texts[r.id].encode(), b"", 0, 0
        for a, b, name, _ in want[r.id]:
            if a >= end:
                out += data[end:a] + P.PII_LABELS[name].encode()
                end, n = b, n + 1
        assert (r.text, r.redactions) == ((out + data[end:]).decode(), n)


def test_known_texts(spark):
    cases = {
        "write to desk@shop.example today": ["email"],
        "file 219-09-9999 is closed": ["ssn"],
        "ring 555-867-5309": ["phone"],
        "paid with 5500-0000-0000-0004": ["credit-card"],
        "rain is due by noon": [],
        "server 8.8.4.4 and 10.1.2.3": ["ip-address"],
    }
    df = spark.createDataFrame([(t,) for t in cases], "text string")
    assert {r.text: r.pii_types for r in S.with_flags(df).collect()} == cases
    redacted = S.redact_table(
        spark.createDataFrame([("to desk@shop.example, file 219-09-9999", 1), (None, 2)], "text string, id int")
    )
    assert {r.id: r.text for r in redacted.collect()} == {1: "to [EMAIL REDACTED], file [SSN REDACTED]", 2: None}


def test_long_runs_are_linear(spark):
    """A megabyte without an "@" after a hit must not be searched from every position."""
    text = "a@b.co " + "x" * 1_000_000 + " 123-45-6789"
    df = spark.createDataFrame([(text,)], "text string")
    assert [r.pii_type for r in S.pii_findings(df).collect()] == ["email", "ssn"]
    assert S.with_flags(df).select(F.array_join("pii_types", ",")).first()[0] == "email,ssn"
    assert S.with_flags(df, engine="jvm").select("has_pii").first()[0]


def test_finding_counts(spark):
    df = spark.createDataFrame([("8.8.8.8 standard",), ("a@b.co",), ("<system> a@b.co",)], "text string")
    got = {r.finding: r.texts for r in S.finding_counts(df).collect()}
    assert got == {"ip-address": 1, "jailbreak-attempt": 1, "email": 2, "prompt-injection": 1}


def written(rng, text):
    """A JSON string with escapes by lot."""
    out = ""
    for c in text:
        units = [c.encode("utf-16-be")[k : k + 2].hex() for k in range(0, 2 * len(c.encode("utf-16-be")) // 2, 2)]
        if rng.random() < 0.15 or c in '"\\' or ord(c) < 32:
            out += json.dumps(c)[1:-1] if rng.random() < 0.5 else "".join(rng.choice([f"\\u{u}", f"\\u{u.upper()}"]) for u in units)
        else:
            out += "\\/" if c == "/" and rng.random() < 0.5 else c
    return f'"{out}"'


def brute_redacted(raw):
    """The inside of a JSON string, a character at a time, with its matches replaced."""
    cells, k = [], 0
    while k < len(raw):
        n = 1
        if raw[k] == "\\":
            n = 6 if raw[k + 1] == "u" else 2
            pair = raw[k : k + 12]
            if n == 6 and len(pair) == 12 and pair[6:8] == "\\u" and len(json.loads(f'"{pair}"')) == 1:
                n = 12
        cells.append(raw[k : k + n])
        k += n
    said = [json.loads(f'"{c}"') for c in cells]
    starts = [len("".join(said[:i]).encode()) for i in range(len(said) + 1)]
    out, end, n = "", 0, 0
    for a, b, name, _ in brute_spans("".join(said)):
        a, b = starts.index(a), starts.index(b)
        if a >= end:
            out += "".join(cells[end:a]) + P.PII_LABELS[name]
            end, n = b, n + 1
    return out + "".join(cells[end:]), n


def test_bodies_are_redacted_in_place(spark):
    rng = random.Random(29)
    bodies, want = [], []
    for _ in range(1500):
        out, edited, count = "", "", 0
        for part in range(rng.randrange(1, 4)):
            text = noise(rng) + rng.choice(["", "\n", '"', "/", "\\", "😀", "\t555-123-4567"])
            name, value = written(rng, noise(rng) + str(part)), written(rng, text)
            new, n = brute_redacted(value[1:-1])
            space = rng.choice(["", " ", "\n\t"])
            head = f'{"," if part else ""}{space}{name}{space}:{space}'
            nested = rng.random() < 0.3
            out += head + (f"[ {value},5551234567]" if nested else value)
            edited += head + (f'[ "{new}",5551234567]' if nested else f'"{new}"')
            count += n
        bodies.append("{" + out + "}")
        want.append(("{" + edited + "}", count))
    for odd in (None, "", "{}", "[]", '"mail a@b.co"', "not json a@b.co", '{"a":"x', '{"a":"b"} trailing c@d.org'):
        bodies.append(odd)
        text, n = odd, 0
        if odd and "@" in odd:
            text, n = {
                '"mail a@b.co"': ('"mail [EMAIL REDACTED]"', 1),
                "not json a@b.co": ("not json [EMAIL REDACTED]", 1),
            }.get(odd, ('{"a":"b"} trailing [EMAIL REDACTED]', 1))
        want.append((text, n))
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body string").withColumn("text", F.lit("own"))
    out = S.redact_bodies(df)
    assert out.columns == [*df.columns, "redactions"]
    got = {r.id: (r.body, r.redactions) for r in out.collect()}
    assert [got[i] for i in range(len(bodies))] == want
    assert sum(n for _, n in want) > 500
    for body, _ in want[:1500]:
        json.loads(body)
    broken = spark.range(1).select(F.unhex(F.lit("7B22FF")).cast("string").alias("body"))
    assert S.redact_bodies(broken).select(F.hex("body"), "redactions").first()[:] == ("7B22FF", 0)
    assert S.redact_bodies(df.limit(0)).count() == 0


def test_findings_of_a_batch_take_little_more_than_the_batch():
    line = "write to kim@post.example or call 219-09-9999 " + "and so on " * 100
    texts = pa.array([line * 20, None, "nothing here"] * 1_000)
    size = sum(len(t or "") for t in texts.to_pylist())
    for work in (D.pii_spans.func, D.redacted.func, D.redacted_json.func):
        tracemalloc.start()
        try:
            found = work(texts)
            most = tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()
        # Python objects are made for about a megabyte of text at a time.
        assert len(found) == len(texts) and most < 12 * D.PART_BYTES < size
    found = D.pii_spans.func(texts).to_pylist()
    assert [len(f) for f in found[:3]] == [40, 0, 0] and found[0] == found[-3]
    assert found[0][2] == {"pii_type": "email", "start": len(line) + 9, "end": len(line) + 25, "matched": "kim@post.example"}


def test_findings_read_a_text_in_one_python_worker(spark):
    df = spark.createDataFrame([(1, "kim@post.example"), (2, None), (3, "")], "id int, text string")
    found = S.pii_findings(df, "id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert [tuple(r) for r in found.collect()] == [(1, 0, "email", 0, 16, "kim@post.example")]
