"""DuckDB statements of the registered queries, written against the given tables.

They never see the JSON bodies: what the jobs must find is derived from the tables and from the
key arithmetic of the request log.
"""

from __future__ import annotations

from reqguard.functions import patterns as P
from reqguard.sources import corpus as C


def _lit(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def _pick(index: str, values: tuple) -> str:
    arms = " ".join(
        f"WHEN {i} THEN {v if isinstance(v, int) else _lit(v)}" for i, v in enumerate(values) if v is not None
    )
    return f"CASE {index} {arms} END"


INJECTION_RE = "(?i)(" + "|".join(p for _, p in P.INJECTION_PATTERNS) + ")"
JAILBREAK_RE = "(?i)(" + "|".join(p for _, p in P.JAILBREAK_PATTERNS) + ")"
PII_RE = dict(P.PII_PATTERNS)
_SEED_CASE = "CASE (k // 6) % 12 " + " ".join(f"WHEN {n} THEN {_lit(t)}" for n, t in C.SEEDS.items()) + " END"


def _has(defect: str) -> str:
    return f"d = {C.DEFECTS[defect]}"


# Every request with what parsing must yield.
TRUTH = f"""
WITH keyed AS (
  SELECT 'c' || conv_id || '-' || turn AS request_id, conv_id * 31 + turn AS k, role, text
  FROM conversations
  UNION ALL
  SELECT 'd' || doc_id, doc_id, 'user', text FROM documents
), drawn AS (
  SELECT request_id, k, role AS row_role, text, {_SEED_CASE} AS seed, (k // 5) % 17 AS d,
         {_pick('k % 6', C.PROVIDERS)} AS provider, {_pick('k % 6', C.URIS)} AS uri,
         {_pick('(k // 3) % 8', C.MODELS)} AS row_model,
         CAST({_pick('k % 5', C.MAX_TOKENS)} AS BIGINT) AS row_max,
         make_timestamp(({C.BASE_EPOCH} + k * {C.SECONDS_PER_KEY}) * 1000000) AS ts,
         '203.0.113.' || (k % {C.CLIENTS}) AS client_ip
  FROM keyed
), shaped AS (
  SELECT *,
         provider = 'anthropic' AS is_anthropic,
         k % 4 = 0 AS with_system,
         CASE WHEN {_has('bad-role')} THEN 'hacker' ELSE row_role END AS role1,
         CASE WHEN {_has('parts')} THEN text || ' end of parts' ELSE text END AS text1,
         text || coalesce(' ' || seed, '') AS prompt_text,
         {_has('prompt-only')} AS legacy,
         NOT ({_has('null-content')} OR {_has('trailing-text')} OR {_has('prompt-array')}
              OR {_has('fractional-max-tokens')} OR {_has('no-messages')} OR {_has('not-an-object')}
              OR {_has('bad-part')} OR {_has('model-twice')} OR ({_has('numeric-system')} AND provider = 'anthropic')) AS parsed
  FROM drawn
), parts AS (
  SELECT *,
         CASE
           WHEN legacy AND is_anthropic THEN list_filter([
             {{'role': 'user', 'content': trim(split_part(prompt_text, chr(10) || chr(10), 1), chr(10) || ' ')}},
             {{'role': 'assistant', 'content': 'noted'}}], lambda m: m.content <> '')
           WHEN legacy THEN [{{'role': 'user', 'content': prompt_text}}]
           ELSE list_filter([
             {{'role': 'system', 'content': CASE WHEN with_system AND NOT is_anthropic THEN {_lit(C.SYSTEM_TEXT)} END}},
             {{'role': role1, 'content': text1}},
             {{'role': 'user', 'content': seed}}], lambda m: m.content IS NOT NULL)
         END AS messages,
         CASE
           WHEN is_anthropic AND with_system AND (k // 4) % 2 = 0 THEN {_lit(C.SYSTEM_TEXT)}
           WHEN is_anthropic AND with_system THEN 'You are careful.'
           WHEN is_anthropic OR legacy THEN NULL
           WHEN role1 = 'system' THEN text1
           WHEN with_system THEN {_lit(C.SYSTEM_TEXT)}
         END AS system_prompt
  FROM shaped
), truth AS (
  SELECT *, row_model AS model, row_max AS max_tokens,
         CAST(ceil((list_sum(list_transform(messages, lambda m: strlen(m.content) + strlen(m.role)))
               + coalesce(strlen(system_prompt), 0)) / 4.0) AS BIGINT) AS tokens,
         list_concat(list_transform(messages, lambda m: m.content),
                     CASE WHEN system_prompt IS NULL THEN [] ELSE [system_prompt] END) AS contents
  FROM parts
), costed AS (
  SELECT *, tokens::DOUBLE / 1000.0::DOUBLE * CASE
      WHEN provider = 'openai' AND contains(model, 'gpt-4o') THEN 0.005::DOUBLE
      WHEN provider = 'openai' AND contains(model, 'gpt-4-turbo') THEN 0.01::DOUBLE
      WHEN provider = 'openai' AND contains(model, 'gpt-4') THEN 0.03::DOUBLE
      WHEN provider = 'openai' AND contains(model, 'gpt-3.5') THEN 0.0005::DOUBLE
      WHEN provider = 'anthropic' AND contains(model, 'opus') THEN 0.015::DOUBLE
      WHEN provider = 'anthropic' AND contains(model, 'sonnet') THEN 0.003::DOUBLE
      WHEN provider = 'anthropic' AND contains(model, 'haiku') THEN 0.00025::DOUBLE
      ELSE 0.01::DOUBLE END AS cost,
    array_to_string(contents, chr(1)) AS scan_text
  FROM truth
)
"""

_TEXTS = f"""
WITH keyed AS (
  SELECT 'c' || conv_id || '-' || turn AS request_id, conv_id * 31 + turn AS k, text FROM conversations
  UNION ALL
  SELECT 'd' || doc_id, doc_id, text FROM documents
), texts AS (
  SELECT request_id, text || coalesce(' ' || {_SEED_CASE}, '') AS text FROM keyed
)
"""


def _flag(column: str, regex: str) -> str:
    return f"regexp_matches({column}, {_lit(regex)})"


def _public_ips(column: str) -> str:
    return (
        f"list_filter(regexp_extract_all({column}, {_lit(PII_RE['ip-address'])}), lambda ip: NOT ("
        "starts_with(ip, '127.') OR starts_with(ip, '10.') OR starts_with(ip, '192.168.') OR starts_with(ip, '0.')))"
    )


def _pii_list(column: str) -> str:
    arms = [f"CASE WHEN {_flag(column, PII_RE[n])} THEN {_lit(n)} END" for n in P.PII_TYPES[:4]]
    arms.append(f"CASE WHEN len({_public_ips(column)}) > 0 THEN 'ip-address' END")
    return f"array_to_string(list_filter([{', '.join(arms)}], lambda t: t IS NOT NULL), ',')"


def _pattern_rows(family: str, patterns: tuple) -> str:
    return ", ".join(f"({_lit(family)}, {i}, {_lit(cat)}, {_lit('(?i)' + p)})" for i, (cat, p) in enumerate(patterns))


_SAMPLE = _pick(f"k % {len(C.RULE_SAMPLES) + 1}", C.RULE_SAMPLES)
PATTERN_HITS = (
    _TEXTS
    + f""", sampled AS (SELECT request_id, text || ' ' || coalesce({_SAMPLE}, '') AS text FROM keyed)
, rules(family, pattern_id, category, regex) AS (VALUES
  {_pattern_rows(P.INJECTION, P.INJECTION_PATTERNS)}, {_pattern_rows(P.JAILBREAK, P.JAILBREAK_PATTERNS)})
SELECT family, pattern_id, category, count(*) AS texts
FROM sampled JOIN rules ON regexp_matches(text, regex) GROUP BY ALL"""
)

_EACH_PII = " UNION ALL ".join(
    f"SELECT request_id, {_lit(n)} AS pii_type, unnest("
    + (_public_ips("text") if n == "ip-address" else f"regexp_extract_all(text, {_lit(PII_RE[n])})")
    + ") AS matched FROM texts"
    for n in P.PII_TYPES
)

_REDACT = "text"
for _n in P.PII_TYPES[:4]:
    _REDACT = f"regexp_replace({_REDACT}, {_lit(PII_RE[_n])}, {_lit(P.PII_LABELS[_n])}, 'g')"

# Addresses: mark all, take the marks off the private ones, then replace what is still marked.
_PRIVATE = r"(127\.[0-9.]*|10\.[0-9.]*|192\.168\.[0-9.]*|0\.[0-9.]*)"
_REDACT = f"regexp_replace({_REDACT}, {_lit(PII_RE['ip-address'])}, chr(2) || '\\0' || chr(3), 'g')"
_REDACT = f"regexp_replace({_REDACT}, chr(2) || {_lit(_PRIVATE)} || chr(3), '\\1', 'g')"
_REDACT = f"regexp_replace({_REDACT}, chr(2) || '[0-9.]*' || chr(3), {_lit(P.PII_LABELS['ip-address'])}, 'g')"

# --- Fixed values: what the extra members of the request log violate, and in which schemas ----------
_C, _P, _M = "chat", "completion", "messages"
_EXTRA = (
    ("/top_p", "maximum", (_C, _P, _M)),
    ("/top_p", "type", (_C, _P, _M)),
    ("/n", "minimum", (_C, _P)),
    ("/n", "type", (_C, _P)),
    ("/stream", "type", (_C, _P, _M)),
    ("/presence_penalty", "minimum", (_C, _P)),
    ("/presence_penalty", "maximum", (_C, _P)),
    ("/frequency_penalty", "type", (_C, _P)),
    ("/logit_bias/50", "type", (_C, _P)),
    ("/logit_bias", "type", (_C, _P)),
    ("/user", "type", (_C, _P)),
    ("/seed", "type", (_C,)),
    ("/tools", "type", (_C, _M)),
    ("/response_format", "type", (_C,)),
    ("/logprobs", "maximum", (_P,)),
    ("/echo", "type", (_P,)),
    ("/best_of", "minimum", (_P,)),
    ("/top_k", "minimum", (_M,)),
    ("/top_k", "type", (_M,)),
    ("/metadata/user_id", "type", (_M,)),
    ("/metadata", "type", (_M,)),
    ("/stop_sequences/1", "type", (_M,)),
    ("/stop_sequences", "type", (_M,)),
    ("/logprobs", "minimum", (_P,)),
)
# --- end of fixed values --------------------------------------------------------------------------
_EXTRA_FOUND = ",\n      ".join(
    f"CASE WHEN extra = {i} AND held_to IN ({', '.join(map(_lit, kinds))}) THEN {{'path': {_lit(path)}, 'keyword': {_lit(keyword)}}} END"
    for i, (path, keyword, kinds) in enumerate(_EXTRA)
)

# Schema held to, then one row per (path, keyword).
SCHEMA = (
    TRUTH
    + f""", held AS (
  SELECT *, {_has('fractional-max-tokens')} OR row_max IS NOT NULL AS has_max,
    CASE WHEN {_has('prompt-only')} THEN (k // 85) % {len(_EXTRA)}
         WHEN (k // 7) % 3 = 0 THEN (k // 21) % {len(_EXTRA)} END AS extra,
    CASE WHEN {_has('trailing-text')} THEN 'json'
         WHEN {_has('not-an-object')} THEN CASE WHEN is_anthropic THEN 'root' ELSE 'format' END
         WHEN is_anthropic THEN 'messages'
         WHEN legacy THEN 'completion'
         WHEN provider = 'unknown' AND ({_has('fractional-max-tokens')} OR row_max IS NOT NULL)
              AND ({_has('model-twice')} OR NOT coalesce(starts_with(row_model, 'gpt'), false)) THEN 'messages'
         ELSE 'chat' END AS held_to,
    CASE WHEN with_system AND NOT is_anthropic THEN 1 ELSE 0 END AS idx
  FROM costed
), found AS (
  SELECT request_id, provider, path, keyword FROM (
    SELECT *, unnest(list_filter([
      CASE WHEN held_to IN ('json', 'format') THEN {{'path': '', 'keyword': held_to}} END,
      CASE WHEN held_to = 'root' THEN {{'path': '', 'keyword': 'type'}} END,
      CASE WHEN held_to IN ('chat', 'messages', 'completion') AND ((row_model IS NULL AND NOT {_has('model-twice')})
             OR (held_to = 'messages' AND (NOT has_max OR legacy))) THEN {{'path': '', 'keyword': 'required'}} END,
      CASE WHEN held_to IN ('chat', 'messages') AND {_has('no-messages')} THEN {{'path': '/messages', 'keyword': 'minItems'}} END,
      CASE WHEN held_to IN ('chat', 'messages') AND {_has('bad-role')} THEN {{'path': '/messages/' || idx || '/role', 'keyword': 'enum'}} END,
      CASE WHEN held_to = 'messages' AND NOT {_has('bad-role')} AND role1 = 'system' AND NOT legacy AND NOT {_has('no-messages')}
           THEN {{'path': '/messages/' || idx || '/role', 'keyword': 'enum'}} END,
      CASE WHEN held_to = 'messages' AND NOT is_anthropic AND with_system AND NOT {_has('no-messages')}
           THEN {{'path': '/messages/0/role', 'keyword': 'enum'}} END,
      CASE WHEN (held_to = 'messages' AND {_has('null-content')}) OR (held_to IN ('chat', 'messages') AND {_has('bad-part')})
           THEN {{'path': '/messages/' || idx || '/content', 'keyword': 'oneOf'}} END,
      CASE WHEN held_to IN ('chat', 'messages') AND {_has('fractional-max-tokens')} THEN {{'path': '/max_tokens', 'keyword': 'type'}} END,
      CASE WHEN held_to IN ('chat', 'messages') AND {_has('high-temperature')} THEN {{'path': '/temperature', 'keyword': 'maximum'}} END,
      CASE WHEN held_to = 'chat' AND {_has('five-stops')} THEN {{'path': '/stop', 'keyword': 'oneOf'}} END,
      CASE WHEN held_to = 'messages' AND {_has('numeric-system')} THEN {{'path': '/system', 'keyword': 'oneOf'}} END,
      CASE WHEN held_to = 'messages' AND {_has('tool-choice-text')} THEN {{'path': '/tool_choice', 'keyword': 'type'}} END,
      {_EXTRA_FOUND}
    ], lambda v: v IS NOT NULL), recursive := true)
    FROM held)
)
"""
)


def _limiter(source: str, client: str, order: str, us: str, tokens: str, requests: int, budget: int, window_us: int) -> str:
    """The sequential limiter as a recursive query: one step per request of each client."""
    deny_requests = f"({requests} > 0 AND n0 >= {requests})"
    deny_tokens = f"({budget} > 0 AND t0 + tok > {budget})"
    return f"""
, seqd AS (
  SELECT {order} AS id, {client} AS client, {us} AS us, {tokens} AS tok,
         row_number() OVER (PARTITION BY {client} ORDER BY {us}, {order}) AS rn
  FROM {source}
), walk AS (
  SELECT id, client, us, rn, us AS start,
         CASE WHEN {budget} > 0 AND tok > {budget} THEN 0 ELSE 1 END AS n,
         CASE WHEN {budget} > 0 AND tok > {budget} THEN 0 ELSE tok END AS t,
         CASE WHEN {budget} > 0 AND tok > {budget} THEN 'tokens' END AS exceeded
  FROM seqd WHERE rn = 1
  UNION ALL
  SELECT id, client, us, rn, start,
         CASE WHEN exceeded IS NULL THEN n0 + 1 ELSE n0 END,
         CASE WHEN exceeded IS NULL THEN t0 + tok ELSE t0 END, exceeded
  FROM (
    SELECT *, CASE WHEN {deny_requests} THEN 'requests' WHEN {deny_tokens} THEN 'tokens' END AS exceeded
    FROM (
      SELECT s.id, s.client, s.us, s.rn, s.tok,
             CASE WHEN s.us - w.start >= {window_us} THEN s.us ELSE w.start END AS start,
             CASE WHEN s.us - w.start >= {window_us} THEN 0 ELSE w.n END AS n0,
             CASE WHEN s.us - w.start >= {window_us} THEN 0 ELSE w.t END AS t0
      FROM walk w JOIN seqd s ON s.client = w.client AND s.rn = w.rn + 1))
)"""


def _rate_query(requests: int, budget: int) -> str:
    walk = _limiter("checked", "client_ip", "request_id", "epoch_us(ts)", "tokens", requests, budget, 60_000_000)
    return (
        TRUTH.replace("WITH keyed", "WITH RECURSIVE keyed", 1)
        + ", checked AS (SELECT * FROM costed WHERE parsed)"
        + walk
        + f"""
SELECT id AS request_id, client AS client_ip, exceeded IS NULL AS allowed, CAST(n AS BIGINT) AS request_count,
       CAST(t AS BIGINT) AS token_count, CAST((start + 60000000 - us) // 1000000 AS BIGINT) AS reset_seconds, exceeded
FROM walk"""
    )


EVENTS_DAILY = (
    "WITH RECURSIVE src AS (SELECT * FROM events)"
    + _limiter("src", "user_id", "event_id", "epoch_us(ts)", "CAST(ceil(value) AS BIGINT)", 3, 300, 86_400_000_000)
    + """
SELECT client AS user_id, CAST(count(*) AS BIGINT) AS requests,
       CAST(count(*) FILTER (WHERE exceeded = 'requests') AS BIGINT) AS denied_requests,
       CAST(count(*) FILTER (WHERE exceeded = 'tokens') AS BIGINT) AS denied_tokens
FROM walk GROUP BY client"""
)


def _verdict_ctes(
    block_mode: bool, schema: bool, allowed: tuple[str, ...], max_tokens: int | None, pii_block: bool, limits: tuple[int, int]
) -> str:
    """CTEs up to ``verdict``: one row per request with flags, status, reason and codes."""
    fits = " OR ".join(f"contains(model, {_lit(a)}) OR contains({_lit(a)}, model)" for a in allowed)
    denied = f"coalesce(NOT ({fits}), false)" if allowed else "false"
    over = f"coalesce(max_tokens > {max_tokens}, false)" if max_tokens is not None else "false"
    base = SCHEMA.replace("WITH keyed", "WITH RECURSIVE keyed", 1) + f"""
, staged AS (
  SELECT c.*, v.request_id IS NULL AS schema_valid,
    CASE WHEN {str(schema and block_mode).lower()} AND v.request_id IS NOT NULL THEN 'bad-schema'
         WHEN NOT parsed THEN 'unrecognised' ELSE 'checked' END AS stage,
    {denied} AS model_denied, {over} AS token_denied,
    {_flag('scan_text', INJECTION_RE)} AS injection_hit, {_flag('scan_text', JAILBREAK_RE)} AS jailbreak_hit,
    {_pii_list('scan_text')} AS pii_list
  FROM costed c LEFT JOIN (SELECT DISTINCT request_id FROM found) v ON v.request_id = c.request_id
), checked AS (SELECT * FROM staged WHERE stage = 'checked')"""
    if any(limits):
        base += _limiter("checked", "client_ip", "request_id", "epoch_us(ts)", "tokens", *limits, 60_000_000)
    else:
        base += ", walk AS (SELECT NULL AS id, NULL AS exceeded, 0 AS n, 0 AS t, 0 AS start, 0 AS us WHERE false)"
    b = str(block_mode).lower()
    return base + f"""
, gated AS (
  SELECT s.*, w.exceeded IS NOT NULL AS limited, w.n, w.t, w.id IS NOT NULL AS asked,
         (w.start + 60000000 - w.us) // 1000000 AS reset,
         stage = 'checked' AND w.exceeded IS NULL AS scanned
  FROM staged s LEFT JOIN walk w ON w.id = s.request_id
), f1 AS (SELECT *, scanned AND NOT (model_denied OR token_denied) AND injection_hit AS injection FROM gated
), f2 AS (
  SELECT *, scanned AND NOT (model_denied OR token_denied) AND NOT (injection AND {b}) AND jailbreak_hit AS jailbreak,
         scanned AND pii_list <> '' AS pii
  FROM f1
), verdict AS (
  SELECT *,
    CASE WHEN stage = 'bad-schema' THEN 400 WHEN stage <> 'checked' THEN NULL WHEN limited THEN 429
         WHEN model_denied OR token_denied OR ((injection OR jailbreak) AND {b})
              OR (pii AND {str(pii_block and block_mode).lower()}) THEN 403 END AS status,
    stage = 'checked' AND model_denied AS code_model, stage = 'checked' AND token_denied AS code_token
  FROM f2
)"""


def _verdict_query(**config) -> str:
    b = str(config["block_mode"]).lower()
    schema_tag = "CASE WHEN schema_valid THEN 'schema-valid' END" if config["schema"] else "NULL"
    pii_blocks = str(config["pii_block"] and config["block_mode"]).lower()
    return _verdict_ctes(**config) + f"""
SELECT request_id, provider, CASE WHEN status IS NULL THEN 'allow' ELSE 'block' END AS decision,
  CAST(status AS INTEGER) AS status,
  CASE WHEN status = 403 THEN CASE
    WHEN pii AND {pii_blocks} THEN 'pii-detected:' || pii_list
    WHEN jailbreak AND {b} THEN 'jailbreak-attempt' WHEN injection AND {b} THEN 'prompt-injection'
    WHEN token_denied THEN 'token-limit-exceeded' ELSE 'model-not-allowed' END END AS block_reason,
  array_to_string(list_filter([
    CASE WHEN stage = 'bad-schema' THEN 'SCHEMA_VALIDATION_FAILED' END,
    CASE WHEN code_model THEN 'MODEL_NOT_ALLOWED' END, CASE WHEN code_token THEN 'TOKEN_LIMIT_EXCEEDED' END,
    CASE WHEN limited THEN 'RATE_LIMIT_EXCEEDED' END, CASE WHEN injection THEN 'PROMPT_INJECTION' END,
    CASE WHEN jailbreak THEN 'JAILBREAK_ATTEMPT' END, CASE WHEN pii THEN 'PII_DETECTED' END],
    lambda x: x IS NOT NULL), ',') AS reason_codes,
  CASE WHEN stage = 'bad-schema' THEN 'ai-gateway,blocked,schema-invalid'
       WHEN stage = 'unrecognised' THEN 'ai-gateway'
       ELSE array_to_string(list_filter([
         'ai-gateway', 'provider:' || provider, 'model:' || model, {schema_tag},
         CASE WHEN limited THEN 'rate-limited' END, CASE WHEN injection THEN 'detected:prompt-injection' END,
         CASE WHEN jailbreak THEN 'detected:jailbreak' END, CASE WHEN pii THEN 'pii:' || pii_list END,
         CASE WHEN status = 403 THEN 'blocked' END], lambda x: x IS NOT NULL), ',') END AS tags
FROM verdict"""


STRICT = dict(
    block_mode=True, schema=True, allowed=("gpt-4", "claude"), max_tokens=1000, pii_block=True, limits=(4, 3000)
)
DETECT_ONLY = dict(block_mode=False, schema=True, allowed=(), max_tokens=None, pii_block=True, limits=(0, 0))
DEFAULT = dict(block_mode=True, schema=False, allowed=(), max_tokens=None, pii_block=False, limits=(0, 0))

_COUNTERS = """CAST(count(*) AS BIGINT) AS requests_total,
  CAST(count(*) FILTER (WHERE status IS NOT NULL) AS BIGINT) AS requests_blocked_total,
  CAST(count(*) FILTER (WHERE injection) AS BIGINT) AS prompt_injection_detections_total,
  CAST(count(*) FILTER (WHERE pii) AS BIGINT) AS pii_detections_total,
  CAST(count(*) FILTER (WHERE jailbreak) AS BIGINT) AS jailbreak_detections_total"""

_ASSEMBLED = """
WITH m AS (SELECT *, doc_id % 19 AS m, 'doc-' || doc_id AS cid FROM documents),
done AS (
  SELECT *, 10 AS opened_seq FROM m WHERE m NOT IN (1, 2)
  UNION ALL SELECT *, 1000000 FROM m WHERE m IN (2, 6)
)"""


def _header_lines(*pairs: tuple[str, str]) -> str:
    """Sorted lines of the headers whose SQL value is not NULL."""
    items = ", ".join(f"'{name}=' || {value}" for name, value in sorted(pairs))
    return f"array_to_string(list_sort(list_filter([{items}], lambda x: x IS NOT NULL)), chr(10))"


def _headers_query(**config) -> str:
    requests, tokens = config["limits"]
    given = _header_lines(
        ("X-AI-Gateway-Provider", "provider"),
        ("X-AI-Gateway-Model", "model"),
        ("X-AI-Gateway-Schema-Valid", "CAST(schema_valid AS VARCHAR)"),
        ("X-AI-Gateway-Tokens-Estimated", "tokens"),
        ("X-AI-Gateway-Cost-Estimated", "printf('%.6f', cost)"),
        ("X-AI-Gateway-PII-Detected", "CASE WHEN pii THEN pii_list END"),
    )
    reason = f"""CASE WHEN pii AND {str(config["pii_block"]).lower()} THEN 'pii-detected:' || pii_list
      WHEN jailbreak THEN 'jailbreak-attempt' WHEN injection THEN 'prompt-injection'
      WHEN token_denied THEN 'token-limit-exceeded' ELSE 'model-not-allowed' END"""
    limit = ("X-RateLimit-Limit-Requests", f"'{requests}'")
    limited = _header_lines(
        limit, ("X-RateLimit-Remaining-Requests", "'0'"), ("X-RateLimit-Reset", "reset"), ("Retry-After", "reset")
    )
    left = _header_lines(
        limit,
        ("X-RateLimit-Remaining-Requests", f"greatest({requests} - n, 0)"),
        ("X-RateLimit-Limit-Tokens", f"'{tokens}'"),
        ("X-RateLimit-Remaining-Tokens", f"greatest({tokens} - t, 0)"),
        ("X-RateLimit-Reset", "reset"),
    )
    return _verdict_ctes(**config) + f"""
SELECT request_id,
  CASE WHEN stage = 'checked' AND status IS NULL THEN {given} ELSE '' END AS request_headers,
  CASE WHEN stage = 'bad-schema' THEN 'X-AI-Gateway-Schema-Errors=' || chr(10) || 'X-AI-Gateway-Schema-Valid=false'
       WHEN limited THEN {limited}
       WHEN status = 403 THEN {_header_lines(("X-AI-Gateway-Blocked", "'true'"), ("X-AI-Gateway-Blocked-Reason", f"({reason})"))}
       WHEN asked THEN {left} ELSE '' END AS response_headers,
  CASE WHEN status = 400 THEN 'Schema validation failed' WHEN status = 429 THEN 'Too Many Requests'
       WHEN status = 403 THEN 'Forbidden' END AS block_body
FROM verdict"""


def _spans_of(kind: str) -> str:
    """Byte spans of one kind: what stands between its matches, and the matches, added up."""
    found = f"regexp_extract_all(text, {_lit(PII_RE[kind])})"
    return f"""SELECT request_id, {_lit(kind)} AS pii_type, {P.PII_TYPES.index(kind)} AS rank, found[i] AS matched,
    CAST(list_sum(list_transform(between[1:i], lambda x: strlen(x)))
         + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: strlen(x))), 0) AS BIGINT) AS start
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i
        FROM (SELECT request_id, {found} AS found, string_split_regex(text, {_lit(PII_RE[kind])}) AS between FROM texts))"""


PII_SPANS = (
    _TEXTS
    + ", spans AS ("
    + " UNION ALL ".join(map(_spans_of, P.PII_TYPES))
    + """)
SELECT request_id, pii_type, row_number() OVER (PARTITION BY request_id ORDER BY start, rank) - 1 AS position,
  start, CAST(start + strlen(matched) AS BIGINT) AS end
FROM spans WHERE pii_type <> 'ip-address' OR NOT (starts_with(matched, '127.') OR starts_with(matched, '10.')
  OR starts_with(matched, '192.168.') OR starts_with(matched, '0.'))"""
)


def oracle_sql() -> dict[str, str]:
    return {
        "provider_counts": TRUTH + "SELECT uri, provider, count(*) AS requests FROM costed GROUP BY ALL",
        "message_table": TRUTH
        + """SELECT request_id, CAST(i - 1 AS INTEGER) AS position, messages[i].role AS role, messages[i].content AS content
FROM (SELECT *, unnest(range(1, len(messages) + 1)) AS i FROM costed WHERE parsed)""",
        "flat_content": TRUTH
        + "SELECT request_id, md5(array_to_string(contents, chr(1))) AS content_md5, CAST(len(contents) AS INTEGER) AS n "
        "FROM costed WHERE parsed",
        "legacy_prompt": TRUTH
        + """SELECT request_id, messages[1].role AS role, md5(messages[1].content) AS content_md5,
  CAST(len(messages) AS INTEGER) AS n FROM costed WHERE parsed AND legacy""",
        "strict_parse": TRUTH + "SELECT request_id, parsed FROM costed",
        "token_estimate": TRUTH + "SELECT request_id, tokens FROM costed WHERE parsed",
        "cost_by_model": TRUTH
        + """SELECT provider, model, count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens,
  round(sum(cost), 9) AS cost FROM costed WHERE parsed GROUP BY provider, model""",
        "cost_by_price_table": TRUTH
        + """SELECT provider, model, count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens,
  round(sum(cost), 9) AS cost FROM costed WHERE parsed GROUP BY provider, model""",
        "cost_by_price_change": TRUTH
        + """SELECT provider, model, count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens,
  round(sum(CASE WHEN ts < TIMESTAMP '2024-01-01 00:10:00' THEN cost
      WHEN provider = 'openai' AND contains(model, 'gpt-4') AND NOT contains(model, 'gpt-4o') AND NOT contains(model, 'gpt-4-turbo')
        THEN tokens / 1000.0::DOUBLE * 0.06::DOUBLE
      WHEN provider = 'anthropic' AND contains(model, 'claude-3-haiku') THEN tokens / 1000.0::DOUBLE * 0.5::DOUBLE
      ELSE cost END), 9) AS cost
FROM costed WHERE parsed GROUP BY provider, model""",
        "cost_text": TRUTH + "SELECT request_id, printf('%.6f', cost) AS cost FROM costed WHERE parsed",
        "usage_by_hour": TRUTH
        + """SELECT provider, model, client_ip AS client, date_trunc('hour', ts) AS hour, count(*) AS requests,
  CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 9) AS cost
FROM costed WHERE parsed GROUP BY provider, model, client_ip, date_trunc('hour', ts)""",
        "allowlist": TRUTH
        + """SELECT request_id, coalesce(contains(model, 'gpt-4') OR contains('gpt-4', model)
    OR contains(model, 'claude-3-opus-latest') OR contains('claude-3-opus-latest', model), true) AS allowed
FROM costed WHERE parsed""",
        "allowlist_table": TRUTH
        + """SELECT request_id, coalesce(contains(model, 'gpt-4') OR contains('gpt-4', model)
    OR contains(model, 'claude-3-opus-latest') OR contains('claude-3-opus-latest', model), true) AS allowed
FROM costed WHERE parsed""",
        "token_limit": TRUTH
        + "SELECT request_id, coalesce(max_tokens > 1000, false) AS denied FROM costed WHERE parsed",
        "injection_flags": _TEXTS + f"SELECT request_id, {_flag('text', INJECTION_RE)} AS injection FROM texts",
        "jailbreak_flags": _TEXTS + f"SELECT request_id, {_flag('text', JAILBREAK_RE)} AS jailbreak FROM texts",
        "request_flags": TRUTH
        + f"""SELECT request_id, {_flag('scan_text', INJECTION_RE)} AS injection,
  {_flag('scan_text', JAILBREAK_RE)} AS jailbreak, {_pii_list('scan_text')} AS pii_types FROM costed WHERE parsed""",
        "page_flags": f"""SELECT page_id, {_flag('html', INJECTION_RE)} AS injection,
  {_flag('html', JAILBREAK_RE)} AS jailbreak, {_pii_list('html')} AS pii_types FROM pages""",
        "flags_by_label": f"""SELECT l.quality, l.toxic, count(*) AS documents,
  count(*) FILTER (WHERE {_flag('d.text', JAILBREAK_RE)}) AS jailbreak,
  count(*) FILTER (WHERE {_pii_list('d.text')} <> '') AS pii
FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY l.quality, l.toxic""",
        "pattern_hits": PATTERN_HITS,
        "pii_findings": _TEXTS + f"SELECT request_id, pii_type, matched FROM ({_EACH_PII})",
        "has_pii": _TEXTS
        + "SELECT request_id, "
        + " OR ".join(_flag("text", PII_RE[n]) for n in P.PII_TYPES[:4])
        + " AS has_pii FROM texts",
        "pii_types": _TEXTS + f"SELECT request_id, {_pii_list('text')} AS pii_types FROM texts",
        "pii_redact": _TEXTS
        + f"SELECT request_id, md5({_REDACT}) AS text_md5 FROM texts",
        "redact_bodies": TRUTH
        + f"SELECT request_id, md5(array_to_string(list_transform(contents, lambda text: {_REDACT}), chr(1))) AS content_md5, "
        "CAST(len(contents) AS INTEGER) AS n FROM costed WHERE parsed",
        "finding_counts": _TEXTS
        + f"""SELECT finding, count(*) AS texts FROM (
  SELECT 'prompt-injection' AS finding FROM texts WHERE {_flag('text', INJECTION_RE)}
  UNION ALL SELECT 'jailbreak-attempt' FROM texts WHERE {_flag('text', JAILBREAK_RE)}
  UNION ALL SELECT unnest(string_split({_pii_list('text')}, ',')) FROM texts WHERE {_pii_list('text')} <> ''
) GROUP BY finding""",
        "schema_violations": SCHEMA + "SELECT request_id, provider, path, keyword FROM found GROUP BY ALL",
        "schema_counts": SCHEMA
        + """SELECT provider, regexp_replace(path, '/[0-9]+(/|$)', '/*\\1') AS path, keyword, count(*) AS requests
FROM (SELECT DISTINCT * FROM found) GROUP BY 1, 2, 3""",
        "assemble_bodies": _ASSEMBLED
        + """SELECT cid AS correlation_id, CAST(opened_seq AS BIGINT) AS opened_seq, md5(text) AS body_md5,
  CAST(strlen(text) AS INTEGER) AS n_bytes FROM done WHERE m <> 5""",
        "utf8_policy": _ASSEMBLED
        + "SELECT m <> 5 AS body_is_utf8, CAST(CASE WHEN m = 5 THEN 400 END AS INTEGER) AS status, count(*) AS requests FROM done GROUP BY 1, 2",
        "in_flight": _ASSEMBLED + "SELECT cid AS correlation_id, CAST(10 AS BIGINT) AS opened_seq FROM m WHERE m = 1",
        "rate_requests": _rate_query(4, 0),
        "rate_tokens": _rate_query(0, 3000),
        "rate_both": _rate_query(4, 3000),
        "rate_events_daily": EVENTS_DAILY,
        # Judged or assembled run by run, a log gives what it gives at once.
        "rate_runs": _rate_query(4, 3000),
        "rate_events_runs": EVENTS_DAILY,
        "assemble_runs": _ASSEMBLED
        + """SELECT cid AS correlation_id, CAST(opened_seq AS BIGINT) AS opened_seq, md5(text) AS body_md5,
  CAST(strlen(text) AS INTEGER) AS n_bytes FROM done WHERE m <> 5""",
        "in_flight_runs": _ASSEMBLED + "SELECT cid AS correlation_id, CAST(10 AS BIGINT) AS opened_seq FROM m WHERE m = 1",
        "event_fates": _ASSEMBLED
        + """, n AS (SELECT m, greatest(ceil(strlen(text) / 1000.0), 1) AS n FROM m)
SELECT fate, CAST(sum(k) AS BIGINT) AS events FROM (
  SELECT CASE WHEN m = 1 THEN 'open' ELSE 'finished' END AS fate,
         (n + 1) * CASE WHEN m = 6 THEN 2 ELSE 1 END + CASE WHEN m = 5 THEN 1 ELSE 0 END AS k FROM n
  UNION ALL SELECT 'reset', n + 1 FROM n WHERE m = 2
  UNION ALL SELECT 'undecodable', 1 FROM n WHERE m = 3
  UNION ALL SELECT 'orphan', 1 FROM n WHERE m IN (4, 7)) GROUP BY fate""",
        "verdicts_block": _verdict_query(**STRICT),
        "verdicts_detect_only": _verdict_query(**DETECT_ONLY),
        "verdicts_default": _verdict_query(**DEFAULT),
        "verdicts_from_chunks": _verdict_query(**DEFAULT),
        "metrics_in_flight": _verdict_ctes(**DEFAULT)
        + f"""SELECT {_COUNTERS}, (SELECT count(*) FROM costed WHERE k % 19 = 1) AS in_flight_requests
FROM verdict WHERE k % 19 <> 1""",
        "assemble_events": _ASSEMBLED
        + """SELECT cid AS correlation_id, CAST(opened_seq AS BIGINT) AS opened_seq, 'r-' || cid AS request_id,
  CAST(1024 + doc_id % 50000 AS INTEGER) AS client_port, 'POST' AS method, 'route-' || (doc_id % 3) AS route_id,
  'h' || (doc_id % 5) AS host, doc_id || '/' || m AS doc,
  CASE WHEN m = 5 THEN md5(encode(text) || '\\xFF'::BLOB) ELSE md5(text) END AS body_md5,
  CAST(strlen(text) + CASE WHEN m = 5 THEN 1 ELSE 0 END AS INTEGER) AS n_bytes, m <> 5 AS body_is_utf8
FROM done""",
        "utf8_fail_open": _ASSEMBLED
        + """SELECT 'allow' AS decision, CASE WHEN m = 5 THEN 'ai-gateway,error' ELSE 'ai-gateway' END AS tags,
  CASE WHEN m = 5 THEN 'INVALID_UTF8' ELSE '' END AS reason_codes, count(*) AS requests FROM done GROUP BY ALL""",
        "verdict_headers": _headers_query(**STRICT),
        "verdict_sink": _verdict_ctes(**DEFAULT)
        + """SELECT CAST(ts AS DATE) AS date, CASE WHEN status IS NULL THEN 'allow' ELSE 'block' END AS decision,
  CAST(status AS INTEGER) AS status, count(*) AS requests FROM verdict GROUP BY ALL""",
        "pii_spans": PII_SPANS,
        "metrics": _verdict_ctes(**STRICT) + f"SELECT {_COUNTERS} FROM verdict",
        "metrics_per_minute": _verdict_ctes(**DEFAULT)
        + f"SELECT date_trunc('minute', ts) AS minute, {_COUNTERS} FROM verdict GROUP BY 1",
    }
