"""Schema rules: which (path, keyword) pairs a body violates."""

from pyspark.sql import functions as F

from reqguard.operators import validate as V

CHAT, MESSAGES, OTHER = "/v1/chat/completions", "/v1/messages", "/internal"
HI = '"messages":[{"role":"user","content":"Hi"}]'


def chat(extra):
    return CHAT, f'{{"model":"gpt-4",{HI},{extra}}}'


def claude(extra):
    return MESSAGES, f'{{"model":"c","max_tokens":5,{HI},{extra}}}'


CASES = [
    ((CHAT, f'{{"model":"gpt-4",{HI}}}'), set()),
    ((CHAT, f"{{{HI}}}"), {("", "required")}),
    ((CHAT, '{"model":"gpt-4"}'), {("", "format")}),
    ((CHAT, '{"model":"gpt-4","messages":[]}'), {("/messages", "minItems")}),
    ((CHAT, '{"model":"gpt-4","messages":null}'), {("/messages", "type")}),
    ((CHAT, '{"model":"","messages":[{"role":"narrator","content":"x"}]}'), {("/model", "minLength"), ("/messages/0/role", "enum")}),
    ((CHAT, '{"model":5,"messages":[5,{"role":7,"content":"x"},{"content":null}]}'),
     {("/model", "type"), ("/messages/0", "type"), ("/messages/1/role", "type"), ("/messages/1/role", "enum"), ("/messages/2", "required")}),
    ((CHAT, '{"model":"m","messages":[{"role":"tool","content":null,"name":1,"tool_calls":{},"tool_call_id":2,"function_call":[]}]}'),
     {("/messages/0/name", "type"), ("/messages/0/tool_calls", "type"), ("/messages/0/tool_call_id", "type"), ("/messages/0/function_call", "type")}),
    ((CHAT, '{"model":"m","messages":[{"role":"user","content":[{"type":"text","text":"x","image_url":{}}]},{"role":"user","content":[{"text":"x"}]},{"role":"user","content":[{"type":"a","text":null}]},{"role":"user","content":5}]}'),
     {("/messages/1/content", "oneOf"), ("/messages/2/content", "oneOf"), ("/messages/3/content", "oneOf")}),
    (chat('"max_tokens":0'), {("/max_tokens", "minimum")}),
    (chat('"max_tokens":1.0,"n":1e2,"seed":-4'), set()),
    (chat('"max_tokens":"5","n":0.5,"seed":1.5'), {("/max_tokens", "type"), ("/n", "type"), ("/n", "minimum"), ("/seed", "type")}),
    (chat('"temperature":2,"top_p":0,"presence_penalty":-2,"frequency_penalty":2'), set()),
    (chat('"temperature":5.0,"top_p":-0.1,"presence_penalty":-2.5,"frequency_penalty":3'),
     {("/temperature", "maximum"), ("/top_p", "minimum"), ("/presence_penalty", "minimum"), ("/frequency_penalty", "maximum")}),
    (chat('"temperature":"hot","stream":1,"user":5,"tools":{},"response_format":[],"tool_choice":5'),
     {("/temperature", "type"), ("/stream", "type"), ("/user", "type"), ("/tools", "type"), ("/response_format", "type")}),
    (chat('"stop":["a","b","c","d"]'), set()),
    (chat('"stop":["a","b","c","d","e"]'), {("/stop", "oneOf")}),
    (chat('"stop":[1]'), {("/stop", "oneOf")}),
    (chat('"logit_bias":{"50":1,"a/b":"x","c~d":null}'), {("/logit_bias/a~1b", "type"), ("/logit_bias/c~0d", "type")}),
    (chat('"logit_bias":[]'), {("/logit_bias", "type")}),
    ((CHAT, '{"model":"i","prompt":"Hello"}'), set()),
    ((CHAT, '{"model":"i","prompt":["a","b"],"logprobs":5,"echo":true,"best_of":1}'), set()),
    ((CHAT, '{"prompt":[1],"logprobs":6,"echo":"y","best_of":0}'),
     {("", "required"), ("/prompt", "oneOf"), ("/logprobs", "maximum"), ("/echo", "type"), ("/best_of", "minimum")}),
    ((MESSAGES, f'{{"model":"c","max_tokens":1024,"system":"s",{HI}}}'), set()),
    ((MESSAGES, f'{{"model":"c",{HI}}}'), {("", "required")}),
    ((MESSAGES, '{"model":"c","max_tokens":1,"messages":[{"role":"system","content":null}]}'), {("/messages/0/role", "enum"), ("/messages/0/content", "oneOf")}),
    (claude('"system":[{"type":"text","text":"x","cache_control":{}}],"temperature":1,"top_k":0,"metadata":{"user_id":"u"},"tool_choice":{}'), set()),
    (claude('"system":[{"type":"text"}],"temperature":1.5,"top_k":-1,"metadata":{"user_id":5},"tool_choice":"auto","stop_sequences":["a",1]'),
     {("/system", "oneOf"), ("/temperature", "maximum"), ("/top_k", "minimum"), ("/metadata/user_id", "type"), ("/tool_choice", "type"), ("/stop_sequences/1", "type")}),
    ((MESSAGES, "[1]"), {("", "type")}),
    ((MESSAGES, "{}"), {("", "required")}),
    ((OTHER, f'{{"model":"c","max_tokens":5,{HI}}}'), set()),
    ((OTHER, '{"model":"c","max_tokens":5,"messages":[{"role":"tool","content":"x"}]}'), {("/messages/0/role", "enum")}),
    ((OTHER, '{"model":"gpt-4","max_tokens":5,"messages":[{"role":"tool","content":"x"}]}'), set()),
    ((OTHER, f'{{"model":"c",{HI}}}'), set()),
    ((OTHER, '{"model":"c","prompt":"x"}'), set()),
    ((OTHER, "{}"), {("", "format")}),
    ((OTHER, "7"), {("", "format")}),
    ((CHAT, "{model: no quotes"), {("", "json")}),
    ((CHAT, '{"model":"gpt-4"} trailing'), {("", "json")}),
    ((CHAT, None), {("", "json")}),
]


def test_violations(spark):
    df = spark.createDataFrame([(i, u, b) for i, ((u, b), _) in enumerate(CASES)], "id int, uri string, body string")
    got = {i: set() for i in range(len(CASES))}
    table = V.validate_requests(df, "id")
    for r in table.collect():
        got[r.id].add((r.path, r.keyword))
        assert r.message
    assert [(CASES[i][0], g, CASES[i][1]) for i, g in got.items() if g != CASES[i][1]] == []


def test_error_text_and_counts(spark):
    df = spark.createDataFrame(
        [(1, CHAT, '{"messages":[{"role":"x","content":"y"},{"role":"z","content":"y"}]}')], "id int, uri string, body string"
    )
    table = V.validate_requests(df, "id")
    counts = {(r.path, r.keyword): r.violations for r in V.violation_counts(table).collect()}
    assert counts == {("", "required"): 1, ("/messages/*/role", "enum"): 2}
    errors = F.array(*[F.struct(F.lit(p).alias("path"), F.lit("k").alias("keyword"), F.lit(m).alias("message")) for p, m in (("", "root"), ("/a", "at a"))])
    assert spark.range(1).select(V.error_text(errors)).first()[0] == "root; /a: at a"
