"""Request-schema rules over VARIANT values.

Every rule yields an array of violations, struct<path, keyword, message>, that is empty when the
value conforms.  ``path`` is a JSON pointer, empty for the document root.

A schema has some hundred small conditions.  They are put together as one SQL expression and
handed to Spark once, which is much quicker than a call per operator.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

VIOLATIONS = "array<struct<path string, keyword string, message string>>"
NOTHING = f"cast(array() AS {VIOLATIONS})"

Test = Callable[[str], str]  # SQL of a value -> SQL condition, never NULL
Rule = Callable[[str, str], str]  # SQL of a value, SQL of its path -> SQL of its violations

_names = itertools.count()


def _fresh(stem: str) -> str:
    """A lambda variable name that no enclosing lambda uses."""
    return f"{stem}_{next(_names)}"


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def violation(path: str, keyword: str, message: str) -> str:
    return f"cast(array(struct({path}, {quoted(keyword)}, {quoted(message)})) AS {VIOLATIONS})"


def fails(condition: str, path: str, keyword: str, message: str) -> str:
    return f"CASE WHEN {condition} THEN {violation(path, keyword, message)} ELSE {NOTHING} END"


def together(*parts: str) -> str:
    return f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0]


# --- type tests (a JSON value that is absent is a NULL column) --------------------------------


def _kind(v: str) -> str:
    return f"schema_of_variant({v})"


def is_string(v: str) -> str:
    return f"coalesce({_kind(v)} = 'STRING', false)"


def is_object(v: str) -> str:
    """Only an object can be read as a struct, whichever fields it has."""
    return f"(try_cast({v} AS struct<type variant>) IS NOT NULL)"


def is_array(v: str) -> str:
    return f"(try_cast({v} AS array<variant>) IS NOT NULL)"


def is_boolean(v: str) -> str:
    return f"coalesce({_kind(v)} = 'BOOLEAN', false)"


def is_null(v: str) -> str:
    return f"coalesce({_kind(v)} = 'VOID', false)"


def is_number(v: str) -> str:
    kind = _kind(v)
    return f"coalesce({kind} IN ('BIGINT', 'DOUBLE') OR startswith({kind}, 'DECIMAL'), false)"


def number(v: str) -> str:
    return f"CASE WHEN {is_number(v)} THEN try_cast({v} AS double) END"


def is_integer(v: str) -> str:
    """Numbers without a fractional part; ``1.0`` and ``1e2`` count."""
    return f"coalesce({number(v)} = floor({number(v)}), false)"


TYPE_TESTS: dict[str, Test] = {
    "string": is_string,
    "object": is_object,
    "array": is_array,
    "boolean": is_boolean,
    "number": is_number,
    "integer": is_integer,
    "null": is_null,
}


# --- rules ------------------------------------------------------------------------------------


def has_type(name: str) -> Rule:
    return lambda v, path: fails(f"NOT {TYPE_TESTS[name](v)}", path, "type", f'value is not of type "{name}"')


def in_range(low: float | None = None, high: float | None = None) -> Rule:
    """Bounds apply to numbers only."""

    def rule(v: str, path: str) -> str:
        parts = []
        if low is not None:
            message = f"value is less than the minimum of {low}"
            parts.append(fails(f"{number(v)} < {low}", path, "minimum", message))
        if high is not None:
            message = f"value is greater than the maximum of {high}"
            parts.append(fails(f"{number(v)} > {high}", path, "maximum", message))
        return together(*parts)

    return rule


def non_empty_string() -> Rule:
    message = "value is shorter than 1 character"
    return lambda v, path: fails(f"{is_string(v)} AND try_cast({v} AS string) = ''", path, "minLength", message)


def one_of_values(*values: str) -> Rule:
    listed = ", ".join(quoted(x) for x in values)
    message = "value is not one of [" + ", ".join(f'"{x}"' for x in values) + "]"

    def rule(v: str, path: str) -> str:
        known = f"coalesce({is_string(v)} AND try_cast({v} AS string) IN ({listed}), false)"
        return fails(f"NOT {known}", path, "enum", message)

    return rule


def one_of_shapes(*tests: Test) -> Rule:
    """The shapes exclude each other, so "exactly one" is "any"."""
    message = "value is not valid under any of the given schemas"
    return lambda v, path: fails(f"NOT ({' OR '.join(t(v) for t in tests)})", path, "oneOf", message)


def all_rules(*rules: Rule) -> Rule:
    return lambda v, path: together(*[r(v, path) for r in rules])


def number_between(low: float, high: float) -> Rule:
    return all_rules(has_type("number"), in_range(low, high))


def integer_from(low: int, high: int | None = None) -> Rule:
    return all_rules(has_type("integer"), in_range(low, high))


def array_of_strings(max_items: int | None = None) -> Test:
    """Shape test: an array whose items are all strings."""

    def test(v: str) -> str:
        items, x = f"try_cast({v} AS array<variant>)", _fresh("x")
        fits = f"forall({items}, {x} -> {is_string(x)})"
        if max_items is not None:
            fits += f" AND size({items}) <= {max_items}"
        return f"coalesce({fits}, false)"

    return test


def array_of_objects(required: dict[str, str], optional: dict[str, str]) -> Test:
    """Shape test: an array of objects with typed fields."""
    members = ", ".join(f"{n} variant" for n in [*required, *optional])

    def test(v: str) -> str:
        x = _fresh("x")
        fits = [f"{x} IS NOT NULL"]
        fits += [TYPE_TESTS[kind](f"{x}.{name}") for name, kind in required.items()]
        fits += [f"({x}.{name} IS NULL OR {TYPE_TESTS[kind](f'{x}.{name}')})" for name, kind in optional.items()]
        return f"coalesce(forall(try_cast({v} AS array<struct<{members}>>), {x} -> {' AND '.join(fits)}), false)"

    return test


def list_of(item: Rule, min_items: int = 0) -> Rule:
    """A minimum length and a rule for every item, reported at the item's position."""

    def rule(v: str, path: str) -> str:
        items, x, i = f"try_cast({v} AS array<variant>)", _fresh("x"), _fresh("i")
        at = f"concat({path}, '/', cast({i} AS string))"
        parts = [f"coalesce(flatten(transform({items}, ({x}, {i}) -> {item(x, at)})), {NOTHING})"]
        if min_items:
            message = f"array has fewer than {min_items} item"
            parts.insert(0, fails(f"size({items}) < {min_items}", path, "minItems", message))
        return together(*parts)

    return rule


def map_values(item: Rule) -> Rule:
    """A rule for every member of an object, reported at the member."""

    def rule(v: str, path: str) -> str:
        e = _fresh("e")
        at = f"concat({path}, '/', replace(replace({e}.key, '~', '~0'), '/', '~1'))"
        members = f"map_entries(try_cast({v} AS map<string, variant>))"
        return f"coalesce(flatten(transform({members}, {e} -> {item(f'{e}.value', at)})), {NOTHING})"

    return rule


def object_fields(required: tuple[str, ...], rules: dict[str, Rule]) -> Rule:
    """Required members, then a rule for each member that is present; non-objects pass."""
    members = ", ".join(f"{n} variant" for n in dict.fromkeys([*required, *rules]))

    def rule(v: str, path: str) -> str:
        # The lambda variable holds the extracted members, so that they are extracted once.
        f = _fresh("f")
        parts = [
            fails(f"{f}.{n} IS NULL", path, "required", f'"{n}" is a required property') for n in required
        ]
        for name, member_rule in rules.items():
            found = member_rule(f"{f}.{name}", f"concat({path}, '/{name}')")
            parts.append(f"CASE WHEN {f}.{name} IS NOT NULL THEN {found} ELSE {NOTHING} END")
        body = f"CASE WHEN {f} IS NOT NULL THEN {together(*parts)} ELSE {NOTHING} END"
        return f"element_at(transform(array(try_cast({v} AS struct<{members}>)), {f} -> {body}), 1)"

    return rule


# --- Fixed values: the three request schemas --------------------------------------------------

_MODEL = all_rules(has_type("string"), non_empty_string())
_CHAT_PART = array_of_objects({"type": "string"}, {"text": "string", "image_url": "object"})
_MESSAGES_PART = array_of_objects({"type": "string"}, {"text": "string", "source": "object"})
_SYSTEM_PART = array_of_objects({"type": "string", "text": "string"}, {"cache_control": "object"})

_SAMPLING: dict[str, Rule] = {
    "max_tokens": integer_from(1),
    "temperature": number_between(0, 2),
    "top_p": number_between(0, 1),
    "n": integer_from(1),
    "stream": has_type("boolean"),
    "stop": one_of_shapes(is_string, array_of_strings(max_items=4)),
    "presence_penalty": number_between(-2, 2),
    "frequency_penalty": number_between(-2, 2),
    "logit_bias": all_rules(has_type("object"), map_values(has_type("number"))),
    "user": has_type("string"),
}

CHAT = all_rules(
    has_type("object"),
    object_fields(
        ("model", "messages"),
        {
            "model": _MODEL,
            "messages": all_rules(
                has_type("array"),
                list_of(
                    all_rules(
                        has_type("object"),
                        object_fields(
                            ("role", "content"),
                            {
                                "role": all_rules(
                                    has_type("string"),
                                    one_of_values("system", "user", "assistant", "tool", "function"),
                                ),
                                "content": one_of_shapes(is_string, is_null, _CHAT_PART),
                                "name": has_type("string"),
                                "tool_calls": has_type("array"),
                                "tool_call_id": has_type("string"),
                                "function_call": has_type("object"),
                            },
                        ),
                    ),
                    min_items=1,
                ),
            ),
            **_SAMPLING,
            "tools": has_type("array"),
            "response_format": has_type("object"),
            "seed": has_type("integer"),
        },
    ),
)

COMPLETION = all_rules(
    has_type("object"),
    object_fields(
        ("model", "prompt"),
        {
            "model": _MODEL,
            "prompt": one_of_shapes(is_string, array_of_strings()),
            **_SAMPLING,
            "logprobs": integer_from(0, 5),
            "echo": has_type("boolean"),
            "best_of": integer_from(1),
        },
    ),
)

MESSAGES = all_rules(
    has_type("object"),
    object_fields(
        ("model", "max_tokens", "messages"),
        {
            "model": _MODEL,
            "max_tokens": integer_from(1),
            "messages": all_rules(
                has_type("array"),
                list_of(
                    all_rules(
                        has_type("object"),
                        object_fields(
                            ("role", "content"),
                            {
                                "role": all_rules(has_type("string"), one_of_values("user", "assistant")),
                                "content": one_of_shapes(is_string, _MESSAGES_PART),
                            },
                        ),
                    ),
                    min_items=1,
                ),
            ),
            "system": one_of_shapes(is_string, _SYSTEM_PART),
            "temperature": number_between(0, 1),
            "top_p": number_between(0, 1),
            "top_k": integer_from(0),
            "stream": has_type("boolean"),
            "stop_sequences": all_rules(has_type("array"), list_of(has_type("string"))),
            "metadata": all_rules(has_type("object"), object_fields((), {"user_id": has_type("string")})),
            "tools": has_type("array"),
            "tool_choice": has_type("object"),
        },
    ),
)
# --- end of fixed values ----------------------------------------------------------------------
