"""Policy configuration."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from typing import Any

PII_ACTIONS = ("block", "redact", "log")


@dataclass(frozen=True)
class PolicyConfig:
    """One policy per run; its values become literals of the plan."""

    prompt_injection_enabled: bool = True
    pii_detection_enabled: bool = True
    pii_action: str = "log"
    jailbreak_detection_enabled: bool = True
    schema_validation_enabled: bool = False
    max_tokens_per_request: int | None = None
    add_cost_headers: bool = True
    allowed_models: tuple[str, ...] = ()
    block_mode: bool = True
    fail_open: bool = False
    rate_limit_requests: int = 0
    rate_limit_tokens: int = 0

    def __post_init__(self) -> None:
        if self.pii_action not in PII_ACTIONS:
            raise ValueError(f"unknown pii_action: {self.pii_action}")

    @property
    def rate_limited(self) -> bool:
        return self.rate_limit_requests > 0 or self.rate_limit_tokens > 0

    @classmethod
    def from_json(cls, text: str) -> PolicyConfig:
        """Read a kebab-case JSON object.

        Absent keys take their defaults, unknown keys are ignored, an absent or unknown action on
        personal data means ``log``; a value of the wrong type raises ``ValueError``.
        """
        try:
            raw = json.loads(text)
        except json.JSONDecodeError as e:
            raise ValueError(f"malformed policy: {e}") from e
        if not isinstance(raw, dict):
            raise ValueError("malformed policy: not an object")
        values: dict[str, Any] = {}
        for f in fields(cls):
            key = f.name.replace("_", "-")
            if key in raw:
                values[f.name] = _checked(f.name, raw[key])
        return cls(**values)


def _checked(name: str, value: Any) -> Any:
    if name == "pii_action":
        if not isinstance(value, str):
            raise ValueError("malformed policy: pii-action must be a string")
        return value.lower() if value.lower() in PII_ACTIONS else "log"
    if name == "allowed_models":
        if not isinstance(value, list) or not all(isinstance(v, str) for v in value):
            raise ValueError("malformed policy: allowed-models must be a list of strings")
        return tuple(value)
    if name in ("max_tokens_per_request", "rate_limit_requests", "rate_limit_tokens"):
        if value is None and name == "max_tokens_per_request":
            return None
        if isinstance(value, bool) or not isinstance(value, int) or not 0 <= value < 2**32:
            raise ValueError(f"malformed policy: {name} must be an unsigned 32-bit integer")
        return value
    if not isinstance(value, bool):
        raise ValueError(f"malformed policy: {name} must be a boolean")
    return value
