"""Token and cost estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: price per 1,000 tokens; first model substring that fits wins ---------------
PRICES: tuple[tuple[str, str, float], ...] = (
    ("openai", "gpt-4o", 0.005),
    ("openai", "gpt-4-turbo", 0.01),
    ("openai", "gpt-4", 0.03),
    ("openai", "gpt-3.5", 0.0005),
    ("anthropic", "opus", 0.015),
    ("anthropic", "sonnet", 0.003),
    ("anthropic", "haiku", 0.00025),
)
DEFAULT_PRICE = 0.01
BYTES_PER_TOKEN = 4
# --- end of fixed values ----------------------------------------------------------------------


def estimate_tokens(req: Column) -> Column:
    """Bytes of all contents, roles and the system prompt over four, rounded up.

    The total passes through a 32-bit float, which rounds totals beyond 2^24 bytes.
    """
    n_bytes = F.aggregate(
        req["messages"],
        F.lit(0).cast("bigint"),
        lambda acc, m: acc + F.octet_length(m["content"]) + F.octet_length(m["role"]),
    ) + F.coalesce(F.octet_length(req["system_prompt"]), F.lit(0))
    return F.ceil(n_bytes.cast("float") / F.lit(BYTES_PER_TOKEN))


def price_per_1k(provider: Column, model: Column) -> Column:
    """Input price for a provider and model."""
    price = F
    for name, part, value in PRICES:
        price = price.when((provider == name) & model.contains(part), F.lit(value))
    return price.otherwise(F.lit(DEFAULT_PRICE))


def estimate_cost(provider: Column, model: Column, tokens: Column) -> Column:
    """Estimated cost in dollars (double)."""
    return tokens.cast("double") / F.lit(1000.0) * price_per_1k(provider, model)


def cost_text(cost: Column) -> Column:
    """Six decimals, rounding the exact binary value half to even.

    ``format_string('%.6f')`` rounds the shortest decimal form instead, which differs at ties.  The
    rounding error of ``cost * 1e6`` is recovered exactly by splitting ``cost`` into halves whose
    products with 1e6 need no rounding, and decides the ties.
    """
    scale = F.lit(1000000.0)
    scaled = cost * scale
    shifted = cost * F.lit(134217729.0)  # 2^27 + 1
    high = shifted - (shifted - cost)
    error = (high * scale - scaled) + (cost - high) * scale
    whole = F.floor(scaled)
    rest = scaled - whole
    up = (
        (rest > 0.5)
        | ((rest == 0.5) & (error > 0))
        | ((rest == 0.5) & (error == 0) & (whole % 2 == 1))
    )
    micros = whole + F.when(up, 1).otherwise(0)
    return F.format_string("%d.%06d", F.floor(micros / 1000000), micros % 1000000)
