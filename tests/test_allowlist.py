"""The allowlist as a table against a look at all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from reqguard.operators import allowlist as L
from reqguard.plans.policy import model_denied


def drawn(rng, n, longest):
    return ["".join(rng.choices("ab-é", k=rng.randrange(longest))) for _ in range(n)]


@pytest.mark.parametrize("seed, gram", [(1, 4), (2, 2), (3, 4)])
def test_table_equals_all_pairs(spark, seed, gram):
    rng = random.Random(seed)
    names = [*drawn(rng, 25, 9), None, "gpt-4", "gpt-4"]
    names = [n for n in names if n != "" or seed == 3]
    models = [*drawn(rng, 300, 12), None, "", "gpt", "gpt-4-turbo", "abc", "🙂gpt-4"]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(models)], "id int, model string")
    allowed = spark.createDataFrame([(n,) for n in names], "name string")
    found = {r.id: r.model_denied for r in L.with_allowlist(df, allowed, gram=gram).collect()}
    given = [n for n in names if n is not None]
    assert found == {i: m is not None and not any(m in n or n in m for n in given) for i, m in enumerate(models)}
    # The literal list gives the same.
    literal = df.withColumn("d", model_denied(F.col("model"), tuple(given)))
    assert found == {r.id: r.d for r in literal.collect()}


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "m"), (2, None)], "id int, model string")
    none = spark.createDataFrame([], "name string")
    assert [r.model_denied for r in L.with_allowlist(df, none).collect()] == [False, False]
    some = spark.createDataFrame([("x",)], "name string")
    assert L.with_allowlist(df.limit(0), some).count() == 0
    assert sorted(r.model_denied for r in L.with_allowlist(df, some).collect()) == [False, True]


def test_large_table_has_no_nested_loop(spark):
    allowed = spark.range(100_000).select(F.concat(F.lit("tenant-"), "id", F.lit("-gpt")).alias("name"))
    df = spark.range(500).select("id", F.concat(F.lit("tenant-"), F.col("id") * 397, F.lit("-gpt-4")).alias("model"))
    out = L.with_allowlist(df, allowed)
    plan = out._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    denied = {r.id for r in out.where("model_denied").collect()}
    assert denied == {i for i in range(500) if i * 397 >= 100_000}
