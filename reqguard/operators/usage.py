"""Token and cost usage reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.estimate import DEFAULT_PRICE, PRICES, estimate_cost, estimate_tokens

#: Prices over time: of the parts that a model's name contains, the one of least ``priority`` that is
#: in force counts; a part's price holds from ``valid_from`` (null: always) to its next row.
PRICE_COLUMNS = "provider string, part string, priority int, per_1k double, valid_from timestamp"


def with_estimates(parsed: DataFrame) -> DataFrame:
    """Add ``tokens`` and ``cost`` (NULL for requests that were not recognised)."""
    df = parsed.withColumn("tokens", F.when(F.col("req").isNotNull(), estimate_tokens(F.col("req"))))
    return df.withColumn("cost", estimate_cost(F.col("provider"), F.col("req.model"), F.col("tokens")))


def usage_report(parsed: DataFrame, ts: str = "ts", client: str = "client_ip") -> DataFrame:
    """Requests, tokens and cost by provider, model, client and hour.

    The projection before the aggregate keeps only the group key and two numbers, and the counts
    and sums combine on the map side, so a dominant client or model costs one partial row per task.
    """
    slim = with_estimates(parsed).select(
        "provider",
        F.col("req.model").alias("model"),
        F.col(client).alias("client"),
        F.date_trunc("hour", F.col(ts)).alias("hour"),
        "tokens",
        "cost",
    )
    return slim.groupBy("provider", "model", "client", "hour").agg(
        F.count("tokens").alias("requests"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost")
    ).where(F.col("requests") > 0)


def todays_prices(spark: SparkSession) -> DataFrame:
    """The fixed prices as a table of ``PRICE_COLUMNS`` that is in force at all times."""
    rows = [(provider, part, k, price, None) for k, (provider, part, price) in enumerate(PRICES)]
    return spark.createDataFrame(rows, PRICE_COLUMNS)


def with_prices(parsed: DataFrame, prices: DataFrame, ts: str = "ts") -> DataFrame:
    """Add ``tokens`` and ``cost`` by the price in force at each request's time.

    An as-of join by (provider, priority of the match, time).  Names are matched with price rows
    once for each distinct (provider, model), not for each request; what a name can cost at any time
    is then one short row, which requests look up.  That side is a row a name, so Spark sends it to
    all tasks while it is small, and splits a hot name otherwise.

    A request without a time has the prices that are always in force.  A model that no part fits,
    none at all, or one before any price of its parts, has the default price; so has a part whose
    row in force holds a null price.  Not recognised requests have neither tokens nor cost.
    ``parsed`` is read twice, once for names alone: pass a stored table where parsing is costly.
    """
    df = parsed.withColumn("tokens", F.when(F.col("req").isNotNull(), estimate_tokens(F.col("req"))))
    names = df.select(F.col("provider").alias("_provider"), F.col("req.model").alias("_model"))
    names = names.where(F.col("_provider").isNotNull() & F.col("_model").isNotNull()).distinct()
    always = F.lit(-(1 << 62))
    entry = F.struct(
        F.coalesce(F.unix_micros("valid_from"), always).alias("since"),
        F.col("priority").cast("int").alias("priority"),
        F.col("per_1k").alias("per_1k"),
    )
    n, p = names.alias("n"), prices.alias("p")
    fits = n.join(p, F.expr("n._provider = p.provider and contains(n._model, p.part)"))
    held = fits.groupBy("_provider", "_model").agg(F.collect_list(entry).alias("_prices"))
    us = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), always)
    return (
        df.join(held, (F.col("provider") == F.col("_provider")) & (F.col("req.model") == F.col("_model")), "left")
        .withColumn("cost", F.col("tokens").cast("double") / F.lit(1000.0) * _in_force(F.col("_prices"), us))
        .drop("_provider", "_model", "_prices")
    )


def _in_force(prices: Column, us: Column) -> Column:
    """Of a name's price rows: the least priority that has begun, and of its rows the last to begin."""
    begun = F.filter(prices, lambda x: x["since"] <= us)
    first = F.array_min(
        F.transform(begun, lambda x: F.struct(x["priority"].alias("k"), (-x["since"]).alias("later"), x["per_1k"].alias("price")))
    )
    return F.coalesce(first["price"], F.lit(DEFAULT_PRICE))
