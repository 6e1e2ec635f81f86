"""Model allowlists of any length, as a table.

A model passes if its name contains an allowed name or is contained in one.  Both are substring
searches between two sets of names, and neither compares all pairs: a name that lies in another
shares all of its grams with it, so it is looked up by one of them, the one that fewest of the
others have, and only what shares that gram is compared.  Requests meet the result by the distinct
names of their models.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 4


def _pieces(text: Column, size: Column | int) -> Column:
    """All distinct substrings of one length."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    found = F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))
    return F.when(F.length(text) >= size, found).otherwise(F.array().cast("array<string>"))


def _index(names: DataFrame, gram: int) -> DataFrame:
    """outer, gram: every name by its grams and, for names shorter than a gram, by all shorter pieces."""
    shorter = [_pieces(F.col("outer"), n) for n in range(1, gram)]
    pieces = F.concat(F.array(F.lit("")), *shorter, _pieces(F.col("outer"), gram))
    return names.select("outer", F.explode(pieces).alias("gram"))


def _keys(names: DataFrame, index: DataFrame, gram: int) -> DataFrame:
    """inner, gram: the piece by which a name is looked up; names with a gram that no other has are gone."""
    short = names.where(F.length("inner") < gram).select("inner", F.col("inner").alias("gram"))
    grams = names.where(F.length("inner") >= gram).select("inner", F.explode(_pieces(F.col("inner"), gram)).alias("gram"))
    counts = index.where(F.length("gram") == gram).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rated = grams.join(counts, "gram", "left").groupBy("inner").agg(
        F.min(F.struct("n", "gram")).alias("rarest"), F.count_if(F.col("n").isNull()).alias("missing")
    )
    return short.unionByName(rated.where("missing = 0").select("inner", F.col("rarest.gram").alias("gram")))


def fitting_models(models: DataFrame, allowed: DataFrame, gram: int = GRAM) -> DataFrame:
    """model: the distinct models that contain an allowed name or are contained in one.

    ``models`` has a column ``model``, ``allowed`` a column ``name``; nulls and repeated rows in
    either are passed over.  The empty model lies in every allowed name, the empty name in every
    model.  Names are compared by their characters, as they are.
    """
    own = models.where("model is not null").select("model").distinct()
    names = allowed.where("name is not null").select("name").distinct()
    by_name = _index(names.withColumnRenamed("name", "outer"), gram)
    by_model = _index(own.withColumnRenamed("model", "outer"), gram)
    # Models within names.
    inside = _keys(own.withColumnRenamed("model", "inner"), by_name, gram).alias("k")
    held = inside.join(by_name.alias("x"), F.expr("k.gram = x.gram and contains(x.outer, k.inner)"), "left_semi")
    # Names within models.
    keys = _keys(names.withColumnRenamed("name", "inner"), by_model, gram).alias("k")
    holding = by_model.alias("x").join(keys, F.expr("k.gram = x.gram and contains(x.outer, k.inner)"), "left_semi")
    return held.select(F.col("inner").alias("model")).unionByName(holding.select(F.col("outer").alias("model"))).distinct()


def with_allowlist(requests: DataFrame, allowed: DataFrame, model: str = "model", gram: int = GRAM) -> DataFrame:
    """Add ``model_denied``: whether a request's model is refused by the table ``allowed`` (name).

    A request without a model passes, and so does every one while the table has no name.  The rows
    are joined on their model with one row for each model that passes.  ``requests`` is read twice,
    once for the column of models alone.
    """
    fits = fitting_models(requests.select(F.col(model).alias("model")), allowed, gram)
    off = allowed.where("name is not null").isEmpty()
    if off:
        return requests.withColumn("model_denied", F.lit(False))
    marked = fits.select(F.col("model").alias("_model"), F.lit(True).alias("_fits"))
    joined = requests.join(marked, F.col(model) == F.col("_model"), "left")
    denied = F.col(model).isNotNull() & F.col("_fits").isNull()
    return joined.withColumn("model_denied", denied).drop("_model", "_fits")
