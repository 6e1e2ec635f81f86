"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions alone.

Each source gets a target in words.  Whole multiples of its size are complete epochs over all of its
documents; what remains is filled by documents in ascending order of their exponential keys
``-ln(u) / quality``, up to the budget.  ``u`` comes from a digest of the id and the seed, so reruns
agree.  The prefix sums over the keys are taken in two steps, over bins of key values and then within
the one bin that holds the cut, so no task ever sees a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .names import set_aside

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def text_quality(text: Column, size: Column) -> Column:
    """0.5 to 1: texts whose words run past five characters on average weigh less."""
    return F.coalesce(0.5 + 0.5 * F.least(F.lit(1.0), F.try_divide(6.0 * size, F.length(text))), F.lit(0.5))


def uniform(doc_id: Column, seed: int) -> Column:
    """A number strictly between 0 and 1 from the id: 52 bits of a digest."""
    name = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("bigint") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, pattern: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size) with ``weight`` and ``target``.

    Sources in code point order, null last, take the weights of ``pattern`` in turn and share
    ``share`` times all words; none gets more than ``cap`` times its size, and what is over goes to
    the others by weight.  That is the level at which all uncapped sources hold the same words per
    unit of weight, found in one pass over the sources in order of their capped level.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*map(F.lit, pattern))
    ranked = sizes.withColumn(
        "weight", F.get(weights, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(pattern)))).cast("bigint")
    ).withColumn("_level", cap * F.col("source_size") / F.col("weight"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    before = Window.orderBy("_level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    shared = share * F.sum("source_size").over(everything)
    capped = F.coalesce(F.sum("source_size").over(before), F.lit(0))
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = ranked.withColumn("_if_uncapped", (shared - cap * capped) / rest)
    fits = F.when(F.col("_level") >= F.col("_if_uncapped"), F.struct("_level", "_if_uncapped"))
    found = level.withColumn("_common", F.min(fits).over(everything)["_if_uncapped"])
    return found.select(
        "source",
        "source_size",
        "weight",
        F.least(cap * F.col("source_size"), F.col("_common") * F.col("weight")).cast("double").alias("target"),
    )


def sized(docs: DataFrame, doc_id: str, text: str, source: str, seed: int, quality: Column | None = None) -> DataFrame:
    """``docs`` with ``_size``, ``_key``, ``_bin``: words, exponential key, bin of the key (by ``bins``)."""
    size = word_count(F.col(text))
    with_size = docs.withColumn("_size", size)
    weight = text_quality(F.col(text), F.col("_size")) if quality is None else quality
    return with_size.withColumn("_key", -F.log(uniform(F.col(doc_id), seed)) / weight)


def key_bin(key: Column, bins: int) -> Column:
    """Bins of about equal numbers of documents, in the order of the keys."""
    return F.floor((1.0 - F.exp(-key)) * bins).cast("int")


def cuts(rows: DataFrame, bins: int = 4096) -> DataFrame:
    """From rows (source, size, key): the sources with their targets, epochs and the last key taken.

    A document is taken beyond the epochs iff its key is at most ``cut_key``.  The document on the
    budget is taken when at least half of it fits, so a source misses its target by no more than
    half of one document (rows that share an id share a key and a fate).
    """
    binned = rows.withColumn("bin", key_bin(F.col("key"), bins))
    by_bin = stored(binned.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")))
    sources = targets(by_bin.groupBy("source").agg(F.sum("bin_size").alias("source_size")))
    size = F.col("source_size")
    epochs = F.coalesce(F.floor(F.try_divide(F.col("target"), size)), F.lit(0)).cast("bigint")
    sources = stored(
        sources.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * size)
    )
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins_before = by_bin.withColumn("before", F.coalesce(F.sum("bin_size").over(upto), F.lit(0)))
    s, b = sources.alias("s"), bins_before.alias("b")
    edge = (
        s.join(b, F.expr("s.source <=> b.source"))
        .where("b.before <= s.rest and s.rest < b.before + b.bin_size")
        .groupBy("s.source")
        .agg(F.max("b.bin").alias("bin"), F.max_by("b.before", "b.bin").alias("before"), F.max("s.rest").alias("rest"))
    )
    e, r = edge.alias("e"), binned.alias("r")
    on_edge = e.join(r, F.expr("e.source <=> r.source and e.bin = r.bin")).select("e.*", "r.key", "r.size")
    same_key = on_edge.groupBy("source", "bin", "before", "rest", "key").agg(F.sum("size").alias("size"))
    running = Window.partitionBy("source", "bin").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.col("before") + F.coalesce(F.sum("size").over(running), F.lit(0))
    taken = same_key.withColumn("fits", reached + F.col("size") / 2 <= F.col("rest"))
    last = taken.groupBy("source", "bin").agg(F.max(F.when(F.col("fits"), F.col("key"))).alias("cut_key"))
    found = last.alias("l")
    return s.join(found, F.expr("s.source <=> l.source"), "left").select(
        "s.*", F.col("l.bin").alias("cut_bin"), F.col("l.cut_key").alias("cut_key")
    )


def assigned(rows: DataFrame, sources: DataFrame, bins: int = 4096) -> DataFrame:
    """``rows`` (source, size, key, ...) with ``source_size``, ``target`` and ``taken``; a narrow step.

    One row a source is joined; Spark broadcasts it while it is small and merges otherwise.
    """
    r, s = rows.alias("r"), sources.alias("s")
    at = key_bin(F.col("r.key"), bins)
    chosen = F.coalesce((at < F.col("s.cut_bin")) | (F.col("r.key") <= F.col("s.cut_key")), F.lit(False))
    copies = F.col("s.epochs") + chosen.cast("bigint")
    return r.join(s, F.expr("r.source <=> s.source"), "left").select(
        "r.*",
        F.col("s.source_size").alias("source_size"),
        F.col("s.target").alias("target"),
        copies.alias("copies"),
        (copies * F.col("r.size")).alias("taken"),
    )


def mix(
    docs: DataFrame,
    seed: int = 17,
    bins: int = 4096,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    quality: Column | None = None,
) -> DataFrame:
    """One row for each document: id, size, source_size, target, copies, taken (words).

    A null text has size 0 and is taken with 0 words; a null source is a source of its own; rows
    that share an id share a key; an empty table gives no rows.  Other columns are not read.
    """
    keyed = sized(docs, doc_id, text, source, seed, quality)
    rows = stored(
        keyed.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            F.col("_size").alias("size"),
            F.col("_key").alias("key"),
        )
    )
    return assigned(rows, stored(cuts(rows, bins)), bins)


def mixed(docs: DataFrame, seed: int = 17, bins: int = 4096, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its own columns.

    A null or empty text has size 0 and comes as often as its place in the order says; rows without
    a source are a source of their own.  Rows of one id, null among them, share a key: of equal
    quality, they are taken or left together.  A source of size 0 gives no rows, and so does an
    empty table.  Columns named ``_size`` or ``_key`` come out as they went in.
    """
    names = docs.columns
    docs = set_aside(docs, "_size", "_key")
    keyed = sized(docs, doc_id, text, source, seed)
    slim = stored(keyed.select(F.col(source).alias("source"), F.col("_size").alias("size"), F.col("_key").alias("key")))
    sources = cuts(slim, bins)
    whole = F.struct(*[F.col(c) for c in docs.columns])
    rows = keyed.select(whole.alias("row"), F.col(source).alias("source"), F.col("_size").alias("size"), F.col("_key").alias("key"))
    repeated = assigned(rows, stored(sources), bins).withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    return repeated.where("copies > 0").select("row.*").toDF(*names)
