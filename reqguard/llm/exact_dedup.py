"""Exact duplicates by progressive refinement: length, then a hash of the prefix, then the full hash.

The first pass keeps three numbers a row and finds the (length, prefix) groups with more than one
row.  Which groups survived goes into a bitmap of fixed size, so the second pass can tell without a
join, and without moving any text, which rows need their full content hashed.  A false hit in the
bitmap costs one hash and no more: rows are grouped by length, prefix and digest in the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .names import set_aside

WHITE_SPACE = r"[\x20\x09-\x0D]+"
_WORD_BITS = 64


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def bitmap(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """One row with an array of ``2**bits / 64`` words whose bits mark the keys."""
    words = 1 << (bits - 6)
    slot = F.pmod(F.col(key), F.lit(1 << bits))
    marked = keys.select(
        F.floor(slot / F.lit(_WORD_BITS)).cast("int").alias("at"),
        F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(slot, F.lit(_WORD_BITS)).cast("int")).alias("w"),
    )
    nothing = keys.sparkSession.range(words).select(F.col("id").cast("int").alias("at"), F.lit(0).cast("bigint").alias("w"))
    filled = marked.unionByName(nothing).groupBy("at").agg(F.bit_or("w").alias("w"))
    return filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "w"))), lambda x: x["w"]).alias("words"))


def marked(words: Column, key: Column, bits: int) -> Column:
    slot = F.pmod(key, F.lit(1 << bits))
    word = F.get(words, F.floor(slot / F.lit(_WORD_BITS)).cast("int"))
    return F.call_function("getbit", word, F.pmod(slot, F.lit(_WORD_BITS)).cast("int")) == 1


def digests(
    docs: DataFrame, text: str = "text", prefix: int = 256, bits: int = 22, all_rows: bool = False
) -> DataFrame:
    """``docs`` with ``_length``, ``_prefix`` and ``_digest``, which decide equality.

    ``_digest`` is null where length and prefix already set a row apart from all others, unless
    ``all_rows`` asks for it.  ``bits`` sets the size of the bitmap of surviving groups
    (``2**bits / 8`` bytes, whatever the input's size); a fuller bitmap means more rows hashed.
    """
    clash = [c for c in docs.columns if c in ("_length", "_prefix", "_digest")]
    if clash:
        raise ValueError(f"columns with reserved names: {clash}")
    norm = normalised(F.col(text))
    keyed = docs.withColumns(
        {"_length": F.length(norm), "_prefix": F.xxhash64(F.substring(norm, 1, prefix))}
    )
    key = F.xxhash64("_length", "_prefix")
    # Pass 1.  Counting is combined before the shuffle, so a group of any size is a row per task.
    by_length = keyed.groupBy("_length", "_prefix").count()
    surviving = stored(bitmap(by_length.where("count > 1").select(key.alias("k")), "k", bits))
    words = surviving.select("words").scalar()
    # Pass 2.
    full = F.sha2(norm, 256)
    return keyed.withColumn("_digest", full if all_rows else F.when(marked(words, key, bits), full))


def _decided(rows: DataFrame, doc_id: str, n_chars: str, salts: int) -> DataFrame:
    """Distinct rows with how often each occurs, the id that stays, the group's size, ``_best``."""
    key = ["_length", "_prefix", "_digest"]
    rank = F.struct(
        (-F.col(n_chars)).alias("n"),
        F.col(doc_id).isNull().alias("z"),
        F.col(doc_id).alias("d"),
        F.xxhash64(*rows.columns).alias("h"),
    )
    distinct = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_copies")).withColumn("_rank", rank)
    distinct = distinct.withColumn("_salt", F.pmod(F.xxhash64(doc_id, n_chars), F.lit(salts)).cast("int"))
    # Counting is combined before the shuffle, so a group of any size is a row per task there; its
    # rows then meet the result over ``salts`` keys.
    groups = (
        distinct.groupBy(*key)
        .agg(F.sum("_copies").alias("group_size"), F.min("_rank").alias("_least"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    same = " and ".join(f"r.{k} <=> g.{k}" for k in [*key, "_salt"])
    best = F.coalesce("g._least", "r._rank")
    return distinct.alias("r").join(groups.alias("g"), F.expr(same), "left").select(
        *[f"r.{c}" for c in rows.columns],
        "r._copies",
        best["d"].alias("keep_id"),
        F.coalesce("g.group_size", "r._copies").alias("group_size"),
        (best == F.col("r._rank")).alias("_best"),
    )


def exact_duplicates(rows: DataFrame, doc_id: str = "doc_id", n_chars: str = "n_chars", salts: int = 32) -> DataFrame:
    """Each row of ``rows`` (without its text) with ``keep_id``, ``group_size`` and ``kept``.

    ``rows`` has the columns of ``digests`` and others that can be grouped by.  Of equal texts the
    row with the most characters, then the smallest id (nulls last), then the smallest hash of its
    columns stays; of rows equal in every column, one.  Empty and null texts equal each other.
    """
    clash = [c for c in rows.columns if c in ("keep_id", "group_size", "kept")]
    decided = _decided(rows.drop(*clash), doc_id, n_chars, salts)
    return decided.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "_copies"))).select(
        *[c for c in rows.columns if c not in clash],
        "keep_id",
        "group_size",
        (F.col("_best") & (F.col("_copy") == 1)).alias("kept"),
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = 32) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; repeated rows count as copies.

    A null text equals an empty one and one of white space alone.  Of equal texts the longest
    original stays, then the least id (null last), then any of rows that are the same in all columns.
    An empty table gives no rows.  Columns with names that are used here come out as they went in.
    """
    names = docs.columns
    docs = set_aside(docs, "_length", "_prefix", "_digest", "_chars", "_of")
    digested = digests(docs, text).withColumns(
        {"_chars": F.length(F.coalesce(F.col(text), F.lit(""))), "_of": F.xxhash64(*docs.columns)}
    )
    slim = digested.select(F.col(doc_id).alias("_id"), "_chars", "_of", "_length", "_prefix", "_digest")
    decided = stored(_decided(slim, "_id", "_chars", salts).where("group_size > 1"))
    # ``_of`` and ``_length`` tell rows apart without the digest.
    key = ["_of", "_length"]
    # Losers grow with the corpus, so the plan is the one for many at every size.
    drop = decided.where(~F.col("_best")).select(*key).distinct().hint("merge")
    tied = decided.where("_best and _copies > 1").select(*key)
    left = digested.join(drop, key, "left_anti")
    single = left.join(tied, key, "left_anti").select(*docs.columns)
    first = left.join(tied, key, "left_semi").dropDuplicates(key).select(*docs.columns)
    return single.unionByName(first).toDF(*names)
