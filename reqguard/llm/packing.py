"""Length buckets of least padding, and token-budget batches inside each bucket.

Lengths are rounded up to ``align`` tokens (what a kernel pads to anyway) and documents longer than
``max_length`` are cut into pieces of that length, so the global histogram has at most
``max_length / align`` bars however many documents there are.  Dynamic programming over those bars
finds the bucket boundaries with the least padding; it is exact, and its input is one small row per
bar.  Documents never travel to one place: each gets its bucket by a lookup, and its batch from a
rank that is counted in shards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .mixing import word_count

SHARD_ROWS = 50_000


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds (ascending, the last is the largest length) of at most ``buckets`` buckets.

    ``cost[j]`` is the least number of padded tokens for the bars up to ``j``; a bucket over the
    bars ``i+1..j`` holds ``counts`` of them, each padded to ``lengths[j]``.
    """
    order = np.argsort(lengths)
    lengths, counts = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    n = len(lengths)
    if n == 0:
        return []
    upto = np.concatenate([[0], np.cumsum(counts)])
    cost = np.concatenate([[0], lengths * upto[1:]])
    choice: list[np.ndarray] = []
    for _ in range(1, min(buckets, n)):
        step = np.zeros(n + 1, np.int64)
        new = cost.copy()
        for j in range(1, n + 1):
            total = cost[:j] + lengths[j - 1] * (upto[j] - upto[:j])
            step[j] = int(np.argmin(total))
            new[j] = total[step[j]]
        choice.append(step)
        cost = new
    bounds, j = [], n
    for step in reversed(choice):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(step[j])
    if j:
        bounds.append(int(lengths[j - 1]))
    return sorted(set(bounds))


def pieces(docs: DataFrame, length: Column, max_length: int, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, piece, n_tokens): documents cut at ``max_length``; a length under 1 counts as 1."""
    n = F.greatest(F.coalesce(length, F.lit(1)), F.lit(1)).cast("bigint")
    cut = docs.select(F.col(doc_id).alias("doc_id"), n.alias("_n"))
    last = F.floor((F.col("_n") - 1) / max_length).cast("int")
    cut = cut.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    left = F.col("_n") - F.col("piece").cast("bigint") * max_length
    return cut.select("doc_id", "piece", F.least(left, F.lit(max_length)).cast("bigint").alias("n_tokens"))


def histogram(rows: DataFrame, align: int) -> DataFrame:
    bar = (F.floor((F.col("n_tokens") + (align - 1)) / align) * align).cast("bigint")
    return rows.groupBy(bar.alias("bar")).count()


def pack(
    docs: DataFrame,
    length: Column | None = None,
    buckets: int = 16,
    max_length: int = 8192,
    align: int = 8,
    budget: int = 65536,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row for each piece of a document with its bucket, batch and place in the batch.

    Columns: doc_id, piece, n_tokens, bucket (from 0), padded_length, batch (from 0 within the
    bucket), slot.  Every batch but the last of a bucket holds ``budget // padded_length`` pieces
    (one at least).  By default a document's length is its words plus an end mark, so an empty or
    null text has length 1.  Repeated rows are packed as often as they occur; an empty table gives
    no rows; ``doc_id`` may be null.  Order within a bucket is that of a hash, so reruns agree.
    """
    if length is None:
        length = word_count(F.col(text)) + 1
    spark = docs.sparkSession
    rows = stored(pieces(docs, length, max_length, doc_id))
    # At most max_length / align rows.
    bars = histogram(rows, align).toPandas()
    bounds = best_boundaries(bars["bar"].to_numpy(), bars["count"].to_numpy(), buckets)
    if not bounds:
        schema = "doc_id bigint, piece int, n_tokens bigint, bucket int, padded_length bigint, batch bigint, slot bigint"
        return spark.createDataFrame([], schema)
    bucket = F.lit(len(bounds) - 1)
    for i in reversed(range(len(bounds) - 1)):
        bucket = F.when(F.col("n_tokens") <= bounds[i], i).otherwise(bucket)
    # Enough shards that none outgrows a task, whatever share of the rows a bucket has.
    shards = max(1, int(bars["count"].sum()) // SHARD_ROWS + 1)
    mark = F.xxhash64("doc_id", "piece", "n_tokens")
    placed = rows.withColumn("bucket", bucket).withColumn("_mark", mark)
    placed = placed.withColumn("_shard", F.pmod("_mark", F.lit(shards)).cast("int"))
    before = Window.partitionBy("bucket").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("bucket", "_shard")
        .count()
        .select("bucket", "_shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    )
    within = Window.partitionBy("bucket", "_shard").orderBy("_mark", "doc_id", "piece")
    ranked = placed.withColumn("_at", F.row_number().over(within) - 1).join(offsets, ["bucket", "_shard"])
    padded = F.get(F.array(*[F.lit(b).cast("bigint") for b in bounds]), F.col("bucket"))
    capacity = F.greatest(F.floor(F.lit(budget) / padded), F.lit(1)).cast("bigint")
    rank = F.col("_before") + F.col("_at")
    return ranked.select(
        "doc_id",
        "piece",
        "n_tokens",
        "bucket",
        padded.alias("padded_length"),
        F.floor(rank / capacity).cast("bigint").alias("batch"),
        F.pmod(rank, capacity).cast("bigint").alias("slot"),
    )
