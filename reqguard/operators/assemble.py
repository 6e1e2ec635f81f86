"""Header and chunk events -> whole requests.

For one id, events in order of ``seq`` drive a two-state machine: a header opens a request (and
drops an unfinished one), chunks are appended while it is open, the chunk marked last closes it.
Headers and last chunks are the *markers*; a chunk belongs to a finished request iff the marker
before it is a header and the marker at or after it is a last chunk.

Ids may be reused without bound (a default id can carry a large share of a log), so the events of
an id are cut into blocks of consecutive ``seq`` values.  A small summary of every block tells
each block which marker precedes and which follows it; the events themselves are shuffled by
(id, block), and once more by (id, opening header) to be joined up.

A log that arrives run by run is assembled as if it were one: a run hands on the events of the
requests it leaves open, which enter the next run with their own ``seq``.  ``event_fates`` accounts
for every event, also those that no request holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.encoding import decode_base64_strict, is_utf8
from ..session import stored

BLOCK_SIZE = 100_000


# A marker is one number, twice its ``seq`` plus one for a header, so that the nearest marker on
# either side is a plain minimum or maximum.


def _marker(is_header: Column, is_last: Column) -> Column:
    code = F.col("_seq") * 2 + F.when(is_header, 1).otherwise(0)
    return F.when(is_header | is_last, code)


def _marks_header(marker: Column) -> Column:
    return F.pmod(marker, F.lit(2)) == 1


def _marker_seq(marker: Column) -> Column:
    return F.shiftright(marker, 1)


def _events(headers: DataFrame, chunks: DataFrame, seq: str | None, block_size: int) -> DataFrame:
    """Both inputs as one table of (_id, _seq, _block, _marker, header, data)."""
    head_seq = F.col(seq) if seq else F.lit(-1)
    chunk_seq = F.col(seq) if seq else F.col("chunk_index")
    fields = [c for c in headers.columns if c not in ("correlation_id", seq)]
    head_rows = headers.select(
        F.col("correlation_id").alias("_id"),
        head_seq.cast("bigint").alias("_seq"),
        F.lit(True).alias("_is_header"),
        F.lit(False).alias("_is_last"),
        F.struct(*fields).alias("header"),
    )
    chunk_rows = chunks.select(
        F.col("correlation_id").alias("_id"),
        chunk_seq.cast("bigint").alias("_seq"),
        F.lit(False).alias("_is_header"),
        F.coalesce(F.col("is_last"), F.lit(False)).alias("_is_last"),
        F.col("data"),
    )
    both = head_rows.unionByName(chunk_rows, allowMissingColumns=True)
    return both.withColumn("_block", F.expr(f"(_seq - pmod(_seq, {block_size}L)) div {block_size}L")).withColumn(
        "_marker", _marker(F.col("_is_header"), F.col("_is_last"))
    )


def _with_neighbours(events: DataFrame) -> DataFrame:
    """Add ``_before`` and ``_after``: the nearest markers strictly before and after each event."""
    summary = events.groupBy("_id", "_block").agg(
        F.max("_marker").alias("_last"), F.min("_marker").alias("_first")
    )
    by_block = Window.partitionBy("_id").orderBy("_block")
    by_block_back = Window.partitionBy("_id").orderBy(F.col("_block").desc())
    earlier = (Window.unboundedPreceding, -1)
    carried = summary.withColumn(
        "_prior", F.last("_last", ignorenulls=True).over(by_block.rowsBetween(*earlier))
    ).withColumn("_next", F.last("_first", ignorenulls=True).over(by_block_back.rowsBetween(*earlier)))

    # The carried markers enter each block as two extra rows at its outer ends.
    edges = carried.select(
        "_id",
        "_block",
        F.explode(
            F.array(
                F.struct(F.lit(-1).alias("edge"), F.col("_prior").alias("marker")),
                F.struct(F.lit(1).alias("edge"), F.col("_next").alias("marker")),
            )
        ).alias("_e"),
    ).select("_id", "_block", F.col("_e.edge").alias("_edge"), F.col("_e.marker").alias("_marker"))
    edges = edges.where(F.col("_marker").isNotNull())
    rows = events.withColumn("_edge", F.lit(0)).unionByName(edges, allowMissingColumns=True)

    forward = Window.partitionBy("_id", "_block").orderBy("_edge", "_seq")
    backward = Window.partitionBy("_id", "_block").orderBy(F.col("_edge").desc(), F.col("_seq").desc())
    return (
        rows.withColumn("_before", F.last("_marker", ignorenulls=True).over(forward.rowsBetween(*earlier)))
        .withColumn("_after", F.last("_marker", ignorenulls=True).over(backward.rowsBetween(*earlier)))
        .where(F.col("_edge") == 0)
        .drop("_edge")
    )


def assemble_requests(
    headers: DataFrame, chunks: DataFrame, seq: str | None = "seq", block_size: int = BLOCK_SIZE
) -> DataFrame:
    """Finished requests: correlation_id, opened_seq, the header's fields, body, body_is_utf8.

    ``seq`` names the arrival order, unique within an id; without one, headers come first and
    chunks follow by ``chunk_index``.  Chunks that are not canonical base64 add nothing to the
    body but still end it.  The body is a string holding the raw bytes; ``body_is_utf8`` tells
    whether they are valid.
    """
    return _finished(_with_neighbours(_events(headers, chunks, seq, block_size)))


def _in_open() -> Column:
    """Whether an event belongs to a request, finished or not."""
    return F.col("_is_header") | F.coalesce(_marks_header(F.col("_before")), F.lit(False))


def _closed() -> Column:
    """Whether the next marker from an event on is a last chunk."""
    return F.col("_is_last") | F.coalesce(~_marks_header(F.col("_after")), F.lit(False))


def _still_open() -> Column:
    return _in_open() & ~F.col("_is_last") & F.col("_after").isNull()


def _finished(rows: DataFrame) -> DataFrame:
    """Requests of events that know their neighbours (``_with_neighbours``)."""
    opened = F.when(F.col("_is_header"), F.col("_seq")).otherwise(_marker_seq(F.col("_before")))
    body_rows = rows.where(_in_open() & _closed()).select(
        "_id",
        opened.alias("_opened"),
        "_seq",
        "_is_header",
        "header",
        decode_base64_strict(F.col("data")).alias("_bytes"),
    )
    whole = body_rows.groupBy("_id", "_opened").agg(
        # One row of a request is its header; a struct that holds a map cannot be ordered.
        F.max_by("header", F.when(F.col("_is_header"), 1)).alias("header"),
        F.expr("listagg(_bytes) WITHIN GROUP (ORDER BY _seq)").alias("_body"),
    )
    body = F.coalesce(F.col("_body").cast("string"), F.lit(""))
    return whole.select(
        F.col("_id").alias("correlation_id"),
        F.col("_opened").alias("opened_seq"),
        "header.*",
        body.alias("body"),
        is_utf8(body).alias("body_is_utf8"),
    )


def in_flight(
    headers: DataFrame, chunks: DataFrame, seq: str | None = "seq", block_size: int = BLOCK_SIZE
) -> DataFrame:
    """Headers whose request is still open: no marker follows them."""
    slim = chunks.withColumn("data", F.lit(None).cast("string"))
    rows = _with_neighbours(_events(headers, slim, seq, block_size))
    return rows.where(F.col("_is_header") & F.col("_after").isNull()).select(
        F.col("_id").alias("correlation_id"), F.col("_seq").alias("opened_seq"), "header.*"
    )


def assemble_run(
    headers: DataFrame,
    chunks: DataFrame,
    carried: tuple[DataFrame, DataFrame] | None = None,
    seq: str = "seq",
    block_size: int = BLOCK_SIZE,
) -> tuple[DataFrame, tuple[DataFrame, DataFrame]]:
    """One run of a log that arrives in runs: its finished requests, and what the next run needs.

    ``carried`` is what the run before handed on: header and chunk events of the requests that were
    open, as they came.  Within an id, events of later runs have greater ``seq``; runs may cut a
    request anywhere.  Requests are those of ``assemble_requests`` over all runs together, each in
    the run that has its last chunk; the carried headers are what is in flight.  A carried request
    stays until its last chunk or another header comes: ``abandoned`` tells which have waited long.
    """
    own = ["correlation_id", "data", "is_last", seq]
    chunks = chunks.select(*own)
    if carried is not None:
        headers = headers.unionByName(carried[0].select(*headers.columns))
        chunks = chunks.unionByName(carried[1].select(*own))
    # Written once; the results read it three times, each its own columns.
    rows = stored(_with_neighbours(_events(headers, chunks, seq, block_size)))
    waiting = rows.where(_still_open())
    place = [F.col("_id").alias("correlation_id"), F.col("_seq").alias(seq)]
    open_headers = waiting.where("_is_header").select(*place, "header.*").select(*headers.columns)
    open_chunks = waiting.where("not _is_header").select(*place, "data", F.col("_is_last").alias("is_last"))
    return _finished(rows), (open_headers, open_chunks.select(*own))


def abandoned(carried: tuple[DataFrame, DataFrame], before: Column, ts: str = "timestamp") -> tuple[DataFrame, tuple]:
    """Headers of carried requests that were opened earlier than ``before``, and what is carried without them."""
    headers, chunks = carried
    old = F.coalesce(F.col(ts) < before, F.lit(False))
    gone = headers.where(old)
    left = chunks.join(gone.select("correlation_id"), "correlation_id", "left_anti")
    return gone, (headers.where(~old), left.select(*chunks.columns))


def event_fates(
    headers: DataFrame, chunks: DataFrame, seq: str | None = "seq", block_size: int = BLOCK_SIZE
) -> DataFrame:
    """correlation_id, seq, is_header, fate: one row for every event, so that none is lost unseen.

    ``finished``: part of a finished request.  ``undecodable``: a chunk of one that is not canonical
    base64 and adds nothing.  ``open``: part of a request that has no last chunk yet.  ``reset``:
    part of one that another header cut off.  ``orphan``: a chunk while no request is open.
    """
    is_bad = F.col("data").isNotNull() & decode_base64_strict(F.col("data")).isNull()
    marked = chunks.withColumn("data", F.when(is_bad, F.lit("!")))
    rows = _with_neighbours(_events(headers, marked, seq, block_size))
    fate = (
        F.when(~_in_open(), "orphan")
        .when(_closed(), F.when(F.col("data").isNotNull(), "undecodable").otherwise("finished"))
        .when(F.col("_after").isNull(), "open")
        .otherwise("reset")
    )
    return rows.select(
        F.col("_id").alias("correlation_id"), F.col("_seq").alias("seq"), F.col("_is_header").alias("is_header"), fate.alias("fate")
    )
