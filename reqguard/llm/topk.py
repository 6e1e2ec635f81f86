"""Exact top-k search by inner product with a three-phase uniform threshold.

A vector's components are dealt in turn to two lists, so a score is the sum of one partial score
from each list, and a list knows nothing of the other.  Vectors lie in chunks and queries in blocks
of bounded size; all work is done on tiles (list, chunk, block), and no task sees more than a tile.

1. Every list gathers its k best partial scores for each query.  The scores of these candidates are
   resolved; the k-th best, tau, is a cutoff that the k-th best of all cannot be below.
2. tau goes to all tiles.  A vector that reaches tau has at least half of it in one list, so each
   list puts out all of its entries from tau / 2 on, and nothing else can matter.  Entries that both
   lists have put out are whole scores, and make the cutoff sharper.
3. An entry that only one list put out is less than tau / 2 in the other.  If even that would not
   reach the sharper cutoff it goes; the missing half of all others is looked up.

Arithmetic is on integers, exact at any size: in doubles where products and sums stay below 2**53,
in integers of any length elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

LISTS = 2
CHUNK_ROWS = 4096
CHUNK_NUMBERS = 1 << 20
BLOCK_QUERIES = 1024
# Chunks that meet one copy of a block, and lists of best entries merged by one task.
NEIGHBOURS = 64
LEAST, MOST = -(1 << 63), (1 << 63) - 1

#: A candidate of a query: which query of its block, where the vector lies, its score and id.
ENTRY = np.dtype([("q", "i4"), ("at", "i4"), ("chunk", "i8"), ("s", "i8"), ("id", "i8"), ("null", "u1")])
#: A row's place and id.
KEY = np.dtype([("chunk", "i8"), ("at", "i8"), ("id", "i8"), ("null", "u1")])

_PIECE = "list int, chunk bigint, keys binary, width int, ints binary"
_FOUND = "list int, chunk bigint, block bigint, entries binary"


def _packed(numbers: np.ndarray) -> bytes:
    """Rows of integers, in four bytes each where they fit."""
    small = not numbers.size or (numbers.min() >= -(1 << 31) and numbers.max() < 1 << 31)
    return numbers.astype("i4" if small else "i8").tobytes()


def _unpacked(data: bytes, rows: int, width: int) -> np.ndarray:
    kind = "i8" if len(data) == 8 * rows * width and rows * width else "i4"
    return np.frombuffer(data, kind).reshape(rows, width)


def _integers(values: np.ndarray) -> np.ndarray:
    scaled = np.floor(values.astype(np.float64) * 1024.0)
    out = np.clip(scaled, -(2.0**63), 2.0**62).astype(np.int64)
    out[scaled > 2.0**62] = [min(int(x), MOST) for x in scaled[scaled > 2.0**62]]
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of vectors, each cut into its lists; a chunk's number is its partition's and its place there."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        ids, vectors = batch.column(0), batch.column(1)
        size = np.diff(np.asarray(vectors.offsets)).astype(np.int64)
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        begin = np.concatenate([[0], np.cumsum(size)])
        lo = 0
        while lo < len(batch):
            widest = np.maximum.accumulate(size[lo : lo + CHUNK_ROWS])
            rows = max(1, int((widest * np.arange(1, len(widest) + 1) <= CHUNK_NUMBERS).sum()))
            width = int(widest[rows - 1])
            of = np.repeat(np.arange(rows), size[lo : lo + rows])
            place = np.arange(begin[lo], begin[lo + rows]) - np.repeat(begin[lo : lo + rows], size[lo : lo + rows])
            numbers = np.zeros((rows, width), np.int64)
            numbers[of, place] = _integers(flat[begin[lo] : begin[lo + rows]])
            keys = np.zeros(rows, KEY)
            part = ids.slice(lo, rows)
            keys["chunk"], keys["at"] = number, np.arange(rows)
            keys["id"] = part.fill_null(0).to_numpy()
            keys["null"] = part.is_null().to_numpy(zero_copy_only=False)
            halves = [np.ascontiguousarray(numbers[:, k::LISTS]) for k in range(LISTS)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(LISTS), pa.int32()),
                    pa.array([number] * LISTS, pa.int64()),
                    pa.array([keys.tobytes()] * LISTS, pa.binary()),
                    pa.array([h.shape[1] for h in halves], pa.int32()),
                    pa.array([_packed(h) for h in halves], pa.binary()),
                ],
                ["list", "chunk", "keys", "width", "ints"],
            )
            number += 1
            lo += rows


def _query_rows(batches: Iterator[pa.RecordBatch], every: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in batch.to_pylist():
            keys = np.frombuffer(piece["keys"], KEY)
            ints = _unpacked(piece["ints"], len(keys), piece["width"])
            rows = np.flatnonzero((keys["null"] == 0) & (keys["id"] % every == 0))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([piece["list"]] * len(rows), pa.int32()),
                    pa.array([piece["chunk"]] * len(rows), pa.int64()),
                    pa.array(keys["at"][rows]),
                    pa.array([keys[k].tobytes() for k in rows], pa.binary()),
                    pa.array([ints[k].astype("i8").tobytes() for k in rows], pa.binary()),
                ],
                ["list", "chunk", "at", "key", "ints"],
            )


def _block(group: tuple, table: pa.Table) -> pa.Table:
    """One block of queries of one list, in the order of their places (the same in both lists)."""
    table = table.sort_by([("chunk", "ascending"), ("at", "ascending")])
    keys = np.frombuffer(b"".join(table["key"].to_pylist()), KEY)
    rows = [np.frombuffer(x, "i8") for x in table["ints"].to_pylist()]
    numbers = np.zeros((len(rows), max(map(len, rows))), np.int64)
    for k, row in enumerate(rows):
        numbers[k, : len(row)] = row
    return pa.table(
        {
            "list": pa.array([group[0].as_py()], pa.int32()),
            "block": pa.array([group[1].as_py()], pa.int64()),
            "q_keys": pa.array([keys.tobytes()], pa.binary()),
            "q_width": pa.array([numbers.shape[1]], pa.int32()),
            "q_ints": pa.array([_packed(numbers)], pa.binary()),
        }
    )


def _bound(numbers: np.ndarray) -> int:
    return max(abs(int(numbers.min())), abs(int(numbers.max()))) if numbers.size else 0


def _scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """All inner products; numbers that only the wider side has count as multiplied by zero."""
    width = min(queries.shape[1], vectors.shape[1])
    a, b = queries[:, :width], vectors[:, :width]
    if width * _bound(a) * _bound(b) < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return _saturated(a.astype(object) @ b.astype(object).T)


def _paired(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows."""
    width = min(queries.shape[1], vectors.shape[1])
    a, b = queries[:, :width], vectors[:, :width]
    if width * _bound(a) * _bound(b) < 1 << 53:
        return np.einsum("ij,ij->i", a.astype(np.float64), b.astype(np.float64)).astype(np.int64)
    return _saturated((a.astype(object) * b.astype(object)).sum(axis=1))


def _saturated(scores: np.ndarray) -> np.ndarray:
    """Numbers of any length as longs; beyond their range, its ends."""
    return np.clip(scores, LEAST, MOST).astype(np.int64)


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a + b
    over = ((a ^ out) & (b ^ out)) < 0
    out[over] = np.where(a[over] < 0, LEAST, MOST)
    return out


def _half(tau: np.ndarray) -> np.ndarray:
    """The least integers that are half of ``tau`` at least; all integers where there is no cutoff."""
    return np.where(tau == LEAST, LEAST, (tau >> 1) + (tau & 1))


class _Tile:
    """Queries of a block and vectors of a chunk, in one list."""

    def __init__(self, row: dict) -> None:
        self.list, self.chunk, self.block = row["list"], row["chunk"], row["block"]
        self.keys = np.frombuffer(row["keys"], KEY)
        self.vectors = _unpacked(row["ints"], len(self.keys), row["width"])
        self.q_keys = np.frombuffer(row["q_keys"], KEY)
        self.queries = _unpacked(row["q_ints"], len(self.q_keys), row["q_width"])

    def scored(self) -> tuple[np.ndarray, np.ndarray]:
        """All partial scores, and which of them are a query with itself."""
        own = np.zeros((len(self.q_keys), len(self.keys)), bool)
        here = np.flatnonzero(self.q_keys["chunk"] == self.chunk)
        own[here, self.q_keys["at"][here]] = True
        return _scores(self.queries, self.vectors), own

    def entries(self, q: np.ndarray, at: np.ndarray, s: np.ndarray) -> np.ndarray:
        out = np.zeros(len(q), ENTRY)
        out["q"], out["at"], out["chunk"], out["s"] = q, at, self.chunk, s
        out["id"], out["null"] = self.keys["id"][at], self.keys["null"][at]
        return out


def best(entries: np.ndarray, k: int) -> np.ndarray:
    """The k best entries of each query: by score, then id (null last), then place."""
    order = np.lexsort((entries["at"], entries["chunk"], entries["id"], entries["null"], ~entries["s"], entries["q"]))
    entries = entries[order]
    first = np.flatnonzero(np.diff(entries["q"], prepend=-1))
    rank = np.arange(len(entries)) - np.repeat(first, np.diff(first, append=len(entries)))
    return entries[rank < k]


def _found_batch(rows: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(columns[0], pa.int32()),
            pa.array(columns[1], pa.int64()),
            pa.array(columns[2], pa.int64()),
            pa.array([e.tobytes() for e in columns[3]], pa.binary()),
        ],
        ["list", "chunk", "block", "entries"],
    )


def _local_best(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Phase 1: the k best partial scores of every query in a tile."""
    for batch in batches:
        for row in batch.to_pylist():
            tile = _Tile(row)
            scores, own = tile.scored()
            n, take = scores.shape[1], min(scores.shape[1], k)
            scores[own] = LEAST
            # Ties at the edge are of no matter here: any k candidates give a safe cutoff.
            top = np.argpartition(scores, n - take, axis=1)[:, n - take :] if take else np.zeros((len(scores), 0), int)
            q = np.repeat(np.arange(len(scores)), take)
            at = top.reshape(-1)
            others = ~own[q, at]
            entries = tile.entries(q[others], at[others], scores[q, at][others])
            yield _found_batch([(tile.list, tile.chunk, tile.block, entries)])


def _from_cutoff(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phase 2: the entries of a tile with half of the cutoff or more."""
    for batch in batches:
        for row in batch.to_pylist():
            tile = _Tile(row)
            scores, own = tile.scored()
            half = _half(np.frombuffer(row["tau"], "i8"))
            q, at = np.nonzero((scores >= half[:, None]) & ~own)
            yield _found_batch([(tile.list, tile.chunk, tile.block, tile.entries(q, at, scores[q, at]))])


def _looked_up(batches: Iterator[pa.RecordBatch], k: int | None) -> Iterator[pa.RecordBatch]:
    """Whole scores of entries that lack this list's part; the k best of each query in the tile, if ``k`` is given."""
    for batch in batches:
        for row in batch.to_pylist():
            tile = _Tile(row)
            entries = np.frombuffer(row["entries"], ENTRY).copy()
            for lo in range(0, len(entries), CHUNK_ROWS):
                part = entries[lo : lo + CHUNK_ROWS]
                part["s"] = _added(part["s"], _paired(tile.queries[part["q"]], tile.vectors[part["at"]]))
            yield _found_batch([(tile.list, tile.chunk, tile.block, best(entries, k) if k else entries)])


def _joined_lists(k: int) -> Callable:
    """Of the entries of both lists in a chunk: whole scores (list -1), and those that lack a list (its number)."""

    def join(group: tuple, table: pa.Table) -> pa.Table:
        chunk, block = group[0].as_py(), group[1].as_py()
        of = np.concatenate(
            [np.full(len(e) // ENTRY.itemsize, n) for n, e in zip(table["list"].to_pylist(), table["entries"].to_pylist(), strict=True)]
        )
        entries = np.frombuffer(b"".join(table["entries"].to_pylist()), ENTRY)
        order = np.lexsort((of, entries["at"], entries["q"]))
        entries, of = entries[order], of[order]
        both = np.zeros(len(entries), bool)
        both[:-1] = (entries["q"][1:] == entries["q"][:-1]) & (entries["at"][1:] == entries["at"][:-1])
        second = np.zeros(len(entries), bool)
        second[1:] = both[:-1]
        whole = entries[both].copy()
        whole["s"] = _added(whole["s"], entries["s"][second])
        out = [(-1, chunk, block, best(whole, k))]
        for n in range(LISTS):
            out.append((1 - n, chunk, block, entries[~both & ~second & (of == n)]))
        return pa.Table.from_batches([_found_batch(out)])

    return join


def _merged(found: DataFrame, k: int, steps: int) -> DataFrame:
    """The k best entries of every query of a (list, block), merged in a tree of bounded groups."""

    def merge(group: tuple, table: pa.Table) -> pa.Table:
        entries = np.frombuffer(b"".join(table["entries"].to_pylist()), ENTRY)
        number, part, block = (g.as_py() for g in group)
        return pa.Table.from_batches([_found_batch([(number, part, block, best(entries, k))])])

    # Chunks are dealt over parts by hash, so that a part is met by about as many lists as any other.
    parts = F.pmod(F.xxhash64("chunk"), F.lit(NEIGHBOURS**steps))
    found = found.withColumn("chunk", parts)
    for _ in range(steps + 1):
        # The last step has one part left.
        found = found.groupBy("list", "chunk", "block").applyInArrow(merge, _FOUND)
        found = found.withColumn("chunk", F.floor(F.col("chunk") / NEIGHBOURS).cast("bigint"))
    return found


def _cutoffs(candidates: DataFrame, blocks: DataFrame, k: int, known: DataFrame | None = None) -> DataFrame:
    """block, tau: for each query of a block the k-th best whole score among ``candidates`` (or what is known, if better)."""

    def cut(group: tuple, table: pa.Table) -> pa.Table:
        entries = np.frombuffer(b"".join(x for x in table["entries"].to_pylist() if x), ENTRY)
        # A candidate of both lists stands twice.
        entries = np.unique(entries[["q", "chunk", "at", "s", "id", "null"]]).astype(ENTRY)
        top = best(entries, k)
        n = max(len(x) // KEY.itemsize for x in table["q_keys"].to_pylist())
        tau = np.full(n, LEAST, np.int64)
        for x in table["tau"].to_pylist():
            if x:
                tau = np.maximum(tau, np.frombuffer(x, "i8"))
        last = np.concatenate([np.diff(top["q"]) != 0, [True]]) if len(top) else np.zeros(0, bool)
        full = np.bincount(top["q"], minlength=n)[top["q"][last]] == k
        at = top["q"][last][full]
        tau[at] = np.maximum(tau[at], top["s"][last][full])
        return pa.table({"block": [group[0].as_py()], "tau": pa.array([tau.tobytes()], pa.binary())})

    nothing = F.lit(None).cast("binary")
    given = blocks.where("list = 0").select("block", nothing.alias("entries"), "q_keys", nothing.alias("tau"))
    rows = given.unionByName(
        candidates.select("block", "entries", F.lit(b"").alias("q_keys"), nothing.alias("tau"))
    )
    if known is not None:
        rows = rows.unionByName(known.select("block", nothing.alias("entries"), F.lit(b"").alias("q_keys"), "tau"))
    return rows.groupBy("block").applyInArrow(cut, "block bigint, tau binary")


def _requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of the best of a list, by the chunk they lie in and the list they lack."""
    for batch in batches:
        for row in batch.to_pylist():
            entries = np.frombuffer(row["entries"], ENTRY)
            rows = [(1 - row["list"], int(c), row["block"], entries[entries["chunk"] == c]) for c in np.unique(entries["chunk"])]
            yield _found_batch(rows)


def _pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries whose other half, below half of the first cutoff, may yet bring them to the second."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            entries = np.frombuffer(row["entries"], ENTRY)
            tau, sharp = (np.frombuffer(row[c], "i8") for c in ("tau", "sharp"))
            # Without a cutoff every entry was put out, and none lacks a half.
            other = _half(tau)[entries["q"]] - 1
            able = _added(entries["s"], other) >= sharp[entries["q"]]
            rows.append((row["list"], row["chunk"], row["block"], entries[able]))
        yield _found_batch([r for r in rows if len(r[3])])


def _ranked(group: tuple, table: pa.Table, k: int) -> pa.Table:
    entries = best(np.frombuffer(b"".join(x for x in table["entries"].to_pylist() if x), ENTRY), k)
    keys = np.frombuffer(b"".join(table["q_keys"].to_pylist()), KEY)
    first = np.flatnonzero(np.diff(entries["q"], prepend=-1))
    rank = np.arange(len(entries)) - np.repeat(first, np.diff(first, append=len(entries))) + 1
    return pa.table(
        {
            "query_id": pa.array(keys["id"][entries["q"]]),
            "rank": pa.array(rank.astype("i4")),
            "vec_id": pa.array(entries["id"], mask=entries["null"] == 1),
            "score": pa.array(entries["s"]),
        }
    )


def top_k(
    vectors: DataFrame, k: int = 10, every: int = 100, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of all other rows for every row whose id ``every`` divides.

    Components become floor(1024 * x); a score is the inner product, ties go to the smaller id (a
    null id last).  A vector that is null, or holds a null, a NaN or an infinity, takes no part.  A
    row without an id is no query, but can be found.  Repeated rows are rows of their own: each
    is a query, and finds the others.  A vector shorter than another counts as if zeros followed; an
    empty one scores 0.  Components and scores beyond a long are held at its ends.  With fewer than
    ``k`` other rows all of them come out; without queries, or from an empty table, none.  Other
    columns are not read.
    """
    numbers = F.transform(F.col(embedding), lambda x: x.cast("double"))
    finite = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    slim = vectors.where(F.col(embedding).isNotNull() & F.coalesce(finite, F.lit(False)))
    slim = slim.select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).cast("array<double>").alias("x"))
    pieces = stored(slim.mapInArrow(_chunks, _PIECE))
    rows = stored(
        pieces.mapInArrow(lambda b: _query_rows(b, every), "list int, chunk bigint, at bigint, key binary, ints binary")
    )
    n_blocks = -(-rows.where("list = 0").count() // BLOCK_QUERIES) or 1
    n_chunks = pieces.where("list = 0").count()
    of_block = F.pmod(F.xxhash64("chunk", "at"), F.lit(n_blocks)).alias("block")
    blocks = stored(
        rows.withColumn("block", of_block).groupBy("list", "block").applyInArrow(
            _block, "list int, block bigint, q_keys binary, q_width int, q_ints binary"
        )
    )
    # A tile's sides meet by (list, block, part), where a part has a bounded number of chunks.
    n_parts = -(-n_chunks // NEIGHBOURS) or 1
    steps = 0
    while NEIGHBOURS ** (steps + 1) < n_chunks:
        steps += 1
    part = F.pmod(F.xxhash64("chunk"), F.lit(n_parts))
    all_blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint")))
    left = pieces.withColumn("part", part).withColumn("block", all_blocks)
    every_part = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_parts - 1).cast("bigint")))

    def tiles(of: DataFrame) -> DataFrame:
        return left.join(of.withColumn("part", every_part), ["list", "block", "part"])

    def looked_up(entries: DataFrame, most: int | None) -> DataFrame:
        asked = entries.join(pieces, ["list", "chunk"]).join(blocks, ["list", "block"])
        return asked.mapInArrow(lambda b: _looked_up(b, most), _FOUND)

    # 1. The best of each list, their whole scores, the cutoff.
    firsts = _merged(tiles(blocks).mapInArrow(lambda b: _local_best(b, k), _FOUND), k, steps)
    candidates = looked_up(firsts.mapInArrow(_requests, _FOUND), None)
    tau = stored(_cutoffs(candidates, blocks, k))
    # 2. Entries from half of the cutoff on, and the sharper cutoff.
    entries = tiles(blocks.join(tau, "block")).mapInArrow(_from_cutoff, _FOUND)
    joined = stored(entries.groupBy("chunk", "block").applyInArrow(_joined_lists(k), _FOUND))
    whole = stored(_merged(joined.where("list = -1"), k, steps))
    sharp = _cutoffs(whole, blocks, k, tau).withColumnRenamed("tau", "sharp")
    # 3. The missing halves of what may reach it.
    lacking = joined.where("list >= 0").join(stored(sharp.join(tau, "block")), "block").mapInArrow(_pruned, _FOUND)
    resolved = looked_up(lacking, k).withColumn("list", F.lit(-1))
    results = _merged(resolved.unionByName(whole), k, steps).select("block", "entries", F.lit(b"").alias("q_keys"))
    given = blocks.where("list = 0").select("block", F.lit(b"").alias("entries"), "q_keys")
    return results.unionByName(given).groupBy("block").applyInArrow(
        lambda group, table: _ranked(group, table, k), "query_id bigint, rank int, vec_id bigint, score bigint"
    )
