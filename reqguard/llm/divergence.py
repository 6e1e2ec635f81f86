"""How far the sources of a language differ in their terms: counts by iceberg prefix refinement.

Which terms enough documents hold is found without counting all terms.  Prefixes are extended level
by level, to twice as many bytes each time.  A prefix is held by as many documents at least as any
term that begins with it; so where fewer than the threshold hold it, all terms below it go.  A term
that ends within a level is complete there: it is kept if enough documents hold it.

Texts are read once, into chunks: the terms of about 8 MB of text, sorted, and for each document
which of them it holds and how often.  A level is one narrow pass over the chunks, which counts a
document once for a prefix, and an aggregation of one row a chunk and prefix.  Living prefixes are
marked in a bitmap whose size follows their number up to a fixed bound.  The bitmap saves work and
decides nothing: a dead prefix that it lets through is counted again and dropped at the next level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import small_batches, stored
from .words import LOWER, hashes_of, paired, raw, slices

MIN_DOCUMENTS = 30
FIRST_LEVEL = 2
TOP_TERMS = 50
SCALE = 1_000_000_000
SMOOTHING = 5
CHUNK_BYTES = 8_000_000
# A chunk's text is read in parts of about this size, and its terms are hashed and its rows sent in parts of so many.
PART_BYTES = 1_000_000
PART_TERMS = PART_ROWS = 1 << 15
# At most 8 MB of bitmap; up to 4 million prefixes have 16 bits each.
LEAST_BITS, MOST_BITS = 16, 26
# Numbers in a table of one language's sources and terms that one task compares.
CELLS = 1 << 20

# Bytes of terms: ASCII letters, and all of a character beyond ASCII.
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_CHUNK = "langs array<string>, sources array<string>, docs binary, vocabulary binary, lengths binary, pairs binary, counts binary"
_ROWS = "lang string, source string, prefix binary, complete boolean, docs bigint, n bigint, mark bigint"


def _strings(data: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    wide = pa.large_binary() if kind == pa.binary() else pa.large_string()
    return pa.Array.from_buffers(wide, len(lengths), [None, pa.py_buffer(offsets.astype("i8")), pa.py_buffer(data)])


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms in order, A-Z lower-cased, and at which term each text begins (with the total at the end)."""
    data, at = raw(texts)
    inside = LETTER[data]
    n = len(data)
    if not n:
        return pa.array([], pa.large_binary()), np.zeros(len(at), np.int64)
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    # A text also ends a term.
    firsts, lasts = at[:-1][at[:-1] < n], at[1:][at[1:] > 0] - 1
    starts[firsts], ends[lasts] = inside[firsts], inside[lasts]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return _strings(LOWER[data[inside]], e - s, pa.binary()), np.searchsorted(s, at)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks: sorted vocabulary; documents by language, with their terms and counts."""
    for batch in batches:
        # Chunks of a batch are about equal, so that none is a mere rest.
        size = pc.sum(pc.binary_length(batch.column(0))).as_py() or 0
        for lo, hi in slices(batch.column(0), -(-size // max(round(size / CHUNK_BYTES), 1)) + 1):
            part = batch.slice(lo, hi - lo)
            groups, of = _codes(part.column(1), part.column(2))
            # Documents of a language stand together.
            order = np.argsort(of, kind="stable")
            part, of = part.take(pa.array(order)), of[order]
            vocabulary, held, pairs, counts = _terms_by_document(part.column(0))
            letters, at = raw_binary(vocabulary)
            row = [
                [groups[0]],
                [groups[1]],
                [np.stack([of, held]).astype("i4").tobytes()],
                [letters.tobytes()],
                [np.diff(at).astype("i4").tobytes()],
                [pairs.tobytes()],
                [counts.tobytes()],
            ]
            kinds = [pa.list_(pa.string())] * 2 + [pa.binary()] * 5
            names = ["langs", "sources", "docs", "vocabulary", "lengths", "pairs", "counts"]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names)


def _terms_by_document(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted vocabulary; how many of its terms each text holds, which these are, and how often it has them."""
    # What is made of a text takes many times its room, so only terms are kept of the parts before.
    found = [terms_of(texts.slice(lo, hi - lo)) for lo, hi in slices(texts, PART_BYTES)]
    coded = pa.chunked_array([terms for terms, _ in found], pa.large_binary()).dictionary_encode()
    begins = [begin for _, begin in found]
    del found
    vocabulary = coded.chunk(0).dictionary if coded.num_chunks else pa.array([], pa.large_binary())
    by_bytes = pc.sort_indices(vocabulary).to_numpy()
    rank = np.empty(len(by_bytes), np.int64)
    rank[by_bytes] = np.arange(len(by_bytes))
    vocabulary = vocabulary.take(pa.array(by_bytes))
    size = max(len(vocabulary), 1)
    held, pairs, counts = [np.zeros(0, np.int64)], [np.zeros(0, "i4")], [np.zeros(0, "i4")]
    for chunk, begin in zip(coded.chunks, begins, strict=True):
        doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        pair, count = np.unique(doc * size + rank[chunk.indices.to_numpy()], return_counts=True)
        held.append(np.bincount(pair // size, minlength=len(begin) - 1))
        pairs.append((pair % size).astype("i4"))
        counts.append(count.astype("i4"))
    return vocabulary, np.concatenate(held), np.concatenate(pairs), np.concatenate(counts)


def _codes(langs: pa.Array, sources: pa.Array) -> tuple[tuple[list, list], np.ndarray]:
    """The groups (lang, source) of a chunk in the order of lang, and each row's number among them."""
    names = list(zip(langs.to_pylist(), sources.to_pylist(), strict=True))
    groups = sorted(set(names))
    number = {g: k for k, g in enumerate(groups)}
    return ([g[0] for g in groups], [g[1] for g in groups]), np.array([number[g] for g in names], np.int64)


def raw_binary(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a large binary array, and where each value begins (with the end of the last)."""
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, "i8")[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, "i8")
    if data is None or not len(values):
        return np.zeros(0, np.uint8), np.zeros(len(values) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


class _Chunk:
    """Terms of a chunk by language: cells (language, term) in order, and the pairs that point to them."""

    def __init__(self, row: pa.RecordBatch) -> None:
        def numbers(name: str, kind: str = "i4") -> np.ndarray:
            """The row's bytes where they lie; none is copied."""
            return np.frombuffer(row.column(name)[0].as_buffer(), kind)

        self.sources = row.column("sources")[0].as_py()
        self.langs, of_lang = np.unique(np.array(row.column("langs")[0].as_py(), object), return_inverse=True)
        self.group, held = numbers("docs").reshape(2, -1)
        self.letters = numbers("vocabulary", "u1")
        self.length = numbers("lengths").astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.length)])
        self.n = numbers("counts")
        self.doc = np.repeat(np.arange(len(self.group), dtype="i4"), held)
        size = max(len(self.length), 1)
        key = np.repeat(of_lang[self.group] * size, held)
        key += numbers("pairs")
        cells, cell = np.unique(key, return_inverse=True)
        self.cell = cell.astype("i4")
        self.lang, self.term = cells // size, cells % size

    def marks(self, level: int) -> np.ndarray:
        """A number for each cell's language and prefix."""
        prefix = np.empty(len(self.length), np.uint64)
        for lo in range(0, len(prefix), PART_TERMS):
            hi = min(lo + PART_TERMS, len(prefix))
            first, last = self.begin[lo], self.begin[hi]
            prefix[lo:hi] = hashes_of(self.letters[first:last], self.begin[lo:hi] - first, np.minimum(self.length[lo:hi], level))
        names = [x.encode() for x in self.langs]
        letters = np.frombuffer(b"".join(names), np.uint8)
        size = np.array([len(x) for x in names], np.int64)
        lang = hashes_of(letters, np.cumsum(size) - size, size)
        return paired(lang[self.lang], prefix[self.term])

    def prefixes(self, level: int) -> np.ndarray:
        """Numbers of prefixes in the vocabulary's order; a term that ends within the level has its own."""
        cut = pc.binary_slice(_strings(self.letters, self.length, pa.binary()).cast(pa.binary()), 0, level)
        same = np.asarray(pc.equal(cut[1:], cut[:-1])) if len(cut) > 1 else np.zeros(0, bool)
        ends = self.length <= level
        return np.concatenate([[0], np.cumsum(~(same & (ends[1:] == ends[:-1])))]) if len(cut) else np.zeros(0, np.int64)

    def level(self, level: int, before: int, bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        """Counts of the prefixes of this level whose shorter prefix lives."""
        alive = np.ones(len(self.term), bool)
        if bits is not None:
            slot = self.marks(before) & np.uint64((len(bits) << 6) - 1)
            hit = (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)
            alive = (hit == 1) & (self.length[self.term] > before)
        if not alive.any():
            return
        prefix = self.prefixes(level)[self.term]
        mark = self.marks(level)
        new = np.ones(len(self.term), bool)
        new[1:] = (np.diff(prefix) != 0) | (np.diff(self.lang) != 0)
        number = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        ends = self.length[self.term] <= level
        mine = alive[self.cell]
        cell, doc = self.cell[mine], self.doc[mine]
        # A prefix that goes on: documents, each counted once.  Terms of a document are in order.
        longer = ~ends[cell]
        of, held_by = number[cell[longer]], doc[longer]
        once = np.ones(len(of), bool)
        once[1:] = (np.diff(of) != 0) | (np.diff(held_by) != 0)
        docs = np.bincount(of[once], minlength=len(first))
        some = np.flatnonzero(docs)
        yield from self._rows(first[some], None, level, False, docs[some], np.zeros(len(some), np.int64), mark)
        # A term that ends: documents and occurrences in each source.
        width = len(self.sources)
        key = cell[~longer].astype(np.int64) * width + self.group[doc[~longer]]
        n = self.n[mine][~longer]
        key, at, docs = np.unique(key, return_inverse=True, return_counts=True)
        n = np.bincount(at, weights=n, minlength=len(key)).astype(np.int64)
        yield from self._rows(key // width, key % width, level, True, docs, n, mark)

    def _rows(self, cell, group, level, complete, docs, n, mark) -> Iterator[pa.RecordBatch]:
        vocabulary = _strings(self.letters, self.length, pa.binary()).cast(pa.binary())
        names, sources = pa.array(self.langs.tolist(), pa.string()), pa.array(self.sources, pa.string())
        for lo in range(0, len(cell), PART_ROWS):
            part = slice(lo, lo + PART_ROWS)
            at = cell[part]
            words = vocabulary.take(pa.array(self.term[at]))
            columns = [
                names.take(pa.array(self.lang[at])),
                pa.nulls(len(at), pa.string()) if group is None else sources.take(pa.array(group[part])),
                words if complete else pc.binary_slice(words, 0, level),
                pa.array(np.full(len(at), complete)),
                pa.array(docs[part]),
                pa.array(n[part]),
                pa.array(mark[at].view(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "prefix", "complete", "docs", "n", "mark"])


def _level(batches: Iterator[pa.RecordBatch], level: int, before: int, bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(len(batch)):
            yield from _Chunk(batch.slice(k, 1)).level(level, before, bits)


def _bitmap(living: DataFrame, count: int) -> np.ndarray:
    """The marks of ``living`` as bits, 16 for each up to a bound; the driver gets its words and no more."""
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * count).bit_length()))
    slot = F.col("mark").bitwiseAND(F.lit((1 << bits) - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(F.lit(63)).cast("int"))
    words = living.select(F.shiftright(slot, 6).alias("at"), one.alias("w")).groupBy("at").agg(F.bit_or("w").alias("w")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["at"].to_numpy()] = words["w"].to_numpy()
    return out.view(np.uint64)


def gathered(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Chunks of ``docs`` (null counts as empty), written out."""
    slim = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))])
    # A chunk is some megabytes wide: few are held at once, each in pages of its own, and none in a dictionary.
    pages = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.enable.dictionary": "false"}
    with small_batches(docs.sparkSession, CHUNK_BYTES):
        return stored(slim.mapInArrow(_gathered, _CHUNK), **pages)


def kept_counts(chunks: DataFrame, least: int = MIN_DOCUMENTS) -> DataFrame:
    """lang, source, term, n: occurrences of the terms that ``least`` documents of their language hold at least."""
    spark = chunks.sparkSession
    level, before, bits, found = FIRST_LEVEL, 0, None, None
    while True:
        shared = spark.sparkContext.broadcast(bits)
        rows = chunks.mapInArrow(lambda b, k=level, j=before, s=shared: _level(b, k, j, s.value), _ROWS)
        counts = rows.groupBy("lang", "source", "prefix", "complete").agg(
            F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.max("mark").alias("mark")
        )
        with small_batches(spark, CHUNK_BYTES):
            counted = stored(counts)
        whole = counted.groupBy("lang", "prefix", "complete").agg(F.sum("docs").alias("docs"), F.max("mark").alias("mark"))
        living = stored(whole.where(F.col("docs") >= least))
        complete = counted.where("complete").join(living.where("complete").select("lang", "prefix"), ["lang", "prefix"])
        complete = complete.select("lang", "source", F.col("prefix").cast("string").alias("term"), "n")
        found = complete if found is None else found.unionByName(complete)
        longer = living.where("not complete")
        count = longer.count()
        if not count:
            return stored(found)
        bits, before, level = _bitmap(longer, count), level, 2 * level


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 5) / (total + 5 * terms)), exactly."""
    wide = "decimal(20,0)"
    above = (n + SMOOTHING).cast(wide) * F.lit(SCALE).cast("decimal(10,0)")
    below = (total + SMOOTHING * terms).cast(wide)
    return (F.call_function("div", above, below) + 1).cast("bigint")


def _compared(key: tuple, cells: pa.Table, sources: pa.Table) -> pa.Table:
    """Sums of |p - q| over one block of a language's terms, for each two of its sources."""
    lang = key[0].as_py()
    number = sources["number"].to_numpy()
    place = np.full(number.max() + 1 if len(number) else 0, -1)
    place[number] = np.arange(len(number))
    words = cells["term"].combine_chunks().dictionary_encode()
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    share = np.repeat(sources["absent"].to_numpy()[:, None], len(words.dictionary), axis=1)
    share[place[cells["number"].to_numpy()], words.indices.to_numpy()] = cells["p"].to_numpy()
    a, b, value = [], [], []
    for k in range(len(number) - 1):
        a.append(np.full(len(number) - k - 1, number[k]))
        b.append(number[k + 1 :])
        value.append(np.abs(share[k + 1 :] - share[k]).sum(axis=1))
    a, b, value = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, value))
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": a.astype("i8"), "b": b.astype("i8"), "value": value.astype("i8")})


def divergence(
    docs: DataFrame, least: int = MIN_DOCUMENTS, top: int = TOP_TERMS, text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """lang, source, part, item, value, rank: how a source differs from the others, and by which terms.

    Part ``pair``: every other source of the language, by the sum of |p - q| over all kept terms; all
    ranks.  Part ``term``: kept terms that the source has, and more of than the language, by p - q;
    the first ``top`` ranks.  Values descend, equal ones are in the order of the item's bytes.

    Null texts, languages and sources count as empty; an empty text has no term, but its group
    occurs.  Repeated rows are documents of their own.  A language without kept terms has pairs of
    value 0 and no terms; a source alone in its language has no pair.  An empty table gives no rows.
    Other columns are not read.
    """
    chunks = gathered(docs, text, lang, source)
    names = chunks.select(F.explode(F.arrays_zip("langs", "sources")).alias("g")).select("g.langs", "g.sources").distinct()
    counts = kept_counts(chunks, least)
    by_term = stored(counts.groupBy("lang", "term").agg(F.sum("n").alias("all")))
    by_lang = by_term.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all").alias("lang_total"))
    by_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    order = Window.partitionBy("lang").orderBy("source")
    groups = (
        names.toDF("lang", "source")
        .join(by_lang, "lang", "left")
        .join(by_group, ["lang", "source"], "left")
        .fillna(0, ["terms", "lang_total", "total"])
        .withColumn("number", F.row_number().over(order) - 1)
        .withColumn("sources", F.count(F.lit(1)).over(Window.partitionBy("lang")))
        # As many blocks of terms as keep a block's table of shares small.
        .withColumn("blocks", F.ceil(F.col("terms") * F.col("sources") / CELLS))
    )
    groups = stored(groups)
    zero = F.lit(0).cast("bigint")
    absent = F.when(F.col("terms") > 0, _share(zero, F.col("total"), F.greatest("terms", F.lit(1))))
    shares = counts.join(groups, ["lang", "source"]).join(by_term, ["lang", "term"])
    shares = stored(
        shares.select(
            "lang",
            "source",
            "number",
            "term",
            _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
            _share(F.col("all"), F.col("lang_total"), F.col("terms")).alias("q"),
            F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"),
        )
    )
    in_blocks = groups.where("terms > 0").select(
        "lang", "number", absent.alias("absent"), F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block")
    )
    sums = (
        shares.groupBy("lang", "block")
        .cogroup(in_blocks.groupBy("lang", "block"))
        .applyInArrow(_compared, "lang string, a bigint, b bigint, value bigint")
        .groupBy("lang", "a", "b")
        .agg(F.sum("value").alias("value"))
    )
    sums = stored(sums)
    both = sums.unionByName(sums.select("lang", F.col("a").alias("b"), F.col("b").alias("a"), "value"))
    one = groups.select("lang", "source", F.col("number").alias("a"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("number").alias("b"))
    pairs = one.join(other, "lang").where("a <> b").join(both, ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", zero).alias("value"))
    within = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(within))
    terms = shares.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")
    )
    terms = terms.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)
