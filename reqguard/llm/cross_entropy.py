"""Cross-entropy difference: how much better a target model than a background model foretells a text.

Both are interpolated bigram models over one vocabulary.  The background model is counted over all
documents, the target model over those that are marked as target.  They are matched: order,
vocabulary and smoothing are the same, and the background counts are scaled to the target's number of
tokens, which stands for a background sample of the target's size without the chance of one.

Every word and every word pair of the corpus has a counter of its own, told by a hash of 63 bits, so
the models grow with the corpus and no task holds one.  Documents are packed into chunks.  A chunk
asks for each of its n-grams once, with its own counts, in blocks by ranges of the hash; whoever has
a range adds all askers' counts up and answers each of them.  A common n-gram thus has a place in
each chunk and not a row for each occurrence or document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .words import mix, slices, word_hashes

# Bytes of text in a chunk, and about as many for each range of hashes; least number of ranges.
CHUNK, RANGE, RANGES = 6_000_000, 16_000_000, 256
# The vocabulary that smoothing allows for at least; a corpus with more words has its own number.
N_WORDS = 1 << 18
# Smoothing: added count of a word; weight of the word model within the pair model.
ALPHA, MU = 0.1, 4.0

PACKED_SCHEMA = "ids array<bigint>, texts binary, bytes bigint"
ASKED_SCHEMA = "part int, chunk bigint, n int, keys binary, background binary, target binary"
ANSWER_SCHEMA = "chunk bigint, part int, n int, background binary, target binary, words bigint, tokens bigint, target_tokens bigint"
SCORE_SCHEMA = "doc_id bigint, n_tokens bigint, h_target double, h_background double, ce_difference double"


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "array<bigint>": pa.list_(pa.int64())}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [f for f, _ in fields])


def _pack(numbers: np.ndarray) -> bytes:
    """Compressed by planes: all lowest bytes, then all of the next ones."""
    planes = np.ascontiguousarray(numbers.astype("<u8")).view(np.uint8).reshape(-1, 8).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(n)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in batches:
        for lo, hi in slices(batch.column(1), CHUNK):
            texts = pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo)], ["text"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, texts.schema, options=options) as out:
                out.write_batch(texts)
            ids = batch.column(0).slice(lo, hi - lo).to_pylist()
            yield _batch([[ids], [sink.getvalue().to_pybytes()], [texts.nbytes]], PACKED_SCHEMA)


def _texts(packed: bytes) -> pa.Array:
    return pa.ipc.open_stream(packed).read_next_batch().column(0)


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of every token (even) and of it with the one before (odd), whether there is one, where texts begin."""
    parts = [word_hashes(texts.slice(lo, hi - lo)) for lo, hi in slices(texts, 4_000_000)]
    words = np.concatenate([w for w, _ in parts]) if parts else np.zeros(0, np.uint64)
    at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(a) for _, a in parts]))]) if parts else np.zeros(1, np.int64)
    before = np.concatenate([np.zeros(1, np.uint64), words[:-1]]) if len(words) else words
    pairs = mix(before * np.uint64(0x9E3779B97F4A7C15) + words)
    follows = np.ones(len(words), bool)
    follows[at[:-1][at[:-1] < len(words)]] = False
    return words & ~np.uint64(1), pairs | np.uint64(1), follows, at


def _asked(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """A chunk's n-grams in order of their hashes, with its own counts, a row for each range of hashes."""
    for batch in batches:
        for chunk, packed, places in zip(*batch.columns, strict=True):
            words, pairs, follows, at = grams(_texts(packed.as_buffer()))
            if not len(words):
                continue
            chosen = np.zeros(len(at) - 1, bool)
            chosen[places.as_py() or []] = True
            in_target = np.repeat(chosen, np.diff(at))
            keys, which = np.unique(np.concatenate([words, pairs[follows]]), return_inverse=True)
            background = np.bincount(which, minlength=len(keys))
            target = np.bincount(which[np.concatenate([in_target, in_target[follows]])], minlength=len(keys))
            part = ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(keys)]
            rows = [
                # Keys by their distances, which are shorter.
                (part[b], chunk.as_py(), e - b, *(_pack(x) for x in (np.diff(keys[b:e], prepend=np.uint64(0)), background[b:e], target[b:e])))
                for b, e in zip(cuts, cuts[1:], strict=False)
            ]
            yield _batch(list(zip(*rows, strict=True)), ASKED_SCHEMA)


def _answered(asked: pa.Table) -> pa.Table:
    """Sums over all chunks for each n-gram of one range, for each chunk in the order it asked."""
    rows = asked.to_pydict()
    sizes = rows["n"]
    keys = [np.cumsum(_unpack(x, n), dtype=np.uint64) for x, n in zip(rows["keys"], sizes, strict=True)]
    keys, which = np.unique(np.concatenate(keys), return_inverse=True)
    sums = []
    for name in ("background", "target"):
        own = np.concatenate([_unpack(x, n) for x, n in zip(rows[name], sizes, strict=True)])
        sums.append(np.bincount(which, weights=own.astype(float), minlength=len(keys)).astype(np.int64))
    is_word = (keys & np.uint64(1)) == 0
    whole = [int(is_word.sum()), int(sums[0][is_word].sum()), int(sums[1][is_word].sum())]
    cuts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    answers = [[_pack(s[which[b:e]]) for b, e in zip(cuts, cuts[1:], strict=False)] for s in sums]
    # What is true of the range as a whole stands in its first row.
    totals = [[x, *[0] * (len(sizes) - 1)] for x in whole]
    return pa.Table.from_batches([_batch([rows["chunk"], rows["part"], sizes, *answers, *totals], ANSWER_SCHEMA)])


def losses(
    word: np.ndarray, pair: np.ndarray, follows: np.ndarray, counts: np.ndarray, tokens: float, vocabulary: int
) -> np.ndarray:
    """Each token's loss; ``word`` and ``pair`` (of those that follow one) are places in ``counts``."""
    alone = (counts[word] + ALPHA) / (tokens + ALPHA * vocabulary)
    p = alone.copy()
    known = counts[word[np.flatnonzero(follows) - 1]]
    p[follows] = (counts[pair] + MU * alone[follows]) / (known + MU)
    return -np.log(p)


def _scores(batches: Iterator[pa.RecordBatch], vocabulary: int, tokens: int, target_tokens: int) -> Iterator[pa.RecordBatch]:
    scale = target_tokens / tokens if tokens else 0.0
    for batch in batches:
        for ids, packed, answers in zip(*batch.columns, strict=True):
            words, pairs, follows, at = grams(_texts(packed.as_buffer()))
            n = np.diff(at)
            mean = np.zeros((2, len(n)))
            some = np.flatnonzero(n)
            if len(some):
                _, which = np.unique(np.concatenate([words, pairs[follows]]), return_inverse=True)
                # Ranges in order have the chunk's n-grams in order.
                got = sorted(answers.as_py(), key=lambda x: x["part"])
                for m, (name, by) in enumerate((("background", scale), ("target", 1.0))):
                    counts = np.concatenate([_unpack(x[name], x["n"]) for x in got]).astype(float) * by
                    loss = losses(which[: len(words)], which[len(words) :], follows, counts, float(target_tokens), vocabulary)
                    mean[m, some] = np.add.reduceat(loss, at[some]) / n[some]
            yield _batch([ids.values, n, mean[1], mean[0], mean[1] - mean[0]], SCORE_SCHEMA)


def cross_entropy_difference(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Score ``docs`` with the documents whose ids are in ``target`` (column ``doc_id``) as target.

    One row for each row of ``docs``: tokens, mean loss under both models, target minus background;
    lower differences are nearer to the target.  Null ids are in no target; an id that is repeated in
    ``target`` counts once.  A null or empty text has no tokens and scores 0 throughout.  Ids may be
    null or repeated; other columns are not read; an empty table gives no rows.
    """
    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    packed = slim.mapInArrow(_packed, PACKED_SCHEMA)
    # Written once, so that a chunk has one number for all that read it.
    chunks = stored(packed.withColumn("chunk", F.monotonically_increasing_id()))
    size = chunks.agg(F.sum("bytes")).first()[0] or 0
    ranges = max(RANGES, size // RANGE)
    ids = target.select(F.col("doc_id").cast("bigint").alias("_id")).where("_id is not null").distinct()
    places = chunks.select("chunk", F.posexplode("ids").alias("place", "_id")).where("_id is not null")
    # A target grows with its corpus, so the plan is the one for large ones at every size.
    marked = places.join(ids.hint("merge"), "_id").groupBy("chunk").agg(F.collect_list("place").alias("places"))
    asked = chunks.select("chunk", "texts").join(marked.hint("merge"), "chunk", "left").select("chunk", "texts", "places")
    asked = asked.mapInArrow(lambda batches: _asked(batches, ranges), ASKED_SCHEMA)
    answers = stored(asked.groupBy("part").applyInArrow(_answered, ANSWER_SCHEMA))
    whole = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "tokens", "target_tokens")]).first()
    vocabulary, tokens, target_tokens = max(N_WORDS, whole[0]), whole[1], whole[2]
    # As many answers as there are ranges, and as many counts as a chunk has n-grams.
    by_chunk = answers.groupBy("chunk").agg(F.collect_list(F.struct("part", "n", "background", "target")).alias("answers"))
    joined = chunks.select("chunk", "ids", "texts").join(by_chunk.hint("merge"), "chunk", "left").select("ids", "texts", "answers")
    return joined.mapInArrow(lambda batches: _scores(batches, vocabulary, tokens, target_tokens), SCORE_SCHEMA)
