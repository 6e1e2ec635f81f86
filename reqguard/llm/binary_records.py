"""Token ids in length-delimited binary record files, with an offset index.

A file is a row of frames, in ascending order of document id over the numbered files:

    u64 length | u32 masked crc32 of those 8 bytes | payload | u32 masked crc32 of the payload | 0x0A

All numbers are little-endian.  The mask is the usual rotation by 15 bits plus a constant, so that a
checksum over bytes that hold checksums stays useful.  A payload is one byte (1: the id is null), the
id as i64, then the token ids in the narrowest of u16 and u32 that holds the vocabulary.  The last
byte is the line end of Spark's text writer, which writes the frames: its committer makes a lost or
repeated task harmless, and it reaches any store that Spark reaches.
"""

from __future__ import annotations

import array
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .words import slices

_MASK = 0xA282EAD8
_HEAD = struct.Struct("<QI")
_ID = struct.Struct("<Bq")
_FRAME_EXTRA = _HEAD.size + 4 + 1
# Words whose ids a Python worker remembers at first hand; as many older ones are kept beside them.
MEMO_WORDS = 450_000
# The stand-in of a space.
SPACE = "\u0120"

INDEX_SCHEMA = (
    "shard int, piece int, doc_id bigint, offset bigint, length bigint, local_start bigint,"
    " n_tokens bigint, ids_crc32 bigint"
)


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """A record without the line end that the writer adds."""
    length = struct.pack("<Q", len(payload))
    return b"".join(
        (length, struct.pack("<I", masked(zlib.crc32(length))), payload, struct.pack("<I", masked(zlib.crc32(payload))))
    )


class _Words(dict):
    """Ids, as bytes, of words that stand after ``lead`` (a space, or nothing at the start of a line)."""

    # Letters with plain marks after them, which are a piece of their own.
    _TAILED = re.compile(r"([^\W\d_]+)([.,;:!?]+)")

    def __init__(self, encoder: Encoder, lead: str) -> None:
        super().__init__()
        self.encoder, self.lead = encoder, lead
        self.mapped_lead = lead.replace(" ", SPACE)
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO_WORDS:
            self.older = self.copy()
            self.clear()
        encoder = self.encoder
        if (known := self.older.get(word)) is not None:
            ids = known
        elif word.isalpha():
            # A run of letters is one piece with the space before it: no need to cut it up.
            if word.isascii():
                piece = self.mapped_lead + word
            else:
                piece = (self.lead + word).encode().decode("latin-1").translate(byte_alphabet())
            ids = array.array(encoder.code, [t.id for t in encoder.model.tokenize(piece)]).tobytes()
        elif (found := self._TAILED.fullmatch(word)) and found[1].isalpha():
            ids = self[found[1]] + encoder.start[found[2]]
        else:
            ids = encoder.pack(encoder.tokenizer.encode(self.lead + word, add_special_tokens=False).ids)
        self[word] = ids
        return ids


class Encoder:
    """Token ids as bytes, equal to those of ``Tokenizer.encode`` over the whole text.

    In byte-level BPE a single space between two characters other than white space always begins a
    piece of its own, and a single line end is a piece alone.  So a text is what lies between them,
    and a word that was met before need not be encoded again.  Texts with longer runs of white
    space, or with the string of a special token, go to the tokenizer whole, as does everything when
    the file holds another kind of model.
    """

    _RUNS = re.compile(r"\s\s")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.code = "H" if self.tokenizer.get_vocab_size() <= 0xFFFF else "I"
        pre = self.tokenizer.pre_tokenizer
        self.split = isinstance(pre, pre_tokenizers.ByteLevel) and not pre.add_prefix_space
        self.split = self.split and isinstance(self.model, models.BPE) and self.tokenizer.normalizer is None
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.start, self.after = _Words(self, ""), _Words(self, " ")
        self.start[""] = b""
        self.line_end = self.pack(self.tokenizer.encode("\n", add_special_tokens=False).ids)

    def pack(self, ids: list[int]) -> bytes:
        return array.array(self.code, ids).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.split or self._RUNS.search(text) or (self.special and self.special.search(text)):
            return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        lines = []
        after = self.after.__getitem__
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            lines.append(self.start[first] + b"".join(map(after, rest)))
        return self.line_end.join(lines)


@lru_cache(maxsize=1)
def byte_alphabet() -> dict[int, str]:
    """The byte-level stand-ins: visible Latin-1 characters are themselves, the rest move up from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process; tasks that follow find its words."""
    return Encoder(path)


def _framed(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    own = encoder(path)
    end = own.pack([end_id])
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for lo, hi in slices(texts):
            out = [
                frame(b"".join((_ID.pack(i is None, i or 0), own.encode(text), end)))
                for i, text in zip(ids[lo:hi], texts.slice(lo, hi - lo).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def write_records(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text"
) -> None:
    """Encode ``docs`` and write the record files below ``folder``.

    Order: ascending id, nulls first; rows of one id by their text.  A null text is empty, so its
    record holds the end id alone.  Ties and repeated rows give a record each.  Other columns are
    not read.  Ranges of (id, hash of the text) are dealt to tasks, so a repeated id is split too.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    order = F.col("_id").asc_nulls_first()
    ordered = rows.repartitionByRange(order, F.xxhash64("_text")).sortWithinPartitions(
        order, F.xxhash64("_text"), "_text"
    )
    records = ordered.mapInArrow(lambda batches: _framed(batches, tokenizer, end_id), "value binary")
    # The cast keeps the bytes as they are.
    records.select(F.col("value").cast("string").alias("value")).write.text(f"{folder}/records")


def parse(content: bytes | memoryview) -> Iterator[tuple[int, int, int | None, memoryview]]:
    """(offset, length of the frame, id, bytes of the token ids) of each record; raises on damage."""
    view, at = memoryview(content), 0
    while at < len(view):
        length, check = _HEAD.unpack_from(view, at)
        if masked(zlib.crc32(view[at : at + 8])) != check:
            raise ValueError(f"damaged length at byte {at}")
        payload = view[at + _HEAD.size : at + _HEAD.size + length]
        tail = at + _HEAD.size + length
        if len(payload) != length or view[tail + 4] != 0x0A:
            raise ValueError(f"record cut short at byte {at}")
        if masked(zlib.crc32(payload)) != int.from_bytes(view[tail : tail + 4], "little"):
            raise ValueError(f"damaged record at byte {at}")
        null, number = _ID.unpack_from(payload)
        yield at, length + _FRAME_EXTRA, None if null else number, payload[_ID.size :]
        at = tail + 5


def _entries(batches: Iterator[pa.RecordBatch], code: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            found = re.search(r"part-(\d+)-.*-c(\d+)[^/]*$", path.as_py())
            if not found:
                raise ValueError(f"not a record file: {path.as_py()}")
            shard, piece, start = int(found[1]), int(found[2]), 0
            rows: list[tuple] = []
            for offset, length, number, ids in parse(content.as_buffer()):
                wide = np.frombuffer(ids, dtype=f"<u{2 if code == 'H' else 4}").astype("<u4")
                rows.append((shard, piece, number, offset, length, start, len(wide), zlib.crc32(wide)))
                start += len(wide)
            columns = zip(*rows, strict=True) if rows else [[]] * 8
            kinds = (pa.int32(), pa.int32(), *[pa.int64()] * 6)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                [x.split()[0] for x in INDEX_SCHEMA.split(", ")],
            )


def write_index(spark: SparkSession, folder: str, tokenizer: str) -> DataFrame:
    """Read the record files back, check every sum, and write one index row for each record.

    A row says where its record lies (file number, byte offset and length), how many ids the
    record holds, how many all records before it hold (``start``), and their crc32.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/records")
    code = encoder(tokenizer).code
    entries = files.select("path", "content").mapInArrow(lambda batches: _entries(batches, code), INDEX_SCHEMA)
    entries.write.parquet(f"{folder}/entries")
    entries = spark.read.schema(INDEX_SCHEMA).parquet(f"{folder}/entries")
    # One row for each file: the ids of all files before it.
    before = Window.orderBy("shard", "piece").rowsBetween(Window.unboundedPreceding, -1)
    files_before = (
        entries.groupBy("shard", "piece")
        .agg(F.sum("n_tokens").alias("in_file"))
        .select("shard", "piece", F.coalesce(F.sum("in_file").over(before), F.lit(0)).alias("_before"))
    )
    return entries.join(files_before, ["shard", "piece"]).select(
        "doc_id",
        (F.col("_before") + F.col("local_start")).alias("start"),
        "n_tokens",
        "ids_crc32",
        "shard",
        "piece",
        "offset",
        "length",
    )


def shuffled_plan(index: DataFrame, seed: int) -> DataFrame:
    """Index rows with a place in a pseudo-random reading order that depends on the seed alone."""
    return index.withColumn("place", F.xxhash64(F.lit(seed), "shard", "piece", "offset"))
