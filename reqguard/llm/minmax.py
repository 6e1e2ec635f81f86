"""Near-duplicates by min-max hashing over sets of five-word shingles, links confirmed on full sets.

Every permutation of the shingle hashes gives two values, its minimum and its maximum, so 96
evaluations a shingle make 192 values.  They are banded in fours from four different permutations
(two minima, two maxima; the other half of each goes to a second band), so a pair of similarity s
meets in a band with probability s**4 and misses all 48 bands with (1 - s**4)**48: 1e-8 at 0.75.

Work never follows the square of a group:

* equal sets become one class; all later steps see classes;
* bands say which classes have a candidate at all, and pairs are not made from them: documents
  that share a passage, and no more, meet in bands in great numbers;
* of the classes that met, only the rarest quarter of the shingles is looked at: two sets that are
  similar enough have one of those in common, and a passage that many documents share is not rare;
* a shingle's group is a star: its classes are paired with the group's least class alone, and
  pairs whose sizes, or places among the rare shingles, rule the similarity out are dropped;
* classes of one group that are in different components after the stars are confirmed may be linked
  all the same.  In rounds, each is compared with a few others by lot, and components that a link
  joins become one; of two components it takes one link to spare all other pairs between them;
* classes that are still in different components are compared with each other, wherever no earlier
  comparison and neither sizes nor places rule the similarity out, so no link is lost.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .exact_dedup import bitmap
from .names import set_aside
from .words import mix, ngram_hashes, slices, word_hashes

SHINGLE = 5
PERMUTATIONS = 96
ROWS = 4
BANDS = PERMUTATIONS // ROWS * 2
# Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
BITMAP_BITS = 22
COUNT_BITS = 20
BLOCK = 4096
# Tokens of a centre that have a bit of their own.
NUMBERED = 62
# Others that a class is compared with for each token in a round, out of parts of about this many; a round
# that finds fewer links than one for so many components is the last.
TRIES, PART, FEW_LINKS = 3, 256, 20
# Sets whose sizes differ by 5 percent at most can be similar if their first common shingle is among
# the first 12 percent of both: (1 - 0.12) * 175 >= 75 * 2.05.
FIRST_PERCENT, EQUAL_PERCENT = 12, 105

_random = np.random.Generator(np.random.PCG64(20240501))
_A = _random.integers(0, 1 << 64, PERMUTATIONS, np.uint64) | np.uint64(1)
_B = _random.integers(0, 1 << 64, PERMUTATIONS, np.uint64)

SIGNATURE_SCHEMA = "doc_id bigint, row bigint, n_shingles bigint, cls bigint, bands array<bigint>"


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and where each text's begin."""
    hashes, begin = ngram_hashes(*word_hashes(texts), n)
    for b, e in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        hashes[b:e].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[begin[:-1][begin[:-1] < len(hashes)]] = True
    at = np.concatenate([[0], np.cumsum(new)])[begin]
    return hashes[new], at


def set_keys(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One number a set, whatever the order of its members; 0 for an empty set."""
    out = np.zeros(len(at) - 1, np.uint64)
    count = np.diff(at)
    some = np.flatnonzero(count)
    if len(some):
        starts = at[some]
        one = np.add.reduceat(mix(values + np.uint64(0x1234567)), starts)
        two = np.add.reduceat(mix(values ^ np.uint64(0x9876543210ABCDEF)), starts)
        out[some] = mix(one * np.uint64(0x9E3779B97F4A7C15) + two + count[some].astype(np.uint64))
    return out


def band_keys(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of band keys for each set that is not empty."""
    starts = at[:-1][np.diff(at) > 0]
    least = np.empty((PERMUTATIONS, len(starts)), np.uint64)
    most = np.empty_like(least)
    x = np.empty_like(values)
    for k in range(PERMUTATIONS):
        np.multiply(values, _A[k], out=x)
        x += _B[k]
        np.minimum.reduceat(x, starts, out=least[k])
        np.maximum.reduceat(x, starts, out=most[k])
    keys = np.empty((len(starts), BANDS), np.uint64)
    for g in range(PERMUTATIONS // ROWS):
        one, two = slice(ROWS * g, ROWS * g + 2), slice(ROWS * g + 2, ROWS * g + 4)
        for half, parts in enumerate(((*least[one], *most[two]), (*most[one], *least[two]))):
            band = 2 * g + half
            h = np.full(len(starts), band + 1, np.uint64)
            for part in parts:
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + part)
            keys[:, band] = h
    return keys


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in slices(batch.column(2)):
            values, at = shingle_sets(batch.column(2).slice(lo, hi - lo))
            count = np.diff(at)
            keys = band_keys(values, at) if len(values) else np.zeros((0, BANDS), np.uint64)
            offsets = np.concatenate([[0], np.cumsum(count > 0)]) * BANDS
            bands = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
            columns = [
                batch.column(0).slice(lo, hi - lo),
                batch.column(1).slice(lo, hi - lo),
                pa.array(count, pa.int64()),
                pa.array(set_keys(values, at).view(np.int64)),
                bands,
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "n_shingles", "cls", "bands"])


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row (hash of all columns), n_shingles, cls (one number for equal sets), band keys; a narrow pass."""
    slim = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(*docs.columns).alias("row"), F.col(text).alias("text")
    )
    return slim.mapInArrow(_signatures, SIGNATURE_SCHEMA)


def _wanted_sets(batches: Iterator[pa.RecordBatch], words: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in slices(batch.column(1)):
            values, at = shingle_sets(batch.column(1).slice(lo, hi - lo))
            cls = set_keys(values, at)
            ids = batch.column(0).slice(lo, hi - lo)
            slot = (row_marks(cls, ids) & np.uint64((1 << bits) - 1)).astype(np.int64)
            hit = (words[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1
            hit &= np.diff(at) > 0
            rows = np.flatnonzero(hit)
            sets = [values[at[i] : at[i + 1]].view(np.int64) for i in rows]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(rows)),
                    pa.array(cls[rows].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                ],
                ["doc_id", "cls", "members"],
            )


def row_marks(cls: np.ndarray, ids: pa.Array) -> np.ndarray:
    """A number for (class, id), the same as ``mark`` below."""
    number = np.asarray(pc.fill_null(ids, 0), dtype=np.int64).view(np.uint64)
    return cls ^ number


def sets_of(docs: DataFrame, wanted: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """cls and sorted shingle hashes of the classes in ``wanted`` (cls, rep).

    The texts are read a second time; a bitmap of fixed size says in the scan whose sets to put
    out, and the join drops what it lets through by chance.
    """
    mark = F.col("cls").bitwiseXOR(F.coalesce("rep", F.lit(0)))
    words = bitmap(wanted.select(mark.alias("mark")), "mark", BITMAP_BITS).first()["words"]
    shared = docs.sparkSession.sparkContext.broadcast(np.array(words, np.int64).view(np.uint64))
    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    found = slim.mapInArrow(
        lambda batches: _wanted_sets(batches, shared.value, BITMAP_BITS),
        "doc_id bigint, cls bigint, members array<bigint>",
    )
    f, w = found.alias("f"), wanted.alias("w")
    joined = f.join(w, F.expr("f.cls = w.cls and f.doc_id <=> w.rep"), "left_semi")
    # Rows that share text and id are one class.
    return joined.select("cls", "members").dropDuplicates(["cls"])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that reach the similarity on their full sets."""
    a = sets.select(F.col("cls").alias("a"), F.col("members").alias("of_a"))
    b = sets.select(F.col("cls").alias("b"), F.col("members").alias("of_b"))
    both = pairs.join(b, "b").join(a, "a")
    common = F.size(F.array_intersect("of_a", "of_b"))
    union = F.size("of_a") + F.size("of_b") - common
    return both.where(100 * common >= PERCENT * union).select("a", "b")


def _counted(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << bits, np.uint32)
    for batch in batches:
        members = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        counts += np.bincount((members >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint32)
    some = [k for k in range(0, 1 << bits, BLOCK) if counts[k : k + BLOCK].any()]
    yield pa.RecordBatch.from_arrays(
        [pa.array(some, pa.int64()), pa.array([counts[k : k + BLOCK].tobytes() for k in some], pa.binary())], ["at", "counts"]
    )


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total.setdefault(k, np.zeros(BLOCK, np.uint32))
            total[k] += np.frombuffer(counts, np.uint32)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int64()), pa.array([c.tobytes() for c in total.values()], pa.binary())], ["at", "counts"]
    )


def shingle_counts(sets: DataFrame, bits: int = COUNT_BITS) -> np.ndarray:
    """About how many of the sets hold a shingle, by the first bits of its hash: an array of fixed size.

    It only orders shingles from rare to common.  Any order that is the same for all sets is right;
    a good one makes small groups.
    """
    parts = sets.select("members").mapInArrow(lambda batches: _counted(batches, bits), "at bigint, counts binary")
    out = np.zeros(1 << bits, np.uint32)
    for at, counts in parts.repartition("at").mapInArrow(_added, "at bigint, counts binary").collect():
        out[at : at + BLOCK] = np.frombuffer(counts, np.uint32)
    return out


def _rarest(batches: Iterator[pa.RecordBatch], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    shift = np.uint64(64 - int(np.log2(len(counts))))
    for batch in batches:
        cls, members = batch.column(0).to_numpy(), batch.column(1)
        flat = members.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        size = np.asarray(pc.list_value_length(members), dtype=np.int64)
        begin = np.concatenate([[0], np.cumsum(size)])
        common = counts[(flat >> shift).astype(np.int64)]
        parts, takes = [], []
        for b, e in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            n = e - b
            # Of n, all but the least that an intersection needs, and one more.
            take = n - (PERCENT * n + 99) // 100 + 1
            parts.append(flat[b:e][np.lexsort((flat[b:e], common[b:e]))[:take]])
            takes.append(take)
        takes = np.array(takes, np.int64)
        places = np.arange(takes.sum()) - np.repeat(np.cumsum(takes) - takes, takes)
        token = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(token.view(np.int64)),
                pa.array(np.repeat(cls, takes)),
                pa.array(np.repeat(size, takes).astype(np.int32)),
                pa.array(places.astype(np.int32)),
            ],
            ["token", "cls", "n", "place"],
        )


def rarest_shingles(sets: DataFrame, counts: np.ndarray) -> DataFrame:
    """token, cls, n, place: the shingles of which two similar sets must share one, rarest first."""
    shared = sets.sparkSession.sparkContext.broadcast(counts)
    return sets.select("cls", "members").mapInArrow(
        lambda batches: _rarest(batches, shared.value), "token bigint, cls bigint, n int, place int"
    )


def _possible(n: str, place: str, m: str, other: str) -> Column:
    """Whether sets of n and m shingles, whose first common one stands at these places, can be similar.

    All that both can share stands from there on, and similar sets share PERCENT / (100 + PERCENT)
    of both sizes together at least.
    """
    return _possible_of(F.col(n), F.col(place), F.col(m), F.col(other))


def _possible_of(a: Column, i: Column, b: Column, j: Column) -> Column:
    return ((100 + PERCENT) * F.least(a - i, b - j) >= PERCENT * (a + b)) & (
        100 * F.least(a, b) >= PERCENT * F.greatest(a, b)
    )


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """cls and root (the least class reachable) for every class of ``nodes``.

    Large-star and small-star steps in turn, each written out: the number of rounds grows with the
    logarithm of a component's size, and a step groups neighbours by aggregation before any join.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        # Done when all links are stars: no node has two neighbours below it, no end is a centre too.
        ends = edges.groupBy(F.col("u").alias("x")).agg(F.count(F.lit(1)).alias("n"))
        centres = edges.select(F.col("v").alias("x")).distinct()
        if ends.join(centres, "x", "left").where("n > 1").union(ends.join(centres, "x")).isEmpty():
            break
        # Large star: the larger neighbours of a node go to its least neighbour (itself included).
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # (Stored, so that the join has an exchange on either side and a hot node can be split.)
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # A node has few centres from here on.
        large = stored(large.where("u <> v").repartition("u").distinct())
        # Small star: the smaller neighbours of a node, and it itself, go to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(moved.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
    roots = edges.select(F.col("u").alias("cls"), F.col("v").alias("root"))
    return nodes.select("cls").join(roots, "cls", "left").select("cls", F.coalesce("root", "cls").alias("root"))


def link_classes(docs: DataFrame, sig: DataFrame, doc_id: str, text: str) -> DataFrame:
    """cls, rep (least id of the class) and root for every class of a set that is not empty."""
    classes = stored(
        sig.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    )
    banded = classes.select("cls", F.explode("bands").alias("key"))
    met = banded.groupBy("key").count().where("count > 1").select("key")
    involved = banded.join(met, "key", "left_semi").select("cls").distinct()
    involved = stored(involved.join(classes.select("cls", "rep"), "cls"))
    sets = stored(sets_of(docs, involved, doc_id, text))
    tokens = stored(rarest_shingles(sets, shingle_counts(sets)))
    hubs = tokens.groupBy("token").agg(F.min(F.struct("cls", "n", "place")).alias("hub"), F.count(F.lit(1)).alias("size"))
    shared = stored(
        tokens.join(hubs.where("size > 1"), "token")
        .where(F.col("cls") != F.col("hub.cls"))
        .select("token", "cls", "n", "place", F.col("hub.cls").alias("a"), F.col("hub.n").alias("m"), F.col("hub.place").alias("other"))
    )
    pairs = shared.where(_possible("n", "place", "m", "other")).select("a", F.col("cls").alias("b")).distinct()
    pairs = stored(pairs)
    # First one pair for each class; most of the others have both ends at one centre then.
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = stored(confirmed(first, sets))
    centre = links.select(F.col("b").alias("x"), F.col("a").alias("c"))
    of_a = centre.select(F.col("x").alias("a"), F.col("c").alias("ca"))
    of_b = centre.select(F.col("x").alias("b"), F.col("c").alias("cb"))
    apart = F.coalesce("ca", "a") != F.coalesce("cb", "b")
    rest = pairs.join(of_a, "a", "left").join(of_b, "b", "left").where(apart).select("a", "b")
    links = stored(links.union(confirmed(rest.join(first, ["a", "b"], "left_anti"), sets)))
    roots = stored(components(involved, links))
    # Classes of one group that stayed apart: neither is the centre, for pairs with it are done.
    open_ = _still_apart(shared, roots)
    refuted = pairs
    for salt in itertools.count(1):
        # Few new links: what is left is mostly apart, and has to be compared.
        tried = stored(_pairs_by_lot(open_, salt).join(refuted, ["a", "b"], "left_anti"))
        found = stored(confirmed(tried, sets))
        if found.isEmpty():
            break
        roots = _contracted(roots, found)
        few = FEW_LINKS * found.count() < open_.select("root").distinct().count()
        refuted = stored(refuted.union(tried.join(found, ["a", "b"], "left_anti")))
        open_ = _still_apart(open_, roots)
        if few:
            break
    between = _pairs_apart(open_).join(refuted, ["a", "b"], "left_anti")
    found = stored(confirmed(between, sets))
    if not found.isEmpty():
        roots = _contracted(roots, found)
    return classes.select("cls", "rep").join(roots, "cls", "left").select("cls", "rep", F.coalesce("root", "cls").alias("root"))


def _still_apart(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(token, a, cls, n, place, root) of the tokens that more than one component holds."""
    ends = rows.select("token", "a", "cls", "n", "place").join(roots, "cls")
    mixed = ends.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    return stored(ends.join(mixed.select("token"), "token", "left_semi").select("token", "a", "cls", "n", "place", "root"))


def _contracted(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (cls, root) with the components that ``links`` (a, b) join made one."""
    of_a = roots.select(F.col("cls").alias("a"), F.col("root").alias("ra"))
    of_b = roots.select(F.col("cls").alias("b"), F.col("root").alias("rb"))
    between = links.join(of_a, "a").join(of_b, "b").where("ra <> rb")
    between = stored(between.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    ends = between.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    moved = components(ends, between).select(F.col("cls").alias("root"), F.col("root").alias("to"))
    return stored(roots.join(moved, "root", "left").select("cls", F.coalesce("to", "root").alias("root")))


def _pairs_by_lot(rows: DataFrame, salt: int) -> DataFrame:
    """Pairs (a, b) of classes in different components: each class with the next few that share a token.

    Next in an order of chance that ``salt`` sets, within parts of a token's classes of bounded size.
    One link joins all of two components, so a round of these spares most comparisons between their
    members; what it leaves out is not decided by it.
    """
    # Where the first common shingle of similar sets of one size can be.
    early = rows.where((100 + PERCENT) * F.col("place") <= (100 - PERCENT) * F.col("n"))
    sizes = early.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
    lot = F.xxhash64(F.lit(salt), "token", "cls")
    dealt = early.join(sizes, "token").withColumn("lot", lot).withColumn("part", F.pmod("lot", "parts"))
    order = Window.partitionBy("token", "part").orderBy("lot", "cls")
    here = F.struct("cls", "n", "place", "root")
    dealt = dealt.select("cls", "n", "place", "root", F.array(*[F.lead(here, k).over(order) for k in range(1, TRIES + 1)]).alias("next"))
    possible = F.filter(
        "next", lambda y: (y["root"] != F.col("root")) & _possible_of(F.col("n"), F.col("place"), y["n"], y["place"])
    )
    pairs = dealt.select("cls", F.explode(F.transform(possible, lambda y: y["cls"])).alias("other"))
    return pairs.select(F.least("cls", "other").alias("a"), F.greatest("cls", "other").alias("b")).distinct()


def _pairs_apart(rows: DataFrame) -> DataFrame:
    """Pairs of classes in different components that may be similar, from (token, a, cls, n, place, root).

    Near copies share many of the tokens of one centre ``a``, of which there are no more than the
    centre has rare shingles.  The most common of them are numbered, and every class knows by a bit
    each which of those are among its own first ones.  A pair of about equal sizes comes out at the
    first that both have there, where its places never rule it out, and at no other; all other pairs
    come out wherever their places allow.
    """
    by_size = Window.partitionBy("a").orderBy(F.col("count").desc(), "token")
    numbered = rows.groupBy("token", "a").count().withColumn("r", F.row_number().over(by_size) - 1)
    rows = rows.join(numbered.select("token", "r"), "token")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("r"))
    first = (F.col("r") < NUMBERED) & (100 * F.col("place") <= FIRST_PERCENT * F.col("n"))
    masks = rows.where(first).groupBy("cls", "a").agg(F.bit_or(bit).alias("mask"))
    rows = rows.join(masks, ["cls", "a"], "left").withColumn("mask", F.coalesce("mask", F.lit(0)))
    # For a numbered token those before it, and itself unless it is among the first ones.
    upto = F.when(first, bit - 1).when(F.col("r") < NUMBERED, 2 * bit - 1).otherwise(F.lit(-1))
    rows = stored(rows.withColumn("upto", upto))
    x, y = rows.alias("x"), rows.alias("y")
    apart = F.expr("x.token = y.token and x.cls < y.cls and x.root <> y.root")
    equal = F.expr(f"100 * greatest(x.n, y.n) <= {EQUAL_PERCENT} * least(x.n, y.n)")
    elsewhere = F.expr("(x.mask & y.mask & x.upto & y.upto) <> 0")
    wanted = apart & _possible("x.n", "x.place", "y.n", "y.place") & ~(equal & elsewhere)
    return x.join(y, wanted).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row, n_shingles, cls, root, component_id (least id reachable), one row for each row of ``docs``.

    A null or empty text, or one of white space alone, has an empty set and is linked with nothing:
    its component is itself.  Texts of fewer than five words have one shingle.  Rows that share an
    id keep a row each and follow their own text; null ids are passed over in the least id.  So an
    id does not tell a component, its root (the least class reachable; null for an empty set) does.
    An empty table gives no rows.  Other columns are not read.
    """
    sig = stored(signatures(docs, doc_id, text))
    linked = link_classes(docs, sig.select("doc_id", "n_shingles", "cls", "bands"), doc_id, text)
    least = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_class = stored(linked.join(least, "root").select("cls", "root", "component_id"))
    s, c = sig.alias("s"), by_class.alias("c")
    return s.join(c, F.expr("s.cls = c.cls and s.n_shingles > 0"), "left").select(
        "s.doc_id",
        "s.row",
        "s.n_shingles",
        "s.cls",
        "c.root",
        F.when(F.col("s.n_shingles") > 0, F.col("c.component_id")).otherwise(F.col("s.doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but one of each component; columns stay as they are.

    The row with the least id stays (null last, then the least hash of the row); a row without any
    word stays, and so does one of several rows that are the same in all columns.  An empty table
    gives no rows.  A column named ``_row`` comes out as it went in.
    """
    names = docs.columns
    docs = set_aside(docs, "_row")
    found = stored(near_duplicates(docs, doc_id, text))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    linked = found.where("n_shingles > 0").withColumn("_order", order)
    best = linked.groupBy("root").agg(F.min("_order").alias("_best"), F.count(F.lit(1)).alias("_n"))
    best = stored(best.where("_n > 1"))
    l, b = linked.alias("l"), best.alias("b")
    several = l.join(b, F.expr("l.root = b.root")).select(
        F.col("l.row").alias("_row"), (F.col("l._order") == F.col("b._best")).alias("_stays")
    )
    several = stored(several.groupBy("_row", "_stays").count())
    marked = docs.withColumn("_row", F.xxhash64(*docs.columns))
    # Losers grow with the corpus, so the plan is the one for many at every size.
    lose = several.where(~F.col("_stays")).select("_row").hint("merge")
    tied = several.where("_stays and count > 1").select("_row")
    left = marked.join(lose, "_row", "left_anti")
    single = left.join(tied, "_row", "left_anti").select(*docs.columns)
    first = left.join(tied, "_row", "left_semi").dropDuplicates(["_row"]).select(*docs.columns)
    return single.unionByName(first).toDF(*names)
