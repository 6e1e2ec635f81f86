"""A trie over the turns of conversations, built by the recursion of van Emde Boas.

Sequences are cut at half of the greatest depth.  The cut prefix gets a name; the first halves form
the upper trie, the second halves the lower forests, one under each name.  Both are cut again in
the same step, all parts of one height at once, until parts are ``HEIGHT`` turns high: a row of
turns that one expression names.  A name is 128 bits of hash over the name of the forest it lies in
and the turns since.  Totals are added up within the low parts first; then the lower forests of
every cut, from the lowest to the highest, are grafted upward: what a forest holds is added to the
ancestors of its roots within the upper trie.

Nothing is gathered by conversation or by node: positions come from a sort by ranges, a part has
``HEIGHT`` turns at most, nodes are aggregated before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

HEIGHT = 16
# The first turns that conversations of one hundred share are those of the hundredth.
SHARED, MOST_SHARED = 100, 6
SEGMENT = 1 << 16


def _hash(seed: int, *of: Column | str) -> Column:
    return F.xxhash64(F.lit(seed), *of)


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), t1, t2 (hash of role and text), size (code points of the text).

    In the order of turn (null first), then role, then text.  The order comes from a sort over
    ranges of all rows, and a conversation may lie in any number of them.
    """
    table = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    rows = table.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(
        rows.select(
            "conv_id",
            F.monotonically_increasing_id().alias("at"),
            _hash(1, "role", "text").alias("t1"),
            _hash(2, "role", "text").alias("t2"),
            F.length("text").cast("bigint").alias("size"),
        )
    )
    # The number of a row tells its range by the upper bits, and its place there by the lower ones.
    ranged = rows.withColumn("range", F.shiftright("at", 33))
    runs = ranged.groupBy("conv_id", "range").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = ranged.join(runs.select("conv_id", "range", "first", "before"), ["conv_id", "range"])
    return placed.select("conv_id", (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "t1", "t2", "size")


def rebuilt(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, at, t1, t2, size) with the shared first ones in place, and (conv_id, n) of all conversations."""
    counts = found.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    counts = counts.withColumns(
        {
            "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED,
            "base": F.col("conv_id") - F.col("conv_id") % SHARED,
        }
    )
    heads = found.where(F.col("pos") < MOST_SHARED - 1).withColumnRenamed("conv_id", "base")
    lent = counts.where("h > 0").join(heads, "base").where("pos < h")
    lent = stored(lent.select("conv_id", F.col("pos").alias("at"), "t1", "t2", "size"))
    taken = lent.groupBy("conv_id").agg(F.count(F.lit(1)).alias("taken"))
    counts = stored(counts.join(taken, "conv_id", "left").withColumn("taken", F.coalesce("taken", F.lit(0))))
    own = found.join(counts.select("conv_id", "h", "taken"), "conv_id").where("pos >= h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("at"), "t1", "t2", "size")
    length = F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    return lent.unionByName(own), counts.select("conv_id", length.alias("n"))


def cut_names(parts: DataFrame, lengths: DataFrame) -> DataFrame:
    """conv_id, part, k1, k2: the name of all turns before a part, for each part but the first.

    ``parts`` has a row (conv_id, part, x1, x2) for each part that is full, with a hash of its turns.
    One step of the recursion cuts all tries of one height: the upper half's turns, under the name of
    its forest, name the prefix under which the lower half stands.
    """
    most = lengths.agg(F.max("n")).first()[0] or 0
    height = 1
    while height * HEIGHT < most:
        height *= 2
    # Also the part behind the last full one, which ends what is named here.
    last = parts.groupBy("conv_id").agg((F.max("part") + 1).alias("part"))
    nothing = F.lit(0).cast("bigint")
    keyed = parts.select("conv_id", "part", "x1", "x2", nothing.alias("k1"), nothing.alias("k2"))
    keyed = keyed.unionByName(last.select("conv_id", "part"), allowMissingColumns=True).fillna(0, ["k1", "k2"])
    keyed = stored(keyed)
    # The part behind the last may be the first of a trie twice as high.
    half = height
    while half:
        trie = F.floor(F.col("part") / (2 * half)).cast("bigint")
        lower = F.floor(F.col("part") / half) % 2 == 1
        upper = keyed.where(~lower & F.col("x1").isNotNull())
        turned = [F.bit_xor(_hash(seed, "part", "x1", "x2")).alias(x) for seed, x in ((3, "y1"), (4, "y2"))]
        cut = upper.groupBy("conv_id", trie.alias("trie")).agg(*turned, F.min("k1").alias("u1"), F.min("k2").alias("u2"))
        named = cut.select(
            "conv_id",
            "trie",
            _hash(5, "u1", "u2", "y1", "y2").alias("c1"),
            _hash(6, "u1", "u2", "y1", "y2").alias("c2"),
        )
        below = keyed.where(lower).withColumn("trie", trie).join(named, ["conv_id", "trie"])
        below = below.select("conv_id", "part", "x1", "x2", F.col("c1").alias("k1"), F.col("c2").alias("k2"))
        keyed = stored(keyed.where(~lower).unionByName(below))
        half //= 2
    return keyed.where("part > 0").select("conv_id", "part", "k1", "k2")


def _chain(turn_list: Column, k1: Column, k2: Column) -> Column:
    """Of the turns of a part, in order: their names below the part's own, one from the other."""
    one = F.struct(k1.alias("n1"), k2.alias("n2"))

    def step(names: Column, turn: Column) -> Column:
        last = F.element_at(names, -1)
        both = [_hash(seed, last["n1"], last["n2"], turn["at"], turn["t1"], turn["t2"]) for seed in (7, 8)]
        return F.concat(names, F.array(F.struct(both[0].alias("n1"), both[1].alias("n2"))))

    return F.aggregate(turn_list, F.array(one), step)


def named_parts(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """conv_id, part, names (of the prefix before the part and of each prefix that ends in it), sizes."""
    part = F.floor(F.col("at") / HEIGHT).cast("bigint")
    lists = rows.groupBy("conv_id", part.alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("at", "t1", "t2", "size"))).alias("turns")
    )
    lists = stored(lists)
    zero = F.lit(0).cast("bigint")
    whole = F.element_at(_chain(F.col("turns"), zero, zero), -1)
    full = lists.where(F.size("turns") == HEIGHT).select("conv_id", "part", whole.alias("x"))
    keys = stored(cut_names(stored(full.select("conv_id", "part", "x.*").toDF("conv_id", "part", "x1", "x2")), lengths))
    after = keys.select("conv_id", (F.col("part") - 1).alias("part"), F.struct(F.col("k1").alias("n1"), F.col("k2").alias("n2")).alias("end"))
    joined = lists.join(keys, ["conv_id", "part"], "left").join(after, ["conv_id", "part"], "left")
    names = _chain(F.col("turns"), F.coalesce("k1", zero), F.coalesce("k2", zero))
    # A full part's last prefix has the name under which the next part stands.
    names = F.when(
        F.col("end").isNotNull(), F.concat(F.slice(names, 1, HEIGHT), F.array(F.col("end")))
    ).otherwise(names)
    sizes = F.transform("turns", lambda t: t["size"])
    return joined.select("conv_id", "part", names.alias("names"), sizes.alias("sizes"))


def trie_nodes(parts: DataFrame) -> DataFrame:
    """Nodes below the root: name, parent's name, depth, smallest and number of members, size, names above in the part."""
    place = F.posexplode(F.slice("names", 2, HEIGHT)).alias("i", "name")
    rows = parts.select("conv_id", "part", "names", "sizes", place).select(
        "conv_id",
        "name",
        F.get("names", F.col("i")).alias("parent"),
        (F.col("part") * HEIGHT + F.col("i") + 1).alias("depth"),
        F.get("sizes", F.col("i")).alias("size"),
        F.slice("names", F.lit(2), F.col("i") + 1).alias("upto"),
    )
    return rows.groupBy("depth", "name").agg(
        F.first("parent").alias("parent"),
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.first("size").alias("size"),
        F.first("upto").alias("upto"),
    )


def grafted(own: DataFrame, parts: DataFrame, most: int) -> DataFrame:
    """name, n_leaves, saved: sums over each node's subtree.

    ``own`` has each node's own share (name, parent, depth, conv_id, upto, leaf, saved).  Sums within
    parts come first.  Then, from the lowest cuts to the highest, every lower forest's sum goes to
    the ancestors of its roots in the upper trie.
    """

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("name").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))

    shares = own.select(F.explode("upto").alias("name"), F.col("leaf").alias("n_leaves"), "saved")
    sums = stored(summed(shares))
    place = F.floor((F.col("depth") - 1) / HEIGHT).cast("bigint")
    roots = stored(
        own.where((F.col("depth") > 1) & ((F.col("depth") - 1) % HEIGHT == 0)).select(
            "name", "parent", "conv_id", place.alias("part")
        )
    )
    higher = stored(parts.where(F.size("names") == HEIGHT + 1).select("conv_id", "part", F.slice("names", 2, HEIGHT).alias("upper")))
    half = 1
    while half * HEIGHT < most:
        forests = roots.where(F.col("part") % (2 * half) == half).join(sums, "name")
        # All forests under one cut, told by any sequence that goes through it.
        under = forests.groupBy("parent").agg(
            F.min(F.struct("conv_id", "part")).alias("by"),
            F.sum("n_leaves").alias("n_leaves"),
            F.sum("saved").alias("saved"),
        )
        above = F.explode(F.sequence(F.col("by.part") - half, F.col("by.part") - 1)).alias("part")
        pushed = under.select(F.col("by.conv_id").alias("conv_id"), above, "n_leaves", "saved")
        pushed = pushed.join(higher, ["conv_id", "part"]).select(F.explode("upper").alias("name"), "n_leaves", "saved")
        sums = stored(summed(sums.unionByName(pushed)))
        half *= 2
    return sums


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one name in sorted (n1, n2, conv_id) rows, as comma-joined text of bounded length."""
    names = ["n1", "n2", "first", "text"]
    for batch in batches:
        n1, n2, ids = (batch.column(k).to_numpy() for k in range(3))
        new = (np.diff(n1, prepend=n1[:1]) != 0) | (np.diff(n2, prepend=n2[:1]) != 0)
        edges = np.flatnonzero(new | (np.arange(len(ids)) % (SEGMENT // 16) == 0)).tolist()
        text = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(edges, [*edges[1:], len(ids)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(n1[edges]), pa.array(n2[edges]), pa.array(ids[edges]), pa.array(text)], names)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each run of rows of one name; only its state is held."""
    key, state = None, None

    def out(done: list) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) if done else [(), (), ()]
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())],
            ["n1", "n2", "ends_sha256"],
        )

    for batch in batches:
        done = []
        for n1, n2, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
            if (n1, n2) == key:
                state.update(b"," + text.encode())
                continue
            if key is not None:
                done.append((*key, state.hexdigest()))
            key, state = (n1, n2), hashlib.sha256(text.encode())
        yield out(done)
    if key is not None:
        yield out([(*key, state.hexdigest())])


def end_digests(ends: DataFrame) -> DataFrame:
    """n1, n2, ends_sha256 of the ids (conv_id) of each name, ascending and comma-joined.

    A digest is one run over its text, however long, so its last step is one task a name.  Ids are
    sorted and joined by ranges before, so that this task streams over long pieces of text.
    """
    order = ["n1", "n2", "conv_id"]
    by_range = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    text = stored(by_range.mapInArrow(_segments, "n1 bigint, n2 bigint, first bigint, text string"))
    by_name = text.repartition("n1", "n2").sortWithinPartitions("n1", "n2", "first")
    return by_name.mapInArrow(_digested, "n1 bigint, n2 bigint, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations`` has conv_id, turn, role, text.  A null role or text is empty, a null turn comes
    first, turns of one number are in the order of role and text; repeated rows are turns of their
    own.  Rows without a conv_id belong to no conversation and take no part.  An empty table has no
    conversation and so no root.  Other columns are not read.
    """
    rows, lengths = rebuilt(stored(turns(conversations)))
    lengths = stored(lengths)
    parts = stored(named_parts(rows, lengths))
    nodes = stored(trie_nodes(parts))
    children = nodes.groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    # The root's name is that of no turns: zeros.
    below = nodes.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    saved = (F.col("n_convs") - 1) * F.col("size")
    own = stored(below.select("*", (F.col("n_children") == 0).cast("bigint").alias("leaf"), saved.alias("saved")))
    least, number, most = lengths.agg(F.min("conv_id"), F.count(F.lit(1)), F.max("n")).first()
    sums = grafted(own, parts, most or 0)
    # Ends: a sequence's last part has its last name; without turns it ends at the root.
    ends = parts.groupBy("conv_id").agg(F.max(F.struct("part", F.element_at("names", -1).alias("name"))).alias("last"))
    zero = F.lit(0).cast("bigint")
    ends = lengths.join(ends, "conv_id", "left").select(
        F.coalesce("last.name.n1", zero).alias("n1"), F.coalesce("last.name.n2", zero).alias("n2"), "conv_id"
    )
    digests = stored(end_digests(ends)).select(F.struct("n1", "n2").alias("name"), "ends_sha256")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    parents = own.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    # Children of the root, which may be very many, need no join to know their parent.
    first = own.where("depth = 1").withColumn("parent_conv_id", F.lit(least).cast("bigint"))
    deeper = own.where("depth > 1").join(parents, "parent")
    low = first.unionByName(deeper.select(*first.columns)).join(sums.withColumnRenamed("saved", "saved_tokens"), "name")
    top = own.where("depth = 1").join(sums.withColumnRenamed("saved", "saved_tokens"), "name").agg(
        F.count(F.lit(1)).alias("n_children"),
        F.greatest(F.coalesce(F.sum("n_leaves"), F.lit(0)), F.lit(1).cast("bigint")).alias("n_leaves"),
        F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"),
    )
    root = top.where(F.lit(number > 0)).select(
        F.lit(least).cast("bigint").alias("conv_id"),
        zero.alias("depth"),
        F.lit(None).cast("bigint").alias("parent_conv_id"),
        F.lit(number).cast("bigint").alias("n_convs"),
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.struct(zero.alias("n1"), zero.alias("n2")).alias("name"),
    )
    whole = low.select(*root.columns).unionByName(root).join(digests, "name", "left")
    return whole.select(*[c for c in root.columns if c != "name"], F.coalesce("ends_sha256", empty).alias("ends_sha256"))
