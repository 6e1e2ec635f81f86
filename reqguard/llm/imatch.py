"""I-Match fingerprints, in DataFrame functions alone.

Terms are lower-cased runs of letters and digits.  Those whose inverse document frequency lies in a
band make the lexicon; a document keeps its terms that are in it, sorted and distinct, and hashes the
whole of them and those of several random subsets of the lexicon.  The subsets of one seed are nested,
each holding about a quarter of the one before, so that whatever number of terms a document has, some
subsets cut it down to a few; those still agree when a part of the text was replaced.

The lexicon is bounded whatever the corpus: document frequencies of at least ``min_fraction`` of N
documents with t terms each on average leave room for t / min_fraction terms.  It becomes a hash
table in an array literal, so that looking terms up is a step within the scan and no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

# Subsets come from the bits of a term's hash, and of its hash: eight for each seed, two for each level.
SEEDS_A_HASH = 8
LEVELS = 4
TABLE_BITS = 16


def distinct_terms(text: Column) -> Column:
    """64-bit hashes of a text's distinct terms, in no order; null and empty texts have none."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.transform(F.array_remove(F.array_distinct(words), ""), lambda w: F.xxhash64(w))


def term_hashes(text: Column) -> Column:
    return F.sort_array(distinct_terms(text))


def frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """term (hash) and the number of documents with it; counted before it is shuffled."""
    terms = docs.select(F.explode(distinct_terms(F.coalesce(F.col(text), F.lit("")))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def lexicon(docs: DataFrame, min_fraction: float, max_fraction: float, text: str = "text") -> DataFrame:
    """One row: the band's terms as a table of ``2**TABLE_BITS`` slots of hashes."""
    total = docs.count()
    low, high = max(2, min_fraction * total), max_fraction * total
    band = frequencies(docs, text).where((F.col("df") >= low) & (F.col("df") <= high))
    slot = F.pmod("term", F.lit(1 << TABLE_BITS)).cast("int")
    slots = band.groupBy(slot.alias("slot")).agg(F.array_sort(F.collect_list("term")).alias("terms"))
    nothing = docs.sparkSession.range(1 << TABLE_BITS).select(
        F.col("id").cast("int").alias("slot"), F.array().cast("array<bigint>").alias("terms")
    )
    filled = slots.unionByName(nothing).groupBy("slot").agg(F.max_by("terms", F.size("terms")).alias("terms"))
    table = F.transform(F.array_sort(F.collect_list(F.struct("slot", "terms"))), lambda x: x["terms"])
    return filled.agg(table.alias("slots"))


def _hash(terms: Column) -> Column:
    """A hash of the terms; 0 for none."""
    return F.when(F.size(terms) > 0, F.xxhash64(terms)).otherwise(F.lit(0).cast("bigint"))


def _without(terms: str, mask: Column) -> Column:
    return F.filter(terms, lambda h: h.bitwiseAND(mask) == 0)


def with_marks(rows: DataFrame, text: Column, name: str, slots: Column) -> DataFrame:
    """``rows`` with ``text``'s fingerprint as column ``name``: struct<whole bigint, subsets array<int>>.

    The hash of the kept terms, and half of those of the nested random subsets of each seed: a term
    is in a seed's level l iff the first 2 * l of the seed's eight bits of its hash are zero, so a
    level holds a quarter of the terms of the one before.  An empty subset is 0.  A text without
    any term of the lexicon keeps all of its terms.  Each step is a column of its own that the next
    refers to more than once, so that it is worked out once.
    """
    at = lambda h: F.get(slots, F.pmod(h, F.lit(1 << TABLE_BITS)).cast("int"))
    kept = F.when(F.size("_found") > 0, F.col("_found")).otherwise(F.col("_terms"))
    out = (
        rows.withColumn("_terms", term_hashes(text))
        .withColumn("_found", F.filter("_terms", lambda h: F.array_contains(at(h), h)))
        .withColumn("_kept_0", kept)
        .withColumn("_kept_1", F.transform("_kept_0", lambda h: F.xxhash64(h)))
    )
    seeds = [(k, s) for k in range(2) for s in range(SEEDS_A_HASH)]
    for level in range(LEVELS):
        columns = {}
        for k, s in seeds:
            before = f"_in_{k}_{s}_{level - 1}" if level else f"_kept_{k}"
            bits = 3 << (8 * s + 2 * level)
            # The highest bits make a negative number of 64.
            mask = F.lit(bits - (1 << 64) if bits >> 63 else bits).cast("bigint")
            columns[f"_in_{k}_{s}_{level}"] = _without(before, mask)
        out = out.withColumns(columns)
    upper = lambda h: F.shiftright(h, 32).cast("int")
    subsets = [upper(_hash(F.col(f"_in_{k}_{s}_{level}"))) for k, s in seeds for level in range(LEVELS)]
    mark = F.struct(_hash(F.col("_kept_0")).alias("whole"), F.array(*subsets).alias("subsets"))
    return out.select(*rows.columns, mark.alias(name))


def _digits(h: Column, count: int) -> Column:
    """The last hexadecimal digits of a number; ``-`` for an empty set's."""
    return F.when(h == 0, F.lit("-")).otherwise(F.right(F.lpad(F.lower(F.hex(h.cast("bigint"))), 16, "0"), F.lit(count)))


def as_text(mark: Column) -> Column:
    """The whole hash in 16 digits, then eight of each subset's."""
    subsets = F.transform(mark["subsets"], lambda h: _digits(h, 8))
    return F.concat_ws(" ", _digits(mark["whole"], 16), F.array_join(subsets, " "))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among those that are not empty on both sides; 1 for equal fingerprints."""
    pairs = F.arrays_zip(a["subsets"].alias("x"), b["subsets"].alias("y"))
    counted = F.size(F.filter(pairs, lambda p: (p["x"] != 0) | (p["y"] != 0)))
    equal = F.size(F.filter(pairs, lambda p: (p["x"] == p["y"]) & (p["x"] != 0)))
    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(F.try_divide(equal, counted), F.lit(0.0)).cast("double"))


# Stands for a null id, so that ids can be joined on; it comes last, as they do.
NO_ID = -(1 << 63)


def with_next(keys: DataFrame) -> DataFrame:
    """``keys`` (id, h, ...; one row each) with the key of the next row: ``next_id``, ``next_h``.

    The order is descending id, then hash; the first row follows the last.  Ranges of the order are
    dealt to tasks, so that no task holds more than its range; the last row of a range takes its
    successor from a table with the first row of each range.
    """
    order = [F.col("id").desc(), F.col("h").asc()]
    placed = stored(keys.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    here = F.struct("id", "h")
    within = Window.partitionBy("_range").orderBy(*order)
    led = placed.withColumn("_next", F.lead(here).over(within)).withColumn("_place", F.row_number().over(within))
    firsts = led.where("_place = 1").select("_range", here.alias("_first"))
    ranges = Window.orderBy("_range")
    first_of_all = F.first("_first").over(ranges.rowsBetween(Window.unboundedPreceding, 0))
    after = firsts.select("_range", F.coalesce(F.lead("_first").over(ranges), first_of_all).alias("_after"))
    nxt = F.coalesce("_next", "_after")
    return led.join(after, "_range").select(*keys.columns, nxt["id"].alias("next_id"), nxt["h"].alias("next_h"))


def edit_study(
    docs: DataFrame,
    min_fraction: float = 0.0005,
    max_fraction: float = 0.2,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Fingerprint every document and its edited text, and compare: one row for each row of ``docs``.

    The edited text has its last ``floor(n / 2)`` characters replaced by the first as many of the
    next document.  Rows equal in id and text count as one in the order, and all of them are
    followed by the next other row (a lone document by itself).  Null texts are empty; null ids come
    last; an empty table gives no rows; other columns are not read.

    Texts move once, by their key; the heads that documents need from their successors move in
    addition, at half a text each.
    """
    own = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(
        F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)).alias("id"), F.xxhash64(own).alias("h"), own.alias("text")
    )
    # Bounded, see above.  (Subqueries are not allowed within the functions over arrays.)
    table = lexicon(keyed, min_fraction, max_fraction).select(F.to_json("slots")).first()[0]
    slots = F.from_json(F.lit(table), "array<array<bigint>>")
    marks = with_marks(keyed, F.col("text"), "marks", slots)
    marks = stored(marks.select("id", "h", F.length("text").cast("bigint").alias("n"), "marks"))
    keys = marks.groupBy("id", "h").agg(F.first("n").alias("n"))
    chain = stored(with_next(keys))
    wanted = chain.select(
        F.col("next_id").alias("id"),
        F.col("next_h").alias("h"),
        F.struct("id", "h").alias("of"),
        F.floor(F.col("n") / 2).cast("int").alias("half"),
    )
    # Texts are more than a table of keys at any size, so the plan moves both.
    heads = keyed.join(wanted.hint("merge"), ["id", "h"]).select(
        "of.id", "of.h", F.substring("text", F.lit(1), F.col("half")).alias("head")
    )
    # Repeated rows bring the same head more than once.
    heads = heads.groupBy("id", "h").agg(F.max("head").alias("head"))
    kept = F.length("text") - F.floor(F.length("text") / 2).cast("int")
    joined = keyed.join(heads.hint("merge"), ["id", "h"]).select(
        "id", "h", F.concat(F.substring("text", F.lit(1), kept), F.col("head")).alias("edited")
    )
    edited = with_marks(joined, F.col("edited"), "edited_marks", slots).select(
        "id", "h", F.sha2("edited", 256).alias("edited_sha256"), "edited_marks"
    )
    # Fingerprints go to the rows that they are next to, and meet the rows' own there.
    once = marks.dropDuplicates(["id", "h"])
    following = wanted.select("id", "h", "of").join(once.select("id", "h", "marks"), ["id", "h"])
    following = following.select("of.id", "of.h", F.col("marks").alias("next_marks"))
    known = once.join(following, ["id", "h"])
    return edited.join(known, ["id", "h"]).select(
        F.nullif(F.col("id"), F.lit(NO_ID)).alias("doc_id"),
        F.col("n").alias("n_chars"),
        "edited_sha256",
        as_text(F.col("marks")).alias("fingerprint"),
        as_text(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"),
        likeness(F.col("marks"), F.col("next_marks")).alias("near_next"),
    )
