"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, stored
from . import (
    binary_records,
    credentials,
    cross_entropy,
    divergence,
    exact_dedup,
    imatch,
    minmax,
    mixing,
    packing,
    prefix_trie,
    templates,
    topk,
    toxicity,
)


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def _new_folder(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_folder(spark).rstrip('/')}/reqguard-{name}-{uuid.uuid4().hex}"


def op1_linked_credentials(spark: SparkSession, sf: str) -> DataFrame:
    return credentials.scan(_documents(spark, sf))


def op2_length_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(_documents(spark, sf))


def op3_imatch(spark: SparkSession, sf: str) -> DataFrame:
    return imatch.edit_study(_documents(spark, sf))


def op4_cross_entropy_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Target: documents labelled as of good quality; background: all documents."""
    good = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").select("doc_id")
    return cross_entropy.cross_entropy_difference(_documents(spark, sf), good)


def op5_binary_records(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    folder = _new_folder(spark, "records")
    binary_records.write_records(_documents(spark, sf), folder, path)
    return binary_records.write_index(spark, folder, path)


def op6_weighted_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf)).select("doc_id", "size", "source_size", "target", "taken")


def op7_progressive_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf).select("doc_id", "text")
    rows = exact_dedup.digests(docs, all_rows=True).select(
        "doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n_chars"), "_length", "_prefix", "_digest"
    )
    # Digested once: what follows reads the rows more than once.
    decided = exact_dedup.exact_duplicates(stored(rows))
    return decided.select("doc_id", "keep_id", "group_size", "kept", F.col("_digest").alias("text_sha256"))


def op8_page_templates(spark: SparkSession, sf: str) -> DataFrame:
    return templates.extract(spark.read.parquet(f"{sf}/pages.parquet"))


def op9_minmax_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = minmax.near_duplicates(_documents(spark, sf).select("doc_id", "text"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    return toxicity.scored(docs, toxicity.train(docs, labels))


def op11_source_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.divergence(_documents(spark, sf))


def op12_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf}/conversations.parquet"))


def op13_topk_search(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf}/embeddings.parquet"))


QUERIES = {
    "op1_linked_credentials": op1_linked_credentials,
    "op2_length_buckets": op2_length_buckets,
    "op3_imatch": op3_imatch,
    "op4_cross_entropy_difference": op4_cross_entropy_difference,
    "op5_binary_records": op5_binary_records,
    "op6_weighted_mix": op6_weighted_mix,
    "op7_progressive_dedup": op7_progressive_dedup,
    "op8_page_templates": op8_page_templates,
    "op9_minmax_near_dedup": op9_minmax_near_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_source_divergence": op11_source_divergence,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_topk_search": op13_topk_search,
}

_SPACE = r"[\x20\x09-\x0D]"

ORACLE_SQL = {
    "op6_weighted_mix": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         length(coalesce(text, '')) AS n
  FROM documents),
k AS (
  SELECT *, -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':17'), 1, 13) AS BIGINT) + 0.5)
                / 4503599627370496.0::DOUBLE)
            / (CASE WHEN n = 0 THEN 0.5 ELSE 0.5 + 0.5 * least(1.0, 6.0 * size / n) END)::DOUBLE AS key
  FROM d),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM d GROUP BY source),
l AS (
  SELECT *, 2.0::DOUBLE * source_size / weight AS level,
         (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER before, 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS if_uncapped
  FROM s WINDOW before AS (ORDER BY 2.0::DOUBLE * source_size / weight, source ASC NULLS LAST
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT arg_min(if_uncapped, level) AS common FROM l WHERE level >= if_uncapped),
t AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, common * weight) AS target,
         CASE WHEN source_size = 0 THEN 0
              ELSE CAST(floor(least(2.0::DOUBLE * source_size, common * weight) / source_size) AS BIGINT) END AS epochs
  FROM l, c),
r AS (
  SELECT k.doc_id, k.size, t.source_size, t.target, t.epochs,
         t.target - t.epochs * t.source_size AS rest,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS LAST
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN reached + size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
""",
    "op7_progressive_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r
""",
    "op11_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
w AS (
  SELECT r, lang, source, translate(unnest(words), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 30),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT c.lang, c.source, sum(c.n) AS total FROM c JOIN k USING (lang, term) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (coalesce(t.total, 0) + 5 * l.v) AS p,
         1 + 1000000000::HUGEINT * (k.n + 5) // (l.total + 5 * l.v) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang)
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN t ON t.lang = g.lang AND t.source = g.source),
f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y USING (lang, term)
                   WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM r WHERE part = 'pair' OR rank <= 50
""",
    "op12_prefix_trie": r"""
WITH t AS (
  SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, list(x ORDER BY pos) AS own FROM t GROUP BY conv_id),
h AS (
  -- CRC-32 of the decimal id, bit by bit.
  SELECT *, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                          lambda r, i: xor(r >> 1, (r & 1) * 3988292384)))) % 6 AS h
  FROM s),
r AS (
  SELECT h.conv_id, list_concat(coalesce(b.own[1:h.h], []), h.own[h.h + 1:]) AS seq
  FROM h LEFT JOIN s b ON b.conv_id = h.conv_id - h.conv_id % 100),
m AS (SELECT conv_id, len(seq) AS n, unnest(range(0, len(seq) + 1)) AS depth, seq FROM r),
k AS (SELECT conv_id, n, depth, seq[1:depth] AS prefix FROM m),
n AS (
  SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM k GROUP BY depth, prefix),
c AS (SELECT prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
o AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children,
         CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(prefix[depth].text) END AS saved
  FROM n LEFT JOIN c USING (prefix)),
u AS (SELECT prefix, n_children, saved, unnest(range(0, depth + 1)) AS upto FROM o),
a AS (
  SELECT prefix[1:upto] AS prefix, sum(CAST(n_children = 0 AS BIGINT)) AS n_leaves, sum(saved) AS saved_tokens
  FROM u GROUP BY 1)
SELECT o.conv_id, CAST(o.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, o.n_convs, CAST(o.n_children AS BIGINT) AS n_children,
       CAST(a.n_leaves AS BIGINT) AS n_leaves, CAST(a.saved_tokens AS BIGINT) AS saved_tokens, o.ends_sha256
FROM o JOIN a ON a.prefix = o.prefix LEFT JOIN n p ON o.depth > 0 AND p.prefix = o.prefix[1:o.depth - 1]
""",
    "op13_topk_search": r"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
  FROM v q JOIN v ON q.r <> v.r WHERE q.vec_id % 100 = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM o WHERE rank <= 10
""",
}
