"""Source divergence, prefix trie and top-k search against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reqguard.llm import divergence, prefix_trie, topk

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TURNS = "conv_id bigint, turn bigint, role string, text string"
VECTORS = "vec_id bigint, embedding array<float>, label int"
CLASHING = "level mark term prefix number block n docs pos at part names size list chunk entries id x".split()


def with_clashes(df):
    return df.withColumns({c: F.lit("x") for c in CLASHING if c not in df.columns})


def sorted_rows(rows):
    return sorted((tuple(r) for r in rows), key=repr)


# --- 11: source divergence -----------------------------------------------------------------------


def brute_terms(text):
    found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in found]


def brute_divergence(rows, least):
    docs = [(lang or "", source or "", brute_terms(text)) for _, text, lang, source, _ in rows]
    groups = defaultdict(Counter)
    held = defaultdict(Counter)
    for lang, source, terms in docs:
        groups[lang, source].update(terms)
        held[lang].update(set(terms))
    out = []
    for lang, held_by in held.items():
        kept = [t for t, n in held_by.items() if n >= least]
        mine = {s: c for (g, s), c in groups.items() if g == lang}

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        whole = shares(sum(mine.values(), Counter()))
        p = {s: shares(c) for s, c in mine.items()}
        for s in mine:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in mine if o != s]
            terms = [(t, p[s][t] - whole[t]) for t in kept if mine[s][t] and p[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, 50)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted_rows(out)


def term_rows():
    rng = np.random.default_rng(3)
    # Prefixes that many documents hold though no term does, terms that are prefixes of terms,
    # terms that end at a level's length, letters beyond ASCII, a term far longer than any level.
    words = ["a", "ab", "abc", "abcd", "abcde", "ABcdefgh", "abcdefghi", "éa", "éabcdefgh", "ﬁx", "漢字", "z" * 5000]
    rows = []
    for k in range(160):
        text = " ".join(rng.choice(words, rng.integers(0, 12))) + f" common{rng.integers(0, 10**9)} x1y"
        rows.append((k, text, ["en", "fr", None][k % 3], f"s{k % 4}", 1))
    rows += [(1, "abcd abcd ABCD", "en", None, 0)] * 12
    rows += [(None, None, "en", "only null", None), (5, "", "xx", "alone", 0), (6, "rare words", "yy", "a", 0), (6, "other", "yy", "", 0)]
    return rows


@pytest.mark.parametrize("least", [12, 30])
def test_divergence_equals_brute_force(spark, least):
    rows = term_rows()
    df = with_clashes(spark.createDataFrame(rows, DOCS).repartition(5))
    found = divergence.divergence(df, least)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted_rows(found.collect()) == brute_divergence(rows, least)


def test_divergence_does_not_depend_on_chunks_or_on_the_bitmap(spark, monkeypatch):
    rows = term_rows()
    monkeypatch.setattr(divergence, "CHUNK_BYTES", 300)
    # The workers import the module anew, so the small chunks are made here.
    table = pa.Table.from_pylist([{"t": t or "", "l": g or "", "s": s or ""} for _, t, g, s, _ in rows])
    chunks = pa.Table.from_batches(list(divergence._gathered(iter(table.combine_chunks().to_batches()))))
    assert len(chunks) > 10
    made = spark.createDataFrame(chunks.to_pandas().map(lambda v: v.tolist() if isinstance(v, np.ndarray) else v), divergence._CHUNK)
    whole = divergence.kept_counts(divergence.gathered(spark.createDataFrame(rows, DOCS)), 12)
    monkeypatch.setattr(divergence, "_bitmap", lambda living, count: np.full(1 << 10, ~np.uint64(0)))
    assert sorted_rows(divergence.kept_counts(made, 12).collect()) == sorted_rows(whole.collect())


def test_divergence_takes_little_memory_for_a_chunk():
    rng = np.random.default_rng(5)
    words = np.array([f"w{np.base_repr(k, 26).translate(str.maketrans('0123456789', 'qrstuvwxyz'))}" for k in range(60_000)])
    texts = [" ".join(words[rng.integers(0, len(words), 400)]) for _ in range(7_000)]
    size = sum(map(len, texts))
    assert size < 2 * divergence.CHUNK_BYTES
    docs = pa.record_batch({"t": texts, "l": [f"l{k % 4}" for k in range(7_000)], "s": [f"s{k % 20}" for k in range(7_000)]})

    def peak(work):
        tracemalloc.start()
        try:
            made = work()
            return tracemalloc.get_traced_memory()[1], made
        finally:
            tracemalloc.stop()

    most, chunks = peak(lambda: list(divergence._gathered(iter([docs]))))
    assert most < 10 * divergence.CHUNK_BYTES
    # Chunks that come together are taken one at a time, and what they give goes out in small batches.
    together = pa.Table.from_batches(chunks * 4).combine_chunks().to_batches()
    for level, before in ((2, 0), (4, 0)):
        most, sizes = peak(lambda k=level, j=before: [len(b) for b in divergence._level(iter(together), k, j, None)])
        assert most < 16 * divergence.CHUNK_BYTES and max(sizes) <= 1 << 15


def test_divergence_of_an_empty_table(spark):
    assert divergence.divergence(spark.createDataFrame([], DOCS)).count() == 0


def test_terms_end_with_their_text():
    terms, at = divergence.terms_of(pa.array(["Ab", "cD1é", None, "", "-", "É"]))
    assert [t.decode() for t in terms.to_pylist()] == ["ab", "cd", "é", "É"]
    assert at.tolist() == [0, 1, 3, 3, 3, 3, 4]


# --- 12: prefix trie -----------------------------------------------------------------------------


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode(), text or ""))
    own = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in own.items()}
    members, rebuilt = defaultdict(list), {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:])
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        m = members[p]
        leaves[p] = sum(leaves[x] for x in children[p]) or 1
        saved[p] = sum(saved[x] for x in children[p]) + ((len(m) - 1) * len(p[-1][1]) if p else 0)
        ends = ",".join(map(str, sorted(c for c in m if rebuilt[c] == p)))
        parent = min(members[p[:-1]]) if p else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(m), len(p), parent, len(m), len(children[p]), leaves[p], saved[p], digest))
    return sorted_rows(out)


def test_trie_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    # Long sequences that part at depths around every cut, equal ones, hundreds with and without turns.
    trunk = [("user", f"turn {k}") for k in range(150)]
    for c in [0, *range(3, 40), 100, *range(107, 130), 250, -7, -100, -250, 10**15 + 3]:
        at = int(rng.choice([1, 3, 15, 16, 17, 31, 32, 33, 48, 64, 65, 128, 140]))
        kind = rng.integers(0, 3)
        seq = trunk[:at] + [("assistant", f"own {kind}")] * int(rng.integers(0, 40))
        rows += [(c, k, role, text) for k, (role, text) in enumerate(seq)]
    rows += [(60, None, None, None), (60, None, "a", None), (60, 1, None, "é\U0001f600"), (60, 1, None, "é\U0001f600"), (60, 1, "", "")]
    rows += [(61, 0, "user", "")] + [(None, 0, "user", "no conversation")] * 3
    rows += [(300 + k, j, "user", "same") for k in range(90) for j in range(7)]
    df = with_clashes(spark.createDataFrame(rows, TURNS).repartition(7))
    found = prefix_trie.prefix_trie(df)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert found.columns == names
    assert sorted_rows(found.collect()) == brute_trie(rows)


def test_trie_of_one_long_conversation(spark):
    rows = [(5, k, "user", f"{k % 7}") for k in range(3000)]
    found = prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS).repartition(3))
    assert sorted_rows(found.collect()) == brute_trie(rows)


def test_trie_without_conversations_or_turns(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    # A conversation whose turns are replaced by those of a hundredth that isn't there.
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 1)
    assert sorted_rows(prefix_trie.prefix_trie(spark.createDataFrame([(c, 0, "u", "t")], TURNS)).collect()) == [
        (c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())
    ]


def test_end_digests_run_over_pieces(spark):
    ends = spark.range(30000).select((F.col("id") % 2).alias("n1"), F.lit(1).cast("bigint").alias("n2"), F.col("id").alias("conv_id"))
    found = {r.n1: r.ends_sha256 for r in prefix_trie.end_digests(ends).collect()}
    assert found == {k: hashlib.sha256(",".join(map(str, range(k, 30000, 2))).encode()).hexdigest() for k in (0, 1)}


# --- 13: top-k -----------------------------------------------------------------------------------


def brute_top(rows, k, every):
    held = []
    for i, v, _ in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            held.append((i, [math.floor(1024 * x) for x in v]))
    out = []
    for at, (i, q) in enumerate(held):
        if i is not None and i % every == 0:
            scored = [(-sum(a * b for a, b in zip(q, v)), j is None, j or 0, j) for n, (j, v) in enumerate(held) if n != at]
            out += [(i, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k])]
    return sorted_rows(out)


def vector_rows(n, width, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, width))
    vectors = (centres[rng.integers(0, 5, n)] + 0.3 * rng.normal(size=(n, width))).astype("f4")
    return [(k, v.tolist(), 0) for k, v in enumerate(vectors)]


def test_topk_equals_brute_force(spark):
    rows = vector_rows(900, 9)
    rows += [(k, [0.25] * 9, 0) for k in (1000, 1001, 1002, 1000)] + [rows[100]] * 14
    rows += [(2000, None, 0), (2100, [1.0, None], 0), (2200, [float("nan")] * 9, 0), (2300, [float("inf"), 1.0], 0)]
    rows += [(None, [3.0] * 9, 0), (2400, [], 0), (2500, [-1.0], 0), (2600, [0.001] * 40, 0), (-300, [0.5, -0.5], 0)]
    df = with_clashes(spark.createDataFrame(rows, VECTORS).repartition(4))
    found = topk.top_k(df, 10, 100)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted_rows(found.collect()) == brute_top(rows, 10, 100)


def test_topk_over_several_blocks_and_merging_steps(spark, monkeypatch):
    rows = vector_rows(400, 4, 1)
    monkeypatch.setattr(topk, "NEIGHBOURS", 2)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 30)
    df = spark.createDataFrame(rows, VECTORS).repartition(9)
    assert sorted_rows(topk.top_k(df, 3, 2).collect()) == brute_top(rows, 3, 2)


@pytest.mark.parametrize("n", [0, 1, 2, 8])
def test_topk_with_few_rows(spark, n):
    rows = vector_rows(n, 3)
    assert sorted_rows(topk.top_k(spark.createDataFrame(rows, VECTORS), 10, 1).collect()) == brute_top(rows, 10, 1)


def test_topk_is_exact_beyond_doubles(spark):
    rows = [(k, [float(2**17 + k), float(-(2**18) + 3 * k), float(k) / 1024], 0) for k in range(40)]
    assert sorted_rows(topk.top_k(spark.createDataFrame(rows, VECTORS), 5, 10).collect()) == brute_top(rows, 5, 10)


def test_phases_leave_little_to_look_up():
    """The cutoff is safe: what it leaves out is below the k-th best score."""
    rng = np.random.default_rng(2)
    s = rng.integers(-1000, 1000, (2, 5000))
    tau = np.sort(s.sum(axis=0))[-10]
    half = topk._half(np.array([tau]))[0]
    out = (s < half).all(axis=0)
    assert out.any() and s.sum(axis=0)[out].max() < tau
