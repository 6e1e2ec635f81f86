"""The registered queries of the subpackage: SQL where there is some, contracts, the pipeline by brute force."""

from __future__ import annotations

import hashlib
import math
import re
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as contract
import corpus_pipeline
from oracle_check import compare, duck
from reqguard.llm import toxicity
from reqguard.llm.queries import ORACLE_SQL, QUERIES
from test_llm_operators import brute_exact, brute_near, brute_targets

SF = "/root/testdata/sf0.001"

COLUMNS = {
    "op1_linked_credentials": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op2_length_buckets": {"doc_id", "n_tokens", "bucket", "padded_length", "batch", "slot"},
    "op3_imatch": {
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    },
    "op4_cross_entropy_difference": {"doc_id", "n_tokens", "h_target", "h_background", "ce_difference"},
    "op5_binary_records": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op6_weighted_mix": {"doc_id", "size", "source_size", "target", "taken"},
    "op7_progressive_dedup": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op8_page_templates": {"page_id", "url", "text", "n_chars"},
    "op9_minmax_near_dedup": {"doc_id", "n_shingles", "component_id", "kept"},
    "op10_toxicity": {"doc_id", "held_out", "score", "predicted"},
}
# Their rows are not those of the table they read; SQL gives them.
OTHER_ROWS = {"op11_source_divergence", "op12_prefix_trie", "op13_topk_search"}


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_equals_sql(spark, name):
    same, n, _, note = compare(spark, duck(SF), name, QUERIES[name], ORACLE_SQL[name], SF)
    assert same, note
    assert n > 0


@pytest.mark.parametrize("name", COLUMNS)
def test_query_has_its_columns_and_all_rows(spark, name):
    found = contract.queries()[name](spark, SF)
    assert COLUMNS[name] <= set(found.columns)
    table = "pages" if name.startswith("op8_") else "documents"
    assert found.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_all_operators_and_the_pipeline_are_registered():
    registered = contract.queries()
    assert set(COLUMNS) | OTHER_ROWS | {"pipeline"} <= set(registered)
    assert OTHER_ROWS <= set(contract.oracle_sql())
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in contract.oracle_sql()


def brute_mix(rows):
    """(id, copies) of each row: keys in order, prefix sums to the budget."""
    size = [len(re.findall("[^\x20\x09-\x0d]+", t or "")) for _, t, *_ in rows]
    total = Counter()
    for (_, _, _, s, _), n in zip(rows, size, strict=True):
        total[s] += n
    target = brute_targets(total)
    out = []
    for s in total:
        epochs = int(target[s] / total[s]) if total[s] else 0
        rest, reached, keyed = target[s] - epochs * total[s], 0, []
        for (i, t, _, source, _), n in zip(rows, size, strict=True):
            if source == s:
                u = (int(hashlib.md5(f"{i}:17".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                quality = 0.5 + 0.5 * min(1.0, 6.0 * n / len(t)) if t else 0.5
                keyed.append((-math.log(u) / quality, i, n))
        for _, i, n in sorted(keyed):
            out.append((i, epochs + (reached + n / 2 <= rest)))
            reached += n
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = toxicity.train(docs.select("doc_id", "text"), labels).score([t or "" for _, t, *_ in rows])
    rows = [r for r, s in zip(rows, scores, strict=True) if s < toxicity.THRESHOLD]
    expected = [Counter(r[0] for r in rows)]
    keep = {min(g)[3] for g in brute_exact(rows).values()}
    rows = [r for k, r in enumerate(rows) if k in keep]
    expected.append(Counter(r[0] for r in rows))
    found = brute_near(rows)
    rows = [r for r, (i, n, c) in zip(rows, found, strict=True) if i == c or n == 0]
    expected.append(Counter(r[0] for r in rows))
    expected.append(Counter({i: n for i, n in brute_mix(rows) if n}))

    assert [name for name, _ in corpus_pipeline.STAGES][-1] == "packing"
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        if k < 4:
            assert Counter(r.doc_id for r in docs.select("doc_id").collect()) == expected[k], name
    words = sum(len(re.findall("[^\x20\x09-\x0d]+", r.text or "")) + 1 for r in before.select("text").collect())
    packed = docs.toPandas()
    assert packed.n_tokens.sum() == words and (packed.n_tokens <= packed.padded_length).all()
    assert corpus_pipeline.run(spark, SF).count() == len(packed)
