"""Each stage keeps what it should, and the whole equals its parts."""

from __future__ import annotations

import corpus_pipeline as cp
from pendscope.llm import bpe, ngram_join, pii, quality_rules
from tokenizers import Tokenizer

from conftest import SF_DIR
from llm_cases import awkward, nothing  # noqa: F401
from pendscope.llm.common import table


def test_stages_on_awkward_rows(spark, awkward, nothing):
    for docs in (awkward, nothing):
        for name, stage in cp.STAGES[:-1]:
            out = stage(spark, docs, SF_DIR)
            assert sorted(out.columns) == sorted(docs.columns), name
        last = cp.STAGES[-1][1](spark, docs, SF_DIR)
        assert last.count() == docs.count() and {"doc_id", "ids", "n_tokens"} <= set(last.columns)


def test_run_against_brute_force(spark):
    docs = {r["doc_id"]: r for r in table(spark, SF_DIR, "documents").collect()}
    good = {r["doc_id"] for r in quality_rules.quality(table(spark, SF_DIR, "documents")).collect() if r["kept"]}
    sets = {k: set(ngram_join.gram_set(docs[k]["text"]).tolist()) for k in sorted(good)}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    firsts = {k for k in sets if find(k) == k}
    library = Tokenizer.from_file(bpe.tokenizer_path())
    rows = cp.run(spark, SF_DIR).collect()
    assert {r["doc_id"] for r in rows} <= firsts
    sizes, taken = {}, {}
    for k in firsts:
        text = docs[k]["text"] or ""
        sizes[docs[k]["source"]] = sizes.get(docs[k]["source"], 0) + len(text.encode().split())
    for r in rows:
        text = docs[r["doc_id"]]["text"]
        text = pii.replaced(text, pii.stored_key(spark))[0] or text
        assert r["ids"] == library.encode(text, add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])
        taken[r["source"]] = taken.get(r["source"], 0) + len(text.encode().split())
    assert abs(sum(taken.values()) / sum(sizes.values()) - 1.5) < 0.1
    assert all(taken.get(s, 0) <= 2 * n for s, n in sizes.items())
