"""The pipeline against a brute-force version of its stages."""
from __future__ import annotations

from collections import Counter

import corpus_pipeline
from patronage.llm import language, packing
from patronage.llm.decontaminate import REGION, regions_of
from patronage.llm.queries import table
from tests.llm.frames import documents, empty
from tests.llm.test_dedup import brute_targets, copy_groups
from tests.llm.test_text import sellers

TINY = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = table(spark, TINY, "documents")
    given = {r["doc_id"]: r for r in docs.collect()}
    first = corpus_pipeline.identify_language(spark, docs, TINY)
    ids = {r["doc_id"] for r in first.collect()}
    assert ids == {d for d, r in given.items() if r["text"] and any(map(str.isalpha, r["text"]))}
    second = corpus_pipeline.drop_near_duplicates(spark, first, TINY)
    low = copy_groups([(d, given[d]["text"]) for d in ids])
    kept = {d for d in ids if low[d] == d}
    assert Counter(r["doc_id"] for r in second.collect()) == Counter(kept)
    third = corpus_pipeline.drop_benchmark_leaks(spark, second, TINY)
    norm = lambda t: " ".join((t or "").lower().split())
    items = [norm(r["text"]) for r in table(spark, TINY, "benchmark").collect()]
    clean = {r["doc_id"] for r in third.collect()}
    held = {d for d in kept if any(i in norm(given[d]["text"]) for i in items)}
    assert not held & clean
    for d in kept - held - clean:  # dropped without an exact hit: within the edit budget of an item
        assert any(sellers(r, norm(given[d]["text"])) <= len(r) // 10 for i in items for r in regions_of(i, REGION))
    fourth = corpus_pipeline.mix_sources(spark, third, TINY)
    copies = Counter(r["doc_id"] for r in fourth.collect())
    sizes = {d: len((given[d]["text"] or "").split()) for d in clean}
    total, taken, largest = Counter(), Counter(), Counter()
    for d in clean:
        s = given[d]["source"]
        total[s] += sizes[d]
        taken[s] += copies[d] * sizes[d]
        largest[s] = max(largest[s], sizes[d])
    for s, t in brute_targets(dict(total)).items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1
    for stage in (first, second, third, fourth):
        assert stage.columns == docs.columns
    rows = packing.packed(fourth).collect()
    assert Counter(d for r in rows for d, p in zip(r["doc_ids"], r["pieces"]) if p == 0) == copies
    assert corpus_pipeline.run(spark, TINY).count() == len(rows)


def test_stages_on_awkward_and_empty_tables(spark):
    for docs in (documents(spark), empty(spark)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, TINY)
            assert docs.columns == columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, TINY).count() >= 0


def test_stage_names():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["identify_language", "drop_near_duplicates", "drop_benchmark_leaks", "mix_sources", "pack_tokens"]
    assert language.UNKNOWN == "und"
