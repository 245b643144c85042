"""Ranked search against scores computed plainly."""
from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from patronage.llm import search
from tests.llm.frames import awkward, documents, empty, prose

ITEMS = "item_id long, text string, doc_id string, rank string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=10):
    counted = [(d, Counter(words(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n, terms = len(counted), sum(x[2] for x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * v + 1))) for t, v in df.items()}
    for item, text in {(i, t) for i, t in items if t is not None}:
        scores = []
        for d, c, size in counted:
            m = 100 - 75 + 75 * size * n // terms
            s = sum(weight[t] * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in words(text) if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        for rank, (s, none, d) in enumerate(sorted(scores)[:k], 1):
            yield item, rank, None if none else d, -s


def items_of(seed=3):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(1, 30)), "clash", "clash") for i in range(12)]
    rows += [(20, None, None, None), (21, "", None, None), (22, "?! --", None, None), (23, "THE the The of", None, None), (24, "ééé ñ x", None, None), (25, "nowhere-to-be-found", None, None)]
    return rows + [rows[0], (0, "another text of the same item", None, None), (None, "river stone", None, None)]


def test_ranks_equal_plain_scores(spark):
    rows = awkward()
    want = Counter(plain([r[:2] for r in rows], [r[:2] for r in items_of()]))
    items = spark.createDataFrame(items_of(), ITEMS)
    for block_chars in (search.BLOCK_CHARS, 300):  # one broadcast, and several
        got = Counter(map(tuple, search.ranked(documents(spark).repartition(4), items, block_chars=block_chars).collect()))
        assert got == want


def test_empty_sides(spark):
    items = spark.createDataFrame(items_of(), ITEMS)
    assert search.ranked(empty(spark), items).collect() == []
    assert search.ranked(documents(spark), spark.createDataFrame([], ITEMS)).collect() == []


@pytest.mark.parametrize("width", [4, 64, 2048])
def test_bounds_hold_and_stop_the_search(width):
    rng = random.Random(1)
    names = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choices(names, k=rng.randint(1, 200))) for _ in range(600)]
    queries = search.compiled([" ".join(rng.choices(names, k=12)) for _ in range(30)])
    found = search.postings([search.terms(t) for t in texts])
    holders = np.bincount(search.asked_of(found, queries)[found.term][search.asked_of(found, queries)[found.term] >= 0], minlength=len(queries.names))
    weight = search.weights(holders, len(texts))
    impact = search.impacts(found.tf, found.length[found.doc], len(texts), int(found.length.sum()))
    bound = search.upper_bounds(search.sketches(found, impact, width), search.coordinates(queries.names, width), queries, weight)
    score = search.Scorer(found, impact, queries, weight)
    doc, item = (x.ravel() for x in np.indices(bound.shape))
    exact = score(doc, item).reshape(bound.shape)
    assert (bound >= exact).all()
    best = search.Best(30, 10)
    looked = search.rescored(bound, score, np.arange(600), np.zeros(600, dtype=np.int64), best)
    if width == 2048:
        assert looked < bound.size / 5
    for i in range(30):
        order = np.lexsort((np.arange(600), -exact[:, i]))[:10]
        want = [(exact[d, i], d) for d in order if exact[d, i] > 0]
        assert list(zip(best.score[best.item == i], best.doc[best.item == i])) == want


def test_ties_go_to_the_smaller_doc_id_over_blocks(spark):
    docs = documents(spark, [(100 - i, "same words here", *[None] * 11) for i in range(60)] + [(None, "same words here", *[None] * 11)])
    items = spark.createDataFrame([(1, "words", "", "")], ITEMS)
    assert [r["doc_id"] for r in search.ranked(docs.repartition(7), items).orderBy("rank").collect()] == list(range(41, 51))


def test_blocks_hold_few_documents_however_short(monkeypatch):
    texts = [f"w{i % 7}" for i in range(5000)]
    found = list(search.blocks([{"doc_id": list(range(5000)), "text": texts}], most_docs=300))
    assert max(len(ids) for ids, _ in found) == 300 and [i for ids, _ in found for i in ids] == list(range(5000))
    assert all(len(p.length) == len(ids) for ids, p in found)
