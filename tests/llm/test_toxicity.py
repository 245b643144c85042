"""The recurrent network: gradients, plain forward pass, held-out accuracy, windows, awkward tables."""
from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from patronage.llm import toxicity
from tests.llm.frames import awkward, documents, empty, prose

LABELS = "doc_id long, quality int, toxic int, text string, score string"
INSULTS = ["idiot", "scumbag", "moron", "worthless", "pathetic"]


def corpus(n: int, seed: int, insults=INSULTS):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = prose(rng, rng.choice([5, 30, 90, 200])).split()
        toxic = rng.random() < 0.4
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(insults) for _ in range(rng.randint(1, 3))]
        out.append((i, " ".join(words), int(toxic)))
    return out


@pytest.fixture(scope="module")
def model():
    rows = corpus(900, 1)
    return toxicity.fit([t for _, t, _ in rows], [y for _, _, y in rows])


def plain_logit(p, text: list[bytes]) -> float:
    """One window, word by word, straight from the definition."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    h, x = toxicity.HIDDEN, []
    for w in text:
        block = toxicity.block_of([[w]])
        x.append(p["word"][block.word[0]].astype(float) @ p["from_word"] + p["gram"][block.gram[block.gram < toxicity.NONE]].astype(float).mean(0) @ p["from_gram"] + p["bias"])
    states = [[None] * len(x), [None] * len(x)]
    for way in (0, 1):
        now = np.zeros(h)
        for t in (range(len(x)) if way == 0 else reversed(range(len(x)))):
            a = x[t][3 * h * way:3 * h * (way + 1)]
            old = now @ p["gates"][way]
            gate = sigmoid(a[:2 * h] + old[:2 * h])
            new = np.tanh(a[2 * h:] + gate[h:] * old[2 * h:])
            now = (1 - gate[:h]) * new + gate[:h] * now
            states[way][t] = now
    both = np.array([np.concatenate([a, b]) for a, b in zip(*states)])
    weight = np.exp(np.tanh(both @ p["attend"]) @ p["query"])
    return float((weight / weight.sum()) @ both @ p["out"] + p["prior"][0])


def test_forward_pass_equals_a_plain_one(model):
    rng = random.Random(4)
    texts = [toxicity.words(prose(rng, n) + " moron x") for n in (1, 7, 20, 30)]
    block = toxicity.block_of(texts)
    got = toxicity.window_logits(model.parameters, block)
    assert np.allclose(got, [plain_logit(model.parameters, t) for t in texts], atol=1e-3)


def test_gradients_equal_differences():
    rng = random.Random(2)
    block = toxicity.block_of([toxicity.words(prose(rng, n)) for n in (3, 9, 32, 1)])
    p = {k: v.astype(np.float64) for k, v in toxicity.parameters(3).items()}
    p["word"] += np.random.default_rng(0).normal(0, 0.3, p["word"].shape)
    which, label, weight = np.arange(4), np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 1, 1])
    args = (block, toxicity._codes(block, which), block.size[which], label, weight)
    g, _ = toxicity.gradients(p, *args)
    pick = np.random.default_rng(1)
    for name in p:
        spots = np.argwhere(np.abs(g[name]) > 1e-7)
        for spot in map(tuple, spots[pick.integers(0, len(spots), 6)]):
            sides = []
            for shift in (1e-3, -1e-3):
                moved = dict(p, **{name: p[name].copy()})
                moved[name][spot] += shift
                sides.append(toxicity.gradients(moved, *args)[1])
            assert (sides[0] - sides[1]) / 2e-3 == pytest.approx(g[name][spot], rel=0.05, abs=2e-5), (name, spot)


def test_windows_cover_every_word_and_overlap():
    for n in (0, 1, 31, 32, 33, 48, 100, 1000):
        spans = toxicity.windows(n)
        assert set(range(n)) == {i for a, b in spans for i in range(a, b)}
        assert all(b - a == min(n, toxicity.WINDOW) for a, b in spans)
        assert all(y[0] - x[0] <= toxicity.STRIDE for x, y in zip(spans, spans[1:]))


def test_held_out_texts_unseen_forms_and_long_texts(model):
    rows = corpus(400, 2)
    scores = np.array(toxicity.scores_of([t for _, t, _ in rows], model))
    truth = np.array([y for _, _, y in rows])
    assert ((scores >= 0.5) == truth).mean() > 0.97
    other = corpus(400, 3, ["idiotic", "scumbags", "moronic", "worthlessly"])  # forms never seen: told by their characters
    scores = np.array(toxicity.scores_of([t for _, t, _ in other], model))
    truth = np.array([y for _, _, y in other])
    assert (scores[truth == 1] >= 0.5).mean() > 0.8 and (scores[truth == 0] >= 0.5).mean() < 0.05
    rng = random.Random(9)
    long_text = prose(rng, 20000)
    low, high = toxicity.scores_of([long_text, long_text[:60000] + " moron idiot " + long_text[60000:]], model)
    assert low < 0.5 <= high


def test_queries_learn_only_from_rows_that_are_not_held_out(spark):
    rows = corpus(600, 5)
    docs = documents(spark, [(i, t, *[None] * 11) for i, t, _ in rows]).repartition(3)
    flip = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    honest = spark.createDataFrame([(i, 0, y, "clash", "clash") for i, _, y in rows], LABELS)
    poisoned = spark.createDataFrame([(i, 0, 1 - y if flip(i) else y, None, None) for i, _, y in rows], LABELS)
    got = [sorted(map(tuple, toxicity.predict(docs, toxicity.train(docs, labels)).collect())) for labels in (honest, poisoned)]
    assert got[0] == got[1]
    truth = {i: y for i, _, y in rows}
    held = [r for r in got[0] if r[1]]
    assert all(r[1] == flip(r[0]) for r in got[0]) and np.mean([truth[r[0]] == r[3] for r in held]) > 0.9


def test_awkward_and_empty_tables(spark):
    labels = spark.createDataFrame([(i, 0, y, None, None) for i, y in [(8, 1), (9, 0), (13, 0), (14, 1), (15, 0), (14, 0), (None, 1), (16, None)]], LABELS)
    got = toxicity.predict(documents(spark), toxicity.train(documents(spark), labels)).collect()
    assert len(got) == len(awkward()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    void = {r["score"] for r in got if r["doc_id"] in (0, 1, 2)}
    assert len(void) == 1  # null, empty and blank texts score alike
    assert toxicity.predict(empty(spark), toxicity.train(empty(spark), labels)).collect() == []
    alone = toxicity.train(documents(spark), labels.limit(0))
    assert {r["score"] for r in toxicity.predict(documents(spark), alone).collect()} == {0.0}
