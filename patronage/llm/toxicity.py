"""Toxicity: a bidirectional gated recurrent network with attention pooling over words and their characters.

A word enters as the sum of two projections: one of its own (hashed) embedding, one of the mean embedding of its
hashed character n-grams, word ends included, so that unseen forms of a word still look like it. Two gated
recurrent layers read a window of WINDOW words from either end, attention weighs their states, and a logistic unit
scores the pooled state. Windows overlap by half; a text scores as high as its highest window, so one passage in a
very long text counts as much as in a short one.

Everything is numpy. Training takes a bounded sample of labelled rows (``docs_per_label`` of either label at most, of at most
``most_chars`` characters in all, half of them for either label, drawn by hash of id and text; a text longer than what is
left of that is passed over) and
learns which windows of a positive text are meant: first all of them, then in each round the highest ones and, for
negative texts, the highest ones and others. Scoring is one pass over the texts; projections are computed once for
each different word of a block.

Defined results: null, empty and wordless texts are one empty window, scored by the bias of an empty pool; without
labelled rows of both kinds every text scores the share of label 1 (0 without any label); ids that are null or
given twice among the labels aren't learned from; repeated rows score alike; further columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import map_rows

WINDOW, STRIDE = 32, 16
HIDDEN, EMBED = 16, 16
WORD_BITS, GRAM_BITS = 14, 15
GRAMS = (3, 4)
DOCS, CHARS, DRAWS = 2500, 8_000_000, 1 << 40
#: Rounds and steps of training, at least; windows in a step; rate.
ROUNDS, STEPS, BATCH, RATE = 4, 120, 256, 0.004
#: Embeddings shrink by this share of the rate in each step.
FADE, FADING = 1.0, ("word", "gram")
#: Weight of all windows of label 0 against those of label 1.
CLEAN_WEIGHT = 6.0
BLOCK_WORDS = 200_000
#: Windows that go through the network together.
TOGETHER = 1024
_FOLD = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Bucket of no n-gram; its embedding stays zero.
NONE = 1 << GRAM_BITS
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_FOLD).split()


def windows(count: int) -> list[tuple[int, int]]:
    """(start, end) of the overlapping windows of a text of that many words; the last one ends with the text."""
    if count <= WINDOW:
        return [(0, count)]
    starts = list(range(0, count - WINDOW, STRIDE)) + [count - WINDOW]
    return [(s, s + WINDOW) for s in starts]


@dataclass
class Block:
    """Words of texts as codes, their windows, and the features of each different word."""
    code: np.ndarray
    start: np.ndarray
    size: np.ndarray
    text: np.ndarray  # of each window
    word: np.ndarray  # bucket of each different word
    gram: np.ndarray  # len(GRAMS) x places: buckets of the n-grams at each place, word after word; NONE where a word ends before
    first: np.ndarray  # where the places of each word begin, and the end
    count: np.ndarray  # n-grams of each word


def block_of(tokens: list[list[bytes]]) -> Block:
    coded = pa.array([w for t in tokens for w in t], type=pa.binary()).dictionary_encode()
    names = coded.dictionary.to_pylist()
    word = np.fromiter((xxhash.xxh32_intdigest(w) for w in names), dtype=np.int64, count=len(names)) & ((1 << WORD_BITS) - 1)
    gram, first, count = grams(names)
    offset, start, size, text = 0, [], [], []
    for i, t in enumerate(tokens):
        spans = windows(len(t))
        start += [offset + a for a, _ in spans]
        size += [b - a for a, b in spans]
        text += [i] * len(spans)
        offset += len(t)
    return Block(coded.indices.to_numpy().astype(np.int64), np.array(start), np.array(size), np.array(text), word, gram, first, count)


def grams(names: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the n-grams of bytes of each word with a mark at both ends, where each word's begin, and how many it has."""
    marked = np.frombuffer(b"\x01" + b"\x02\x01".join(names) + b"\x02" if names else b"", dtype=np.uint8).astype(np.uint64)
    length = np.fromiter(map(len, names), dtype=np.int64, count=len(names)) + 2
    first = np.concatenate([[0], np.cumsum(length)])
    rest = np.repeat(first[1:], length) - np.arange(len(marked))  # bytes from here to the end of the word
    out = np.full((len(GRAMS), len(marked)), NONE, dtype=np.int64)
    name = np.zeros(len(marked), dtype=np.uint64)
    for n in range(1, max(GRAMS) + 1):
        name = name[:max(0, len(marked) - n + 1)] * np.uint64(0x100000001B3) + marked[n - 1:] + np.uint64(1)
        if n in GRAMS:
            bucket = (((name + np.uint64(n)) * _MULTIPLY) >> np.uint64(64 - GRAM_BITS)).astype(np.int64)
            out[GRAMS.index(n), :len(name)] = np.where(rest[:len(name)] >= n, bucket, NONE)
    return out, first, sum(np.maximum(0, length - n + 1) for n in GRAMS)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


#: Parameters: embeddings, their projections onto the gates of both directions, recurrent weights, attention, output.
Parameters = dict[str, np.ndarray]


def parameters(seed: int) -> Parameters:
    rng = np.random.default_rng(seed)
    draw = lambda scale, *shape: (scale * rng.standard_normal(shape)).astype(np.float32)
    h, e = HIDDEN, EMBED
    return {
        "word": np.zeros((1 << WORD_BITS, e), np.float32), "gram": np.append(draw(0.05, NONE, e), np.zeros((1, e), np.float32), axis=0),  # what was never seen says next to nothing
        "from_word": draw(e ** -0.5, e, 6 * h), "from_gram": draw(e ** -0.5, e, 6 * h), "bias": np.zeros(6 * h, np.float32),
        "gates": draw(h ** -0.5, 2, h, 3 * h),
        "attend": draw((2 * h) ** -0.5, 2 * h, h), "query": draw(h ** -0.5, h), "out": draw((2 * h) ** -0.5, 2 * h), "prior": np.zeros(1, np.float32),
    }


def inputs(p: Parameters, block: Block, heard: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gate inputs of each word, mean of n-grams, embedding of each word); ``heard``: how much of each word's own embedding counts."""
    if not len(block.word):
        return np.zeros((0, 6 * HIDDEN), np.float32), np.zeros((0, EMBED), np.float32), np.zeros((0, EMBED), np.float32)
    at_place = p["gram"][block.gram[0]]
    for more in block.gram[1:]:
        at_place += p["gram"][more]
    mean = np.add.reduceat(at_place, block.first[:-1], axis=0) / block.count[:, None].astype(np.float32)
    own = p["word"][block.word]
    if heard is not None:
        own = own * heard
    return own @ p["from_word"] + mean @ p["from_gram"] + p["bias"], mean, own


@dataclass
class Pass:
    """What a forward pass leaves for the way back."""
    code: np.ndarray
    there: np.ndarray
    steps: list[list[tuple]]
    states: np.ndarray
    mixed: np.ndarray
    share: np.ndarray
    pooled: np.ndarray
    logit: np.ndarray


def both_ways(gate_in: np.ndarray) -> list[np.ndarray]:
    """The gate inputs of either direction."""
    return [np.ascontiguousarray(x) for x in np.split(gate_in, 2, axis=1)]


def forward(p: Parameters, gates_in: list[np.ndarray], code: np.ndarray, size: np.ndarray, keep: bool = False) -> Pass:
    """Logits of windows; ``code``: windows x WINDOW word numbers, of which the first ``size`` count."""
    n, h = len(code), HIDDEN
    longest = int(size.max()) if n else 0
    there = np.arange(longest)[None, :] < size[:, None]
    ragged = longest and not there.all()
    states = np.zeros((longest, n, 2 * h), np.float32)
    steps: list[list[tuple]] = [[], []]
    at_step = np.ascontiguousarray(code.T)
    for way in (0, 1):
        x_of = gates_in[way]
        now = np.zeros((n, h), np.float32)
        for t in range(longest) if way == 0 else range(longest - 1, -1, -1):
            x, old = x_of[at_step[t]], now @ p["gates"][way]
            gate = _sigmoid(x[:, :2 * h] + old[:, :2 * h])
            update, reset = gate[:, :h], gate[:, h:]
            inner = old[:, 2 * h:]
            new = np.tanh(x[:, 2 * h:] + reset * inner)
            after = new + update * (now - new)
            if ragged:
                after = np.where(there[:, t, None], after, now)
            if keep:
                steps[way].append((t, now, update, reset, inner, new))
            now = after
            states[t, :, h * way:h * (way + 1)] = now
    mixed = np.tanh(states @ p["attend"])
    score = np.where(there.T, mixed @ p["query"], -1e9)
    share = np.exp(score - score.max(0)) * there.T if longest else np.zeros((0, n))
    share = (share / np.maximum(share.sum(0), 1e-9)).astype(np.float32)
    pooled = np.einsum("tn,tnd->nd", share, states) if longest else np.zeros((n, 2 * h), np.float32)
    return Pass(code, there, steps, states, mixed, share, pooled, pooled @ p["out"] + p["prior"][0])


def backward(p: Parameters, f: Pass, d_logit: np.ndarray, n_words: int) -> tuple[Parameters, np.ndarray]:
    """Gradients of all parameters above the embeddings, and of the gate inputs of each word."""
    h = HIDDEN
    g = {k: np.zeros_like(p[k]) for k in ("gates", "attend", "query", "out", "prior")}
    g["out"], g["prior"] = f.pooled.T @ d_logit, d_logit.sum(keepdims=True)
    d_pooled = d_logit[:, None] * p["out"]
    d_states = f.share[:, :, None] * d_pooled
    d_share = np.einsum("tnd,nd->tn", f.states, d_pooled)
    d_score = f.share * (d_share - (f.share * d_share).sum(0))
    g["query"] = np.einsum("tn,tnh->h", d_score, f.mixed)
    d_mixed = d_score[:, :, None] * p["query"] * (1 - f.mixed ** 2)
    g["attend"] = np.einsum("tnd,tnh->dh", f.states, d_mixed)
    d_states = d_states + d_mixed @ p["attend"].T
    d_in = np.zeros((n_words, 6 * h), np.float32)
    for way in (0, 1):
        d_now = np.zeros((len(f.code), h), np.float32)
        for t, before, update, reset, inner, new in reversed(f.steps[way]):
            d_after = d_now + d_states[t, :, h * way:h * (way + 1)]
            d_real = np.where(f.there[:, t, None], d_after, 0)
            d_new = d_real * (1 - update) * (1 - new ** 2)
            d_update = d_real * (before - new) * update * (1 - update)
            d_reset = d_new * inner * reset * (1 - reset)
            d_old = np.concatenate([d_update, d_reset, d_new * reset], 1)
            g["gates"][way] += before.T @ d_old
            np.add.at(d_in, (f.code[:, t], slice(3 * h * way, 3 * h * (way + 1))), np.concatenate([d_update, d_reset, d_new], 1))
            d_now = np.where(f.there[:, t, None], d_real * update + d_old @ p["gates"][way].T, d_after)
    return g, d_in


def gradients(p: Parameters, block: Block, code: np.ndarray, size: np.ndarray, label: np.ndarray, weight: np.ndarray,
              heard: np.ndarray | None = None) -> tuple[Parameters, float]:
    """Gradients of the weighted mean log loss over windows, and the loss; ``heard``: see inputs()."""
    used, code = np.unique(code, return_inverse=True)
    code = code.reshape(len(size), -1)
    size_of = np.diff(block.first)[used]
    first = np.concatenate([[0], np.cumsum(size_of)])
    gram = block.gram[:, np.repeat(block.first[used] - first[:-1], size_of) + np.arange(first[-1])]
    part = Block(code, code, size, size, block.word[used], gram, first, block.count[used])
    heard = None if heard is None else heard[used]
    gate_in, mean, own = inputs(p, part, heard)
    f = forward(p, both_ways(gate_in), code, size, keep=True)
    chance = _sigmoid(f.logit)
    share = (weight / weight.sum()).astype(np.float32)
    loss = float((share * (np.logaddexp(0, f.logit) - label * f.logit)).sum())
    g, d_in = backward(p, f, (share * (chance - label)).astype(np.float32), len(used))
    g["bias"] = d_in.sum(0)
    g["from_word"], g["from_gram"] = own.T @ d_in, mean.T @ d_in
    g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
    d_own = d_in @ p["from_word"].T
    np.add.at(g["word"], part.word, d_own if heard is None else d_own * heard)
    d_place = np.repeat(d_in @ p["from_gram"].T / part.count[:, None].astype(np.float32), size_of, axis=0)
    for at in gram:
        np.add.at(g["gram"], at, d_place)
    g["gram"][NONE] = 0
    return g, loss


class Adam:
    def __init__(self, p: Parameters, rate: float) -> None:
        self.rate, self.t = rate, 0
        self.mean, self.square = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))

    def step(self, p: Parameters, g: Parameters) -> None:
        self.t += 1
        for k, v in g.items():
            self.mean[k] += 0.1 * (v - self.mean[k])
            self.square[k] += 0.001 * (v * v - self.square[k])
            if k in FADING:
                p[k] *= 1 - self.rate * FADE
            p[k] -= self.rate / (1 - 0.9 ** self.t) * self.mean[k] / (np.sqrt(self.square[k] / (1 - 0.999 ** self.t)) + 1e-8)


def _codes(block: Block, which: np.ndarray) -> np.ndarray:
    """Word numbers of windows, filled up with the first word where a window is short."""
    wide = int(block.size[which].max(initial=0))
    at = block.start[which][:, None] + np.minimum(np.arange(wide), np.maximum(block.size[which], 1)[:, None] - 1)
    return block.code[np.minimum(at, max(0, len(block.code) - 1))] if len(block.code) else np.zeros((len(which), 0), np.int64)


def window_logits(p: Parameters, block: Block) -> np.ndarray:
    """Logit of every window of a block; windows of like sizes go together."""
    gate_in = both_ways(inputs(p, block)[0])
    out = np.empty(len(block.size), np.float32)
    order = np.argsort(-block.size, kind="stable")
    for a in range(0, len(order), TOGETHER):
        which = order[a:a + TOGETHER]
        out[which] = forward(p, gate_in, _codes(block, which), block.size[which]).logit
    return out


@dataclass
class ToxicityModel:
    parameters: Parameters | None
    share: float  # of label 1, for models without parameters


def fit(texts: list[str | None], labels: list[int], rounds: int = ROUNDS, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 13) -> ToxicityModel:
    """Train on whole texts; labels 0 and 1."""
    if len(set(labels)) < 2:
        return ToxicityModel(None, float(np.mean(labels)) if labels else 0.0)
    rng = np.random.default_rng(seed)
    block, toxic = block_of([words(t) for t in texts]), np.array(labels, dtype=np.float32)
    label = toxic[block.text]
    p, per_text = parameters(seed), np.bincount(block.text)
    adam = Adam(p, rate)
    turn = 0
    while turn < rounds or adam.t < steps:
        if turn:
            logit = window_logits(p, block)
            order = np.lexsort((-logit, block.text))
            place = np.arange(len(order)) - np.searchsorted(block.text[order], block.text[order])
            chosen = order[(place < np.where(label[order] > 0, 1 + per_text[block.text[order]] // 64, 4)) | ((label[order] == 0) & (rng.random(len(order)) < 0.1))]
        else:
            chosen = np.arange(len(block.size))
        weight = np.ones(len(chosen), np.float32)
        for y in (0, 1):  # a text has many windows, and one is enough to call it toxic: label 0 weighs more
            mine = label[chosen] == y
            weight[mine] = (1 if y else CLEAN_WEIGHT) / max(1, mine.sum())
        rng.shuffle(chosen_order := np.arange(len(chosen)))
        for a in range(0, len(chosen), batch):
            some = chosen_order[a:a + batch]
            which = chosen[some]
            heard = (2.0 * (rng.random((len(block.word), 1)) < 0.5)).astype(np.float32)  # half of the words are told by their characters alone
            g, _ = gradients(p, block, _codes(block, which), block.size[which], label[which], weight[some], heard)
            adam.step(p, g)
        turn += 1
    return ToxicityModel(p, float(toxic.mean()))


def train(docs: DataFrame, labels: DataFrame, docs_per_label: int = DOCS, most_chars: int = CHARS, seed: int = 13) -> ToxicityModel:
    """Fit on a bounded sample of the labelled rows that aren't held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where("_id is not null and toxic in (0, 1)")
    known = known.groupBy("_id").agg(F.min("toxic").alias("toxic"), F.count(F.lit(1)).alias("_n")).where("_n = 1")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").isNotNull())
    marked = rows.withColumn("_draw", F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(DRAWS)))
    drawn = marked.select("doc_id", F.length("text").alias("_chars"), "_draw").join(known, F.col("doc_id") == F.col("_id"))  # texts stay where they are
    sizes = {r["toxic"]: r["n"] for r in drawn.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked: dict[int, int] = {}
    for y, n in sizes.items():  # a label's rows in the order of their draws, as far as the budget goes
        few = drawn.where((F.col("toxic") == y) & (F.col("_draw") < int(DRAWS * min(1.0, 1.3 * docs_per_label / n)))).select("_draw", "_chars")
        left = most_chars // 2
        for r in few.orderBy("_draw").limit(docs_per_label).collect():
            if r["_chars"] <= left:
                picked[r["_draw"]] = y
                left -= r["_chars"]
    sample = marked.where(F.col("_draw").isin(list(picked))).select("text", "_draw").dropDuplicates().orderBy("_draw", "text").collect() if picked else []
    return fit([r["text"] for r in sample], [picked[r["_draw"]] for r in sample], seed=seed)


def scores_of(texts: list[str | None], model: ToxicityModel) -> list[float]:
    """0 to 1 for each text: the highest of its windows."""
    if model.parameters is None:
        return [model.share] * len(texts)
    out: list[float] = []
    held, size = [], 0

    def flush() -> None:
        if held:
            block = block_of(held)
            top = np.full(len(held), -np.inf)
            np.maximum.at(top, block.text, window_logits(model.parameters, block).astype(float))
            out.extend(_sigmoid(top).tolist())
            held.clear()

    for text in texts:
        held.append(words(text))
        size += len(held[-1])
        if size >= BLOCK_WORDS:
            flush()
            size = 0
    flush()
    return out


def predict(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; only the text is an input of a score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            found = scores_of(batch["text"], shared.value)
            yield {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": found, "predicted": [int(s >= 0.5) for s in found]}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_rows(rows, "doc_id long, held_out boolean, score double, predicted int", score)
