"""Secret scan: fixed patterns, and two character Markov models compared by log-likelihood ratio.

Base spans come from patterns. Beyond them, every token of MIN_TOKEN characters or more is scored under two
second-order character models of random strings and of ordinary tokens; the ratio of the likelihoods decides: its log
has to reach MIN_EVIDENCE, and MIN_RATIO for each character, so that short tokens need as much evidence as long ones.
Labelled samples: from a bounded, seeded sample of the documents, what the base patterns match is labelled
random and all other tokens ordinary. Seeded random keys of common alphabets and identifiers joined from words
stand in for kinds that a corpus happens to lack; they have models of their own, and the likelier model of
each label counts, so that a large corpus doesn't drown them.

Defined results: null text counts as empty (no spans, digest of the empty string); without any training text
the models rest on the stand-ins; repeated rows are scanned each; all work is linear in the text; further
columns are not read.
"""
from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import map_rows
from patronage.llm.spans import Span, digest, in_order, joined

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "random")
SAMPLE_DOCS = 2000
MIN_TOKEN = 12
#: Natural log of how much more likely a token has to be as a random string, in all and per character.
MIN_EVIDENCE, MIN_RATIO = 12.0, 0.8
#: Words of the corpus, the smallest by hash, that stand-ins are made of.
STAND_IN_WORDS = 500

# Words that identifiers, paths and messages are made of.
IDENTIFIER_WORDS = """account action active address admin agent alert align amount answer archive array article assert asset async author backup balance
base batch before binary block board body border bottom branch bridge browser buffer build bundle button cache callback cancel card cart catalog category
center chain change channel character chart check child city class clean clear click client clock close cloud cluster code collect color column comment
commit common company compare complete component config confirm connect console contact container content context control convert cookie copy core
count country create credit current custom customer database date debug default delete deploy detail device dialog dictionary digest directory disable
disk display document domain download draft driver dump edit element email enable encode engine entity entry environment error event example except
execute export extension external factory failure feature fetch field file filter final first flag folder font footer format forward frame from function
gateway generate global grade graph grid group handle hash header health height history home host hour html http https icon image import index info
initial inner input insert install instance integer interface internal invoice item java join journal json keyboard label language last latest layer
layout leader left length level library license limit line link linux list load local location lock login logo long machine mail main manage manager
mapping market master match material maximum measure media member memory menu merge message meta method metric middle migration minimum mobile mode
model module monitor month mount move multi name native network next node normal note notification number object offset online open operation option
order organization origin other output owner package page panel paper parameter parent parse partial partition patch path pattern payment pending people
percent performance permission person phone picture pipeline place platform player plugin point policy pool popup port position post preview price
primary print priority private process product profile program project property protocol provider proxy public publish purchase python quality quantity
query queue quick quote random range rate reader record recover redirect reference refresh region register release reload remote remove rename render
repair replace reply report repository request reset resource response rest result retry return review right role root route rule runtime sample save
scale schedule schema scope screen script scroll search second section secure security select sender sensor sequence serial server service session setting
shape share shell ship short show sign signal simple single site size slice snapshot social socket sort source space special speed split stack stage
standard start state static station statistic status step stock stop storage store stream string style subject submit subscribe success summary supply
support switch symbol sync system table target task team template temp term test text theme thread threshold thumb ticket time title toggle token tool
topic total track traffic train transaction transfer transform translate tree trigger type union unique unit update upgrade upload usage user util
valid value variable vendor version video view virtual visible visit volume wait wallet warehouse warning watch website week weight widget width window
word work worker world wrapper write year zone""".split()

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_TOKEN)
_WORD = re.compile(r"[A-Za-z0-9+/_=-]{3,}")
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_SIZE = len(ALPHABET) + 1  # the last stands for the start
_CODE = np.full(128, _SIZE - 1, np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


def found(text: str) -> list[Span]:
    """Base spans."""
    out: list[Span] = []
    low = text.lower()
    if any(k in low for k in _KEYS) or not text.isascii() and _ASSIGN.search(text):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return in_order(out, KINDS)


@dataclass
class MarkovModel:
    """log P(character | two before it), each size^2 x (size - 1): models of random strings, models of ordinary tokens."""
    random: list[np.ndarray]
    ordinary: list[np.ndarray]

    def scores(self, tokens: list[str]) -> np.ndarray:
        """Log-likelihood ratio of each token, as random against ordinary."""
        codes = _CODE[np.frombuffer("".join(tokens).encode("ascii"), np.uint8)]
        first = np.cumsum([0, *map(len, tokens)])[:-1]
        at = _contexts(codes, first), codes
        best = [np.max([np.add.reduceat(m[at], first) for m in models], axis=0) for models in (self.random, self.ordinary)]
        return best[0] - best[1]

    def score(self, token: str) -> float:
        """Mean log-likelihood ratio per character."""
        return float(self.scores([token])[0]) / len(token)


def _contexts(codes: np.ndarray, first: np.ndarray | int = 0) -> np.ndarray:
    """Number of the two characters before each one; ``first``: where tokens begin."""
    before = np.concatenate([[_SIZE - 1], codes[:-1]])
    before[first] = _SIZE - 1
    second = np.concatenate([[_SIZE - 1], before[:-1]])
    second[first] = _SIZE - 1
    return second * _SIZE + before


def count_into(table: np.ndarray, token: str) -> None:
    codes = _CODE[np.frombuffer(token.encode("ascii"), np.uint8)]
    np.add.at(table, (_contexts(codes), codes), 1)


def labelled(text: str) -> tuple[list[str], list[str]]:
    """(random strings, ordinary tokens) of a text, by the base patterns."""
    spans = found(text)
    keys = []
    for kind, a, b in spans:
        whole = text[a:b]
        keys += re.findall(r"[A-Za-z0-9+/_=-]{12,}$", whole) if kind == "assign" else [whole]
    plain, upto = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        plain += _WORD.findall(text, upto, max(upto, a))
        upto = max(upto, b)
    plain += _WORD.findall(text, upto)
    return keys, plain


def stand_ins(words: list[str], n: int = 4000, seed: int = 42) -> tuple[list[str], list[str]]:
    """Random keys of common alphabets; identifiers in common styles, made of common words and the given ones."""
    rng = random.Random(seed)
    letters, digits = ALPHABET[:52], ALPHABET[52:62]
    alphabets = (letters + digits, letters + digits + "+/", letters + digits + "_-", digits + "abcdef", letters[26:] + digits, letters[:26] + digits)
    keys = ["".join(rng.choices(alphabets[i % len(alphabets)], k=rng.randint(MIN_TOKEN, 64))) for i in range(n)]
    names = []
    for i in range(n):
        parts = [rng.choice(IDENTIFIER_WORDS if i % 4 or not words else words) for _ in range(rng.randint(2, 6))]
        style = i % 7
        if style == 0:
            names.append("_".join(parts))
        elif style == 1:
            names.append(parts[0] + "".join(p.capitalize() for p in parts[1:]))
        elif style == 2:
            names.append("-".join(parts) + str(rng.randint(0, 2030)))
        elif style == 3:
            names.append("/" + "/".join(parts))
        elif style == 4:
            names.append("".join(parts).upper() + "_" + str(rng.randint(0, 99)))
        elif style == 5:  # rulers and fillers
            names.append(rng.choice("-=_+/0xXaA") * rng.randint(4, 40))
        else:  # dates and numbers
            names.append(rng.choice(["%04d-%02d-%02d", "%04d/%02d/%02d", "%04d%02d%02d"]) % (rng.randint(1900, 2100), rng.randint(1, 12), rng.randint(1, 31)) + rng.choice(["", "T%06d" % rng.randint(0, 235959), "-0000-0000"]))
    return keys, names


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, seed: int = 42) -> MarkovModel:
    """Fit both models on about ``sample_docs`` documents; tasks send counts, the driver gets two tables of fixed size."""
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    n = texts.count()
    share = min(1.0, sample_docs / n) if n else 0.0
    unit = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = texts.where(unit < F.lit(share)).select("text")

    def count(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        tables = np.zeros((2, _SIZE * _SIZE, _SIZE), np.int64)
        words: set[str] = set()
        for batch in batches:
            for text in batch["text"]:
                keys, plain = labelled(text)
                for k in keys:
                    count_into(tables[0], k)
                for p in plain:
                    count_into(tables[1], p)
                words.update(w for w in plain if w.isalpha() and len(w) < 16)
                if len(words) > 40 * STAND_IN_WORDS:
                    words = set(sorted(words, key=digest)[:STAND_IN_WORDS])
        some = sorted(words, key=digest)[:STAND_IN_WORDS]  # a sample by hash, so that few rows carry it
        flat = tables.reshape(-1)
        there = np.flatnonzero(flat)
        yield {"cell": there, "n": flat[there], "word": [None] * len(there)}
        yield {"cell": [-1] * len(some), "n": [1] * len(some), "word": some}

    counted = map_rows(sample, "cell int, n long, word string", count).groupBy("cell", "word").agg(F.sum("n").alias("n"))
    rows = counted.toArrow()
    cells, sums, names = rows.column("cell").to_numpy(), rows.column("n").to_numpy(), rows.column("word").to_pylist()
    tables = np.zeros(2 * _SIZE * _SIZE * _SIZE)
    tables[cells[cells >= 0]] += sums[cells >= 0]
    corpus = tables.reshape(2, _SIZE * _SIZE, _SIZE)
    made = np.zeros_like(corpus)
    for table, tokens in zip(made, stand_ins(sorted((w for w in names if w is not None), key=digest)[:STAND_IN_WORDS])):
        for token in tokens:
            count_into(table, token)
    # keys don't depend on their own past: strong backing off; words do
    return MarkovModel([_log(t, 200.0) for t in (corpus[0], made[0]) if t.any()], [_log(t, 2.0) for t in (corpus[1], made[1]) if t.any()])


def _log(counts: np.ndarray, strength: float) -> np.ndarray:
    """Second order, backed off to first order, backed off to equal shares."""
    counts = counts[:, :_SIZE - 1]
    first = counts.reshape(_SIZE, _SIZE, -1).sum(0)
    even = 1.0 / (_SIZE - 1)
    first = (first + strength * even * (_SIZE - 1)) / (first.sum(1, keepdims=True) + strength * (_SIZE - 1))
    prior = np.tile(first, (_SIZE, 1))
    return np.log((counts + strength * prior) / (counts.sum(1, keepdims=True) + strength))


def scan(text: str, model: MarkovModel, min_evidence: float = MIN_EVIDENCE, min_ratio: float = MIN_RATIO) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans): tokens that the models call random are added where no base span overlaps."""
    base = found(text)
    spans = [m.span() for m in _TOKEN.finditer(text)]
    if not spans:
        return base, base
    scores = model.scores([text[a:b] for a, b in spans])
    size = np.array([b - a for a, b in spans])
    extra = []
    for i in np.flatnonzero(scores >= np.maximum(min_evidence, min_ratio * size)).tolist():
        a, b = spans[i]
        if not any(x < b and a < y for _, x, y in base):
            extra.append(("random", a, b))
    return base, in_order(base + extra, KINDS)


def secrets(docs: DataFrame, model: MarkovModel | None = None, min_evidence: float = MIN_EVIDENCE, min_ratio: float = MIN_RATIO) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex (base), base_sha256, spans (all), n_random — one row per document."""
    model = train(docs) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            out: dict[str, list] = {"doc_id": batch["doc_id"], **{f"n_{k}": [] for k in BASE_KINDS}, "base_sha256": [], "spans": [], "n_random": []}
            for text in batch["text"]:
                base, all_spans = scan(text or "", shared.value, min_evidence, min_ratio)
                for kind in BASE_KINDS:
                    out[f"n_{kind}"].append(sum(k == kind for k, _, _ in base))
                out["base_sha256"].append(digest(joined(base)))
                out["spans"].append(joined(all_spans))
                out["n_random"].append(len(all_spans) - len(base))
            yield out

    counts = ", ".join(f"n_{k} long" for k in BASE_KINDS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_rows(rows, f"doc_id long, {counts}, base_sha256 string, spans string, n_random long", work)
