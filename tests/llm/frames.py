"""Small awkward tables for the training-data operators."""
from __future__ import annotations

import random

WORDS = "the of and thereon inland eastern herald tion answer river stone cloud paper orange velvet garden winter summer bridge letter".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, target string, kept boolean, digest string, print long, mark long, html string"


def prose(rng: random.Random, words: int) -> str:
    return " ".join(rng.choice(WORDS) + (rng.choice(["", "", "", ",", "."])) for _ in range(words))


def awkward(seed: int = 5) -> list[tuple]:
    """(doc_id, text, lang, source, ...): nulls everywhere, empty and long texts, repeats, ties, clashing columns."""
    rng = random.Random(seed)
    long_text = prose(rng, 6000)
    shared = prose(rng, 60)
    texts = [None, "", " \t\n", "a", "one two", "1234 !!", long_text, long_text + " x", shared, shared, shared.replace(" ", "  "), "ééé äöü ñ", "\U0001f600 \U0001d7d8 text",
             prose(rng, 30) + " " + shared + " " + prose(rng, 30), "a" * 3000, "ab" * 1500, shared.upper()]
    texts += [prose(rng, rng.randint(1, 80)) for _ in range(20)]
    rows = []
    for i, t in enumerate(texts):
        rows.append((i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s2", "", None]), None if t is None else len(t), 0.5, 7, "x", True, "d", 3, 4, "<p>"))
    rows += [rows[8], rows[8], rows[0]]  # the same row again
    rows.append((None, shared, None, None, None, None, None, None, None, None, None, None, None))
    rows.append((None, None, None, None, None, None, None, None, None, None, None, None, None))
    return rows


def documents(spark, rows: list[tuple] | None = None):
    return spark.createDataFrame(awkward() if rows is None else rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
