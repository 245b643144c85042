"""Column expressions shared by the operators. Everything here stays inside the JVM."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def days_between(start: Column, end: Column) -> Column:
    """Fractional days from start to end."""
    return micros_between(start, end).cast("double") / F.lit(86400.0 * 1e6)


def whole_days_between(start: Column, end: Column) -> Column:
    """Whole periods of 24 hours, rounded down (not a difference of calendar dates)."""
    return F.floor(micros_between(start, end) / F.lit(86400.0 * 1e6)).cast("long")


def safe_ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, null where bottom is zero or null."""
    return F.try_divide(top, bottom)


def hash_unit(key: Column, seed: int | str) -> Column:
    """Uniform number in [0, 1) from a key: same row, same seed, same number, in any partitioning."""
    digest = F.md5(F.concat_ws("#", key.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def category_of(text: Column, words: dict[str, list[str]]) -> Column:
    """First category whose key words occur in the text as whole words, with an optional plural S."""
    upper = F.upper(text)
    chosen = None
    for category, keys in words.items():
        pattern = r"(?U)\b(?:" + "|".join(_quote(k.upper()) for k in keys) + r")S?\b"
        hit = upper.rlike(pattern)
        chosen = F.when(hit, category) if chosen is None else chosen.when(hit, category)
    return F.lit("other") if chosen is None else chosen.otherwise("other")


def _quote(word: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else "\\" + c for c in word)


def tidy_text(text: Column) -> Column:
    """Upper case, runs of white space to one blank, trimmed."""
    return F.trim(F.regexp_replace(F.upper(text), r"(?U)\s+", " "))


def share_in_order(prob: Column, labels: list[str], n: int) -> Column:
    """Labels of the n largest entries of an array of probabilities, largest first, later label on ties."""
    pairs = F.transform(prob, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    ordered = F.reverse(F.array_sort(pairs))
    names = F.array(*[F.lit(x) for x in labels])
    return F.transform(F.slice(ordered, 1, n), lambda s: F.element_at(names, s["i"] + 1))
