"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Every source gets its weight's share of the whole amount of words; a source is clamped at ``max_epochs``
times its own size and what it can't take is dealt to the others by weight, until no target is above its
cap. A source whose target is e times its size gives every document floor(e) times, and a seeded part of
its documents once more: documents in the order of a hash, up to the missing words.

That order needs no sort of a source: hash buckets are summed, a running sum over at most BUCKETS rows per
source finds the bucket in which the missing words end, and only that bucket is put in order.

Defined results: null text has size 0; a null source is a source of its own, the last; sources without
words get target 0; rows that repeat a doc_id share a draw, rows without one draw by their text; an empty table gives no rows;
further columns stay as they are.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronage.session import materialise

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BUCKETS = 4096
SEED = "mix"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw_of(doc_id: Column, text: Column, seed: str) -> Column:
    """Whole number below 2^52 from the id and the seed; rows without id draw by their text."""
    named = F.when(doc_id.isNotNull(), doc_id.cast("string")).otherwise(F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")))))
    mark = F.md5(F.concat(F.lit(seed + ":"), named))
    return F.conv(F.substring(mark, 1, 13), 16, 10).cast("long")


def _numbered(sources: DataFrame) -> DataFrame:
    """Adds ``place``: position by code point from 0, null last. No task holds more than its range of sources."""
    ordered = materialise(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()), "mix-order")
    part = F.shiftright("_at", 33)
    starts = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("_part", before.alias("_before"))
    return ordered.join(starts, part == F.col("_part")).select(
        "source", "source_size", (F.col("_before") + F.col("_at") - F.shiftleft(F.col("_part"), 33)).alias("place"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from rows of (source, size)."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("place") % len(weights)).cast("int") + 1)
    table = materialise(_numbered(sources).select(
        "source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * max_epochs).alias("cap")), "mix-sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, clamped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > F.col("cap") if clamped >= 0 else F.lit(False)
        n, held, free = table.agg(F.count_if(over), F.sum(F.when(over, F.col("cap"))),
                                  F.sum(F.when(~over, F.col("weight")))).first()
        if n == clamped:
            break
        clamped = n
        if not free:
            break
        level = float(total - (held or 0)) / float(free)
    wanted = F.col("weight") * F.lit(level)
    return table.select("source", "source_size", F.when(wanted > F.col("cap"), F.col("cap").cast("double")).otherwise(wanted).alias("target"))


def mixing_plan(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source: source_size, target, whole repetitions, missing words, and the bucket in which they end.

    ``sizes``: written rows of (doc_id, source, size, draw).
    """
    targets = source_targets(sizes, weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = materialise(targets.withColumn("whole", whole).withColumn(
        "missing", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    sums = sizes.groupBy("source", bucket_of(F.col("draw")).alias("bucket")).agg(F.sum("size").alias("words"))
    running = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
    ends = (sums.withColumn("upto", running)
            .join(targets.select(F.col("source").alias("_s"), "missing"), F.col("source").eqNullSafe(F.col("_s")))
            .where(F.col("upto") > F.col("missing"))
            .groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("end"))
            .select(F.col("source").alias("_e"), "end"))
    return materialise(targets.join(ends, F.col("source").eqNullSafe(F.col("_e")), "left").select(
        "source", "source_size", "target", "whole", "missing",
        F.coalesce("end.bucket", F.lit(BUCKETS)).alias("end_bucket"), F.coalesce("end.before", F.lit(0)).alias("before")), "mix-plan")


def bucket_of(draw: Column) -> Column:
    return F.shiftright(draw, 40).cast("int")


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       words_in(F.col("text")).alias("size"), draw_of(F.col("doc_id"), F.col("text"), seed).alias("draw"))


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies — one row per document."""
    sizes = materialise(sized(docs, seed), "mix-sizes")
    plan = mixing_plan(sizes, weights, max_epochs)
    rows = _planned(sizes, plan)
    return rows.select("doc_id", "size", "source_size", "target", ((F.col("whole") + F.col("extra")) * F.col("size")).alias("taken"),
                       (F.col("whole") + F.col("extra")).alias("copies"))


def _planned(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    p = plan.withColumnRenamed("source", "_p")
    rows = sizes.join(p, F.col("source").eqNullSafe(F.col("_p"))).withColumn("bucket", bucket_of(F.col("draw")))
    clear = rows.where(F.col("bucket") != F.col("end_bucket")).withColumn("extra", (F.col("bucket") < F.col("end_bucket")).cast("long"))
    order = Window.partitionBy("source").orderBy("draw", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)
    last = rows.where(F.col("bucket") == F.col("end_bucket")).withColumn("_upto", F.col("before") + F.sum("size").over(order))
    last = last.withColumn("extra", (2 * F.col("_upto") - F.col("size") <= 2 * F.col("missing")).cast("long"))
    return clear.unionByName(last.select(*clear.columns))


def mix_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: every document as often as the plan takes it, all columns as given.

    Texts aren't shuffled: the plan has a row per source, and only documents of the bucket in which a
    source's missing words end are looked up by their draw.
    """
    sizes = materialise(sized(docs, seed), "mix-sizes")
    plan = mixing_plan(sizes, weights, max_epochs)
    ends = _planned(sizes, plan).where(F.col("bucket") == F.col("end_bucket"))
    ends = materialise(ends.groupBy(F.col("draw").alias("_mix_draw"), F.col("source").alias("_mix_s")).agg(F.max("extra").alias("_mix_more")), "mix-ends")
    p = plan.select(F.col("source").alias("_mix_source"), F.col("whole").alias("_mix_whole"), F.col("end_bucket").alias("_mix_end"))
    draw = draw_of(F.col("doc_id").cast("long"), F.col("text"), seed)
    bucket = bucket_of(draw)
    out = docs.join(p, F.col("source").cast("string").eqNullSafe(F.col("_mix_source")))
    out = out.join(ends, (draw == F.col("_mix_draw")) & F.col("_mix_source").eqNullSafe(F.col("_mix_s")), "left")
    extra = F.when(bucket == F.col("_mix_end"), F.coalesce("_mix_more", F.lit(0))).otherwise((bucket < F.col("_mix_end")).cast("long"))
    copies = F.col("_mix_whole") + extra
    return out.where(copies > 0).withColumn("_mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(*docs.columns)
