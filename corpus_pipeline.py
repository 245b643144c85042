"""Corpus pipeline: each stage takes the documents its predecessor kept and returns documents; the last packs token ids.

run() writes every stage's result as Parquet in the shared folder and reads it back as the next one's input, so
lost executors cost at most the tasks of one stage.

Defined results: documents with null or letterless text are rejected by the first stage; rows that repeat a
doc_id and its text are one document, rows without doc_id and other texts under a doc_id are documents of their own
for the near-duplicate stage; further columns of documents travel along until packing; an empty table passes through
every stage and packs to no rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from patronage.llm import decontaminate, language, mixing, packing, simhash
from patronage.session import Scratch, release


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language can't be told; trained on the documents' own labels."""
    return language.keep_identified(docs, language.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_first(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and sample documents so that sources come near their target weights."""
    return mixing.mix_documents(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in fixed-length sequences."""
    return packing.packed(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_benchmark_leaks),
    ("mix", mix_sources),
    ("pack", pack_tokens),
]

#: Hashes and models of the stages have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with Scratch() as scratch:  # the tables that a stage makes go when its result is written
            docs = scratch.keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
