"""Registered queries of the training-data operators and their SQL."""
from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from patronage.llm import decontaminate, exact_dedup, html_text, language, manifest, mixing, packing, pii, search, secrets, simhash, substring_dedup, toxicity
from patronage.session import Scratch


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tidy(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with its result written and all its intermediate tables deleted; for results that are small against them."""
    @functools.wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        with Scratch() as scratch:
            return scratch.keep(query(spark, folder), query.__name__)
    return run


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language.predict(docs.select("doc_id", "text"), language.train(docs.select("doc_id", "text", "lang")))


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.without_repeats(table(spark, folder, "documents"))


def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(table(spark, folder, "documents"))


def op5_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(table(spark, folder, "documents"))


OP5_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))), 1, 13))::BIGINT AS draw
  FROM documents),
ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sizes GROUP BY source),
weighed AS (
  SELECT source, source_size, 3 * source_size AS cap, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         sum(source_size) OVER () AS total FROM ranked),
levels AS (
  SELECT *, total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM weighed),
level AS (SELECT arg_min(rest::DOUBLE / free::DOUBLE, cap / weight) AS level FROM levels WHERE cap >= weight * (rest::DOUBLE / free::DOUBLE)),
targets AS (
  SELECT source, source_size, CASE WHEN weight * level > cap THEN cap::DOUBLE ELSE weight * level END AS target FROM weighed, level),
repeated AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
ordered AS (
  SELECT s.doc_id, s.size, r.source_size, r.target, r.whole, r.target - r.whole * r.source_size AS missing,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.draw, s.doc_id NULLS LAST, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sizes s JOIN repeated r ON s.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
       ((whole + CASE WHEN 2 * upto - size <= 2 * missing THEN 1 ELSE 0 END) * size)::BIGINT AS taken,
       (whole + CASE WHEN 2 * upto - size <= 2 * missing THEN 1 ELSE 0 END)::BIGINT AS copies
FROM ordered
"""


def op6_pack_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"))


@tidy
def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"))


OP7_SQL = r"""
WITH rows AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256, sha256(text) AS raw FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST, raw NULLS FIRST) = 1 AS kept, text_sha256
FROM rows WINDOW same AS (PARTITION BY text_sha256)
"""


def op8_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.main_texts(table(spark, folder, "pages"))


@tidy
def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secrets(table(spark, folder, "documents"))


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@tidy
def op12_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.audit(table(spark, folder, "documents"))


def op13_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.predict(docs, toxicity.train(docs, table(spark, folder, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_language_id": op2_language_id,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_pii": op4_pii,
    "op5_source_mix": op5_source_mix,
    "op6_pack_tokens": op6_pack_tokens,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_main_text": op8_main_text,
    "op9_simhash": op9_simhash,
    "op10_secret_scan": op10_secret_scan,
    "op11_lexical_search": op11_lexical_search,
    "op12_manifest": op12_manifest,
    "op13_toxicity": op13_toxicity,
}
ORACLES: dict[str, str] = {"op5_source_mix": OP5_SQL, "op7_exact_dedup": OP7_SQL, "op11_lexical_search": search.ORACLE, "op12_manifest": manifest.ORACLE}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
