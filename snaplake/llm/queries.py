"""The registered query of each corpus operator, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .crf_quality import quality
from .language_id import language_id
from . import sentencepiece_nbest
from .line_dedup import line_report
from .media import media_columns
from .mixing import domains_of_labels, mixing
from .quality_rules import quality_rules
from .simhash import simhash
from .toxicity import toxicity
from .warc import warc_round_trip


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_nbest.digest(sentencepiece_nbest.encode(table(spark, sf_dir, "documents")))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing(table(spark, sf_dir, "documents"), domains_of_labels(table(spark, sf_dir, "labels")))


def op10_media_wav(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))


#: Base32 is spelled out: five bits of the digest for each letter.
WARC_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
b AS (SELECT page_id, octet_length(encode(h)) AS n, CAST(unhex(sha1(h)) AS BIT)::VARCHAR AS bits, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda k: CASE WHEN substr(bits, CAST(i * 5 + k + 1 AS INTEGER), 1) = '1' THEN CAST(pow(2, 4 - k) AS INTEGER) ELSE 0 END))::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_toxicity": op2_toxicity,
        "op3_quality": op3_quality,
        "op4_language_id": op4_language_id,
        "op5_simhash": op5_simhash,
        "op6_sentencepiece": op6_sentencepiece,
        "op7_warc": op7_warc,
        "op8_quality_rules": op8_quality_rules,
        "op9_mixing": op9_mixing,
        "op10_media_wav": op10_media_wav,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_warc": WARC_SQL}
