"""The corpus pipeline: five stages over `documents`, each written as Parquet and read back as the next one's input.

Every stage works on all rows the one before has kept.  All but the last return the columns of documents:
  language-id     rows whose language can't be told, or only with a score under 0.5, go
  line-dedup      lines that copy an earlier line, exactly or but for one edit, are taken out of the texts
  simhash-dedup   of each component of near duplicates (five-word shingles, Jaccard similarity 0.8 or more) one document stays
  mixing          rows are dropped or repeated so that clean, junk and toxic tokens reach their target shares
  sentencepiece   the best segmentation of each text with its n best scores, and whether all of them decode to the text
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from snaplake.llm.common import fresh_path, table
from snaplake.llm.language_id import language_filter
from snaplake.llm.line_dedup import line_dedup as drop_lines
from snaplake.llm.mixing import domains_of_labels, mixed
from snaplake.llm.near_copies import near_copy_dedup
from snaplake.llm.sentencepiece_nbest import digest, encode


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copy_dedup(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs, domains_of_labels(table(spark, sf_dir, "labels")))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return digest(encode(docs))


STAGES = [
    ("language-id", language_id),
    ("line-dedup", line_dedup),
    ("simhash-dedup", near_duplicates),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]

#: SQL can't express the learned models and the segmentations; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
