"""SQL functions that other engines have and Spark names differently, as temporary SQL functions: they stay in whole-stage plans."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "epoch_ms": ("t TIMESTAMP", "BIGINT", "unix_millis(t)"),
    "list_contains": ("a ARRAY<STRING>, x STRING", "BOOLEAN", "array_contains(a, x)"),
    "string_split": ("s STRING, sep STRING", "ARRAY<STRING>", "split(s, concat('\\\\Q', sep, '\\\\E'))"),
    "starts_with": ("s STRING, p STRING", "BOOLEAN", "startswith(s, p)"),
    "ends_with": ("s STRING, p STRING", "BOOLEAN", "endswith(s, p)"),
    "entropy_part": ("n BIGINT, total BIGINT", "DOUBLE", "-(n / total) * log2(n / total)"),
}


def register(spark: SparkSession) -> None:
    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
