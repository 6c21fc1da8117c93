"""A lake that holds the given tables, loaded when a query first needs them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from ..lake import Lake

_LAKES: dict[tuple[str, str], Lake] = {}


def folder(spark: SparkSession) -> str:
    """A folder of its own in the one that the cluster shares; a temporary one where none is set (local runs)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return f"{shared.rstrip('/')}/lake-{uuid.uuid4().hex[:12]}" if shared else "file://" + tempfile.mkdtemp(prefix="snaplake-lake-")


def new_lake(spark: SparkSession) -> Lake:
    return Lake(spark, folder(spark))


def lake_of(spark: SparkSession, sf_dir: str, *tables: str) -> Lake:
    """The lake of one data folder, with the named tables in it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LAKES:
        _LAKES[key] = new_lake(spark)
    lake = _LAKES[key]
    for t in tables:
        table = lake.table(t)
        if not table.folder.exists():
            table.append(spark.read.parquet(f"{sf_dir}/{t}.parquet"))
    return lake
