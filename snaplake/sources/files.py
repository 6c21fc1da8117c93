"""Loading of plain files by their kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV (with a header), JSON lines, JSON documents, Parquet or ORC, by the path's ending."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind == "csv":
        return reader.option("header", True).csv(path)
    if kind == "jsonl":
        return reader.json(path)
    if kind == "json":
        return reader.option("multiLine", True).json(path)
    if kind == "parquet":
        return reader.parquet(path)
    if kind == "orc":
        return reader.orc(path)
    raise ValueError(f"files ending in .{kind} can't be loaded")


def store_path(path: str) -> str:
    """Addresses of object stores as Spark names them."""
    for scheme in ("s3://", "s3n://"):
        if path.startswith(scheme):
            return "s3a://" + path.removeprefix(scheme)
    return path


_UNITS = {"s": F.timestamp_seconds, "ms": F.timestamp_millis, "us": F.timestamp_micros}


def times_from_numbers(df: DataFrame, units: dict[str, str]) -> DataFrame:
    """Columns that foreign files hold as whole numbers of s, ms, us or ns since 1970, as timestamps."""
    for name, unit in units.items():
        c = F.col(f"`{name}`")
        if unit != "ns" and unit not in _UNITS:
            raise ValueError(f"unit {unit!r} isn't known")
        df = df.withColumn(name, F.timestamp_micros(F.floor(c / 1000).cast("long")) if unit == "ns" else _UNITS[unit](c))
    return df
