"""Reading a snapshot: files in groups of equal schemas, united by name and widened; deletions and system columns taken out."""

from __future__ import annotations

import json
from collections import defaultdict
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import align, union_schema
from .catalog import ROW_FILE, ROW_ID, SYSTEM, Resource, Snapshot

#: Deletion vectors of up to so many rows (16 bytes each) are broadcast; larger ones are joined by shuffle.
BROADCAST_DELETIONS = 500_000
DELETIONS = T.StructType([T.StructField(ROW_FILE, T.StringType()), T.StructField(ROW_ID, T.LongType())])


def read_files(spark: SparkSession, resources: list[Resource], with_file: bool = False) -> DataFrame | None:
    """Rows of the files under their union schema; None without files.  Folder names never become columns, as files are named one by one."""
    groups: dict[str, list[str]] = defaultdict(list)
    for r in resources:
        groups[r.schema].append(r.file)
    if not groups:
        return None
    schema = union_schema(T.StructType.fromJson(json.loads(s)) for s in groups)
    parts = []
    for own, files in groups.items():
        part = spark.read.schema(T.StructType.fromJson(json.loads(own))).parquet(*files)
        part = part.withColumn(ROW_FILE, F.col("_metadata.file_path")) if with_file else part
        extra = [T.StructField(ROW_FILE, T.StringType())] if with_file else []
        parts.append(align(part, T.StructType([*schema.fields, *extra])))
    return reduce(DataFrame.unionByName, parts)


def file_key(path: Column) -> Column:
    """The last two parts of a file's path, which are the same in every spelling of it."""
    return F.concat_ws("/", F.element_at(F.split(path, "/"), -2), F.element_at(F.split(path, "/"), -1))


def path_key(path: str) -> str:
    return "/".join(unquote(path).split("/")[-2:])


def deletions(spark: SparkSession, snapshot: Snapshot) -> DataFrame | None:
    return spark.read.schema(DELETIONS).parquet(*snapshot.deletions) if snapshot.deletions else None


def without_deleted(rows: DataFrame, dead: DataFrame | None, n: int) -> DataFrame:
    if dead is None:
        return rows
    ids = dead.select(ROW_ID)
    return rows.join(F.broadcast(ids) if n <= BROADCAST_DELETIONS else ids, ROW_ID, "left_anti")


def live(spark: SparkSession, snapshot: Snapshot, resources: list[Resource] | None = None, system: bool = False, schema_mode: str = "last") -> DataFrame:
    """The rows a reader sees.  schema_mode: "last" shows the columns of the last write, "union" those of all files."""
    use = snapshot.resources if resources is None else resources
    shown = snapshot.struct
    if schema_mode == "union" and snapshot.resources:
        files = union_schema(T.StructType.fromJson(json.loads(r.schema)) for r in snapshot.resources)
        shown = T.StructType([f for f in files.fields if f.name not in SYSTEM])
    else:
        shown = T.StructType([f for f in shown.fields if f.name not in SYSTEM])
    rows = read_files(spark, use)
    if rows is None:
        extra = [T.StructField(c, T.LongType() if c == ROW_ID else T.TimestampType()) for c in SYSTEM] if system else []
        return spark.createDataFrame([], T.StructType([*shown.fields, *extra]))
    wide = {f.name.lower(): f.dataType for f in rows.schema.fields}
    # a column's type is that of all files, so that nothing is cast away on reading
    target = T.StructType([T.StructField(f.name, wide.get(f.name.lower(), f.dataType), True) for f in shown.fields])
    kept = without_deleted(rows, deletions(spark, snapshot), snapshot.deletion_rows) if ROW_ID in rows.columns else rows
    keep = [T.StructField(c, wide[c]) for c in SYSTEM if c in wide] if system else []
    return align(kept, T.StructType([*target.fields, *keep]))
