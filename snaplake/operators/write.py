"""The write path: append, upsert and delete by key, suppression of stale rows; merge on read through a deletion vector."""

from __future__ import annotations

import contextlib
import datetime
import json
import threading
from collections.abc import Iterator
from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import pruning
from ..plans.stats import footers
from ..sources.catalog import MANIFESTS, ROW_FILE, ROW_ID, ROW_TIME, SYSTEM, Resource, Snapshot, TableFolder
from ..sources.scan import DELETIONS, deletions, file_key, path_key, read_files

#: Rows of a row group are limited by bytes in Spark; files are cut at this many rows.
FILE_ROWS = 4_000_000


def same_key(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null keys match null keys."""
    found = F.lit(True)
    for k in keys:
        found = found & left[k].eqNullSafe(right[k])
    return found


def with_row_ids(df: DataFrame, start: int) -> tuple[DataFrame, int]:
    """(df with contiguous row ids from start on, number of rows); df must be persisted, as it is counted first.

    Rows are numbered within their partitions; what reaches the driver is one count per partition.
    """
    counts = {r["p"]: r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
    offsets, at = [], start
    for p in sorted(counts):
        offsets.append((p, at))
        at += counts[p]
    table = df.sparkSession.createDataFrame(offsets, "_p int, _start long")
    # the low 33 bits of the built-in id count rows within a partition
    numbered = df.withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    return numbered.join(F.broadcast(table), "_p").withColumn(ROW_ID, F.col("_start") + F.col("_k")).drop("_p", "_k", "_start"), at - start


_SETTING, _writers = threading.Lock(), {"n": 0, "before": ""}


@contextlib.contextmanager
def _bounded_timestamps(spark: SparkSession) -> Iterator[None]:
    """Timestamps are written as microseconds, as the older kind has no bounds in footers; the setting stays until the last of several writers is done."""
    kind = "spark.sql.parquet.outputTimestampType"
    with _SETTING:
        if not _writers["n"]:
            _writers["before"] = spark.conf.get(kind)
        _writers["n"] += 1
        spark.conf.set(kind, "TIMESTAMP_MICROS")
    try:
        yield
    finally:
        with _SETTING:
            _writers["n"] -= 1
            if not _writers["n"]:
                spark.conf.set(kind, _writers["before"])


def write_files(df: DataFrame, folder: TableFolder, sort: list[str]) -> list[Resource]:
    """Writes rows as data files, sorted within each so that row groups have narrow ranges; returns what was written."""
    path = folder.fresh("data")
    keys = [c for c in [ROW_TIME, *sort] if c in df.columns]
    out = df.sortWithinPartitions(*keys) if keys else df
    with _bounded_timestamps(df.sparkSession):
        out.write.option("compression", "zstd").option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    files = [(p, n) for p, n, d in folder.store.list(path) if not d and p.endswith(".parquet")]
    schema = json.dumps(json.loads(df.schema.json()))
    rows = footers(df.sparkSession, [p for p, _ in files])
    return [Resource(p, n, rows[p], len(df.columns), schema) for p, n in files if rows[p]]


def _pairs(rows: DataFrame) -> DataFrame:
    """(file, row id); Spark gives file paths in URI form."""
    return rows.select(ROW_FILE, ROW_ID).where(F.col(ROW_ID).isNotNull())


def validate(folder: TableFolder, df: DataFrame, keys: list[str], newer_than: str | None, delete_only: bool) -> None:
    if folder.read_only:
        raise PermissionError(f"{folder.name} belongs to a read-only clone")
    if not isinstance(keys, list):
        raise ValueError("keys must be a list of column names")
    have = {c.lower() for c in df.columns}
    if gone := [k for k in [*keys, *([newer_than] if newer_than else [])] if k.lower() not in have]:
        raise ValueError(f"Missing required column(s): {folder.name}: {', '.join(gone)}")
    if newer_than and not keys:
        raise ValueError("newer_than needs keys")
    low = [c.lower() for c in df.columns]
    if len(set(low)) != len(low):
        raise ValueError("column names must differ in more than case")
    if delete_only and newer_than:
        raise ValueError("a delete takes no newer_than")


def keep_newer(incoming: DataFrame, existing: DataFrame | None, keys: list[str], column: str) -> DataFrame:
    """Incoming rows whose value is over the greatest one of their key in all physical rows, deleted ones too; ties are stale."""
    if existing is None:
        return incoming
    most = existing.groupBy(*keys).agg(F.max(column).alias("_most"))
    joined = incoming.alias("i").join(most.alias("m"), same_key(incoming, most, keys), "left")
    return joined.where(F.col("_most").isNull() | (F.col(f"i.{column}") > F.col("_most"))).select("i.*")


def write(folder: TableFolder, df: DataFrame, keys: list[str] | None = None, newer_than: str | None = None, delete_only: bool = False, lineage: dict | None = None, auto_compact: bool = True) -> tuple[int, int, int, int]:
    """(columns, rows, inserted, deleted).  keys: existing live rows with an incoming key are deleted; without keys rows are appended.

    delete_only: nothing is added, and without keys every row is deleted.  Duplicate keys within df all stay.
    """
    keys = keys or []
    spark = df.sparkSession
    df = df.drop(*SYSTEM)
    validate(folder, df, keys, newer_than, delete_only)
    before = folder.snapshot() if folder.exists() else Snapshot(-1, "{}")
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    kept = [df]
    try:
        candidates = pruning.files_for_keys(spark, before, df, keys) if keys and before.resources else before.resources
        existing = read_files(spark, candidates, with_file=True) if candidates and (keys or delete_only) else None
        if keys and existing is not None and not all(k.lower() in {c.lower() for c in existing.columns} for k in keys):
            existing = None  # no file has the keys
        incoming = df
        if newer_than:
            has = existing is not None and newer_than.lower() in {c.lower() for c in existing.columns}
            incoming = keep_newer(df, existing if has else None, keys, newer_than)
            incoming = incoming.persist(StorageLevel.MEMORY_AND_DISK)
            kept.append(incoming)
        stamped, n_rows = (None, 0) if delete_only else with_row_ids(incoming, before.next_row_id)
        if newer_than and not n_rows:
            return len(df.columns), 0, 0, 0
        dead, n_dead, n_deleted, fresh = before.deletions, before.deletion_rows, 0, None
        if existing is not None and (keys or delete_only) and ROW_ID in existing.columns:
            if keys:
                wanted = incoming.select(*keys).distinct()
                hit = _pairs(existing.join(wanted, same_key(existing, wanted, keys), "left_semi"))
            else:
                hit = _pairs(existing)
            # a vector of its own for what this write deletes; older ones stay as they are
            old = deletions(spark, before)
            new = hit if old is None else hit.join(old.select(ROW_ID), ROW_ID, "left_anti").select(ROW_FILE, ROW_ID)
            fresh = folder.fresh("deletions")
            new.write.option("compression", "zstd").parquet(fresh)
            n_deleted = sum(footers(spark, [p for p, _, d in folder.store.list(fresh) if not d and p.endswith(".parquet")]).values())
            if n_deleted:
                dead, n_dead = [*dead, fresh], n_dead + n_deleted
        resources, schema, added, next_id = list(before.resources), before.schema, [], before.next_row_id + n_rows
        if not delete_only:
            now = datetime.datetime.now(datetime.timezone.utc)
            added = write_files(stamped.withColumn(ROW_TIME, F.lit(now)), folder, keys)
            schema = json.dumps(json.loads(df.schema.json()))
        elif before.version < 0:
            schema = json.dumps(json.loads(df.schema.json()))
        after = replace(before, version=before.version + 1, previous=before.version if before.version >= 0 else None, schema=schema, resources=resources + added, deletions=dead, deletion_rows=n_dead, next_row_id=next_id)
        if lineage and "batch" in lineage:
            after.batches = {**before.batches, f"{lineage['operation']}:{lineage['pipe']}": lineage["batch"]}
        after.lineage = lineage or {"operation": "delete" if delete_only else "upsert" if keys else "append", "keys": keys, "newer_than": newer_than}
        if n_deleted:
            after = merged_deletions(spark, folder, reclaim(spark, folder, after, fresh, n_deleted))
        if auto_compact:
            from .compact import compacted

            after = compacted(spark, folder, after, force=False)
        after.stats = pruning.updated_stats(spark, folder, before, after)
        folder.commit(after)
        return len(df.columns), n_rows, n_rows, n_deleted
    finally:
        for x in kept:
            x.unpersist()


def merged_deletions(spark: SparkSession, folder: TableFolder, snapshot: Snapshot) -> Snapshot:
    if len(snapshot.deletions) <= MANIFESTS:
        return snapshot
    at = folder.fresh("deletions")
    deletions(spark, snapshot).coalesce(max(1, snapshot.deletion_rows // FILE_ROWS)).write.option("compression", "zstd").parquet(at)
    return replace(snapshot, deletions=[at])


def reclaim(spark: SparkSession, folder: TableFolder, snapshot: Snapshot, fresh: str, n_fresh: int) -> Snapshot:
    """Drops files of which every row is deleted, with their part of the deletion vectors.  Only files that the vector `fresh` touches can be such."""
    key = file_key(F.col(ROW_FILE)).alias("k")
    now = {r["k"]: r["n"] for r in spark.read.schema(DELETIONS).parquet(fresh).groupBy(key).agg(F.count("*").alias("n")).collect()}
    before = snapshot.deletion_rows - n_fresh
    may = {path_key(r.file): r.rows for r in snapshot.resources if now.get(path_key(r.file), 0) and now[path_key(r.file)] + before >= r.rows}
    if not may:
        return snapshot
    dead = deletions(spark, snapshot).withColumn("k", key)
    counts = now
    if before:
        names = spark.createDataFrame([(k,) for k in sorted(may)], "k string")
        counts = {r["k"]: r["n"] for r in dead.join(names, "k", "left_semi").groupBy("k").agg(F.count("*").alias("n")).collect()}
    gone = {k: counts[k] for k, rows in may.items() if counts.get(k, 0) >= rows}
    if not gone:
        return snapshot
    kept = [r for r in snapshot.resources if path_key(r.file) not in gone]
    left, at = snapshot.deletion_rows - sum(gone.values()), []
    if left:
        at = [folder.fresh("deletions")]
        names = spark.createDataFrame([(g,) for g in sorted(gone)], "k string")
        dead.join(names, "k", "left_anti").select(ROW_FILE, ROW_ID).write.option("compression", "zstd").parquet(at[0])
    return replace(snapshot, resources=kept, deletions=at, deletion_rows=left)
