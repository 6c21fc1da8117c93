"""Compaction: drains the deletion vector (phase A), then merges small files (phase B).  Sources are never unlinked, so older snapshots stay readable."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.catalog import ROW_FILE, ROW_ID, Resource, Snapshot, TableFolder
from ..sources.scan import DELETIONS, deletions, file_key, live, path_key, read_files, without_deleted

CHUNK_BYTES, MAX_SMALL_FILES, MAX_DELETION_ROWS = 16 << 20, 100, 1_000_000
#: Rows of a file that merging or draining makes: bytes of files say little of the memory that a task needs to sort what compresses well.
CHUNK_ROWS = 1_000_000


def limits(folder: TableFolder) -> tuple[int, int, int]:
    s = folder.settings()
    return s.get("chunk_bytes", CHUNK_BYTES), s.get("max_small_files", MAX_SMALL_FILES), s.get("max_deletion_rows", MAX_DELETION_ROWS)


def gate_opens(sizes: list[int], chunk: int, most: int) -> bool:
    small = [s for s in sizes if s < chunk]
    return len(small) >= most or sum(small) > chunk and len(small) > 1


def _small(resources: list[Resource], chunk: int) -> list[Resource]:
    """Merging fills files to more than half of CHUNK_ROWS, so what it has made by rows isn't small again."""
    return [r for r in resources if r.file_size < chunk and r.rows <= CHUNK_ROWS // 2]


def _chunked(rows: DataFrame, sources: list[Resource], chunk: int) -> DataFrame:
    return rows.repartition(max(1, math.ceil(sum(r.file_size for r in sources) / chunk), math.ceil(sum(r.rows for r in sources) / CHUNK_ROWS)))


def drain(spark: SparkSession, folder: TableFolder, snapshot: Snapshot) -> Snapshot:
    """Rewrites the files that have deleted rows without them; row ids stay."""
    from .write import write_files

    dead = deletions(spark, snapshot)
    if dead is None:
        return snapshot
    hit = {r["k"] for r in dead.select(file_key(F.col(ROW_FILE)).alias("k")).distinct().collect()}
    touched = [r for r in snapshot.resources if path_key(r.file) in hit]
    kept = [r for r in snapshot.resources if path_key(r.file) not in hit]
    made = []
    if touched:
        rows = without_deleted(read_files(spark, touched), dead, snapshot.deletion_rows)
        made = write_files(_chunked(rows, touched, limits(folder)[0]), folder, [])
    return replace(snapshot, resources=kept + made, deletions=[], deletion_rows=0)


def merge(spark: SparkSession, folder: TableFolder, snapshot: Snapshot, small_only: bool = True) -> Snapshot:
    """Merges small files.  Their deleted rows are left out, and their part of the deletion vectors goes with them."""
    from .write import write_files

    chunk = limits(folder)[0]
    small = _small(snapshot.resources, chunk) if small_only else snapshot.resources
    if len(small) < 2:
        return snapshot
    names = {r.file for r in small}
    rest, dead = [r for r in snapshot.resources if r.file not in names], deletions(spark, snapshot)
    rows = without_deleted(read_files(spark, small), dead, snapshot.deletion_rows)
    made = write_files(_chunked(rows, small, chunk), folder, [])
    snapshot = replace(snapshot, resources=rest + made)
    if dead is None:
        return snapshot
    merged = spark.createDataFrame([(path_key(r.file),) for r in small], "k string")
    left, at = dead.withColumn("k", file_key(F.col(ROW_FILE))).join(merged, "k", "left_anti").select(ROW_FILE, ROW_ID), folder.fresh("deletions")
    left.write.option("compression", "zstd").parquet(at)
    n = spark.read.schema(DELETIONS).parquet(at).count()
    return replace(snapshot, deletions=[at] if n else [], deletion_rows=n)


def compacted(spark: SparkSession, folder: TableFolder, snapshot: Snapshot, force: bool, small_only: bool = True, force_deletions: bool = True) -> Snapshot:
    chunk, most, dead_rows = limits(folder)
    if snapshot.deletions and (force and force_deletions or snapshot.deletion_rows >= dead_rows):
        snapshot = drain(spark, folder, snapshot)
    if force or gate_opens([r.file_size for r in _small(snapshot.resources, chunk)], chunk, most):
        snapshot = merge(spark, folder, snapshot, small_only)
    return snapshot


def compact(folder: TableFolder, small_only: bool = True, lineage: dict | None = None, force_deletions: bool = True) -> dict:
    """Explicit maintenance; what it did, as numbers.  Nothing to do commits nothing."""
    from ..plans import pruning

    spark, before = folder.spark, folder.snapshot()
    after = compacted(spark, folder, before, force=True, small_only=small_only, force_deletions=force_deletions)
    if after.resources == before.resources and after.deletions == before.deletions:
        return {"version": before.version, "files_before": len(before.resources), "files_after": len(before.resources), "deleted_rows_dropped": 0}
    after = replace(after, version=before.version + 1, previous=before.version, lineage=lineage or {"operation": "compact"})
    after.stats = pruning.updated_stats(spark, folder, before, after)
    folder.commit(after)
    return {"version": after.version, "files_before": len(before.resources), "files_after": len(after.resources), "deleted_rows_dropped": before.deletion_rows - after.deletion_rows}


def export(folder: TableFolder, target: str, files: int | None = None, level: int | None = None) -> dict:
    """Writes the live rows to a folder of plain Parquet, compressed at the given Zstandard level; the table doesn't change."""
    snapshot = folder.snapshot()
    rows = live(folder.spark, snapshot)
    writer = (rows.repartition(files) if files else rows).write.mode("errorifexists").option("compression", "zstd")
    (writer.option("parquet.compression.codec.zstd.level", level) if level else writer).parquet(target)
    made = [(p, n) for p, n, d in folder.store.list(target) if p.endswith(".parquet")]
    return {"files": len(made), "rows": folder.spark.read.parquet(target).count(), "bytes": sum(n for _, n in made)}
