"""Mirrors of a table's live rows in open formats, made after a commit.

Deleted rows and system columns are never published.  Formats: "parquet" (the files alone), "delta" (files and a transaction log)
and "iceberg" (see iceberg.py).  The delta mirror keeps its files from version to version: the table's files are mirrored in groups, and a group is
written again only when one of its files has gone or lost rows.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import ROW_FILE, Snapshot, TableFolder
from .iceberg import mirror_iceberg
from .scan import deletions, file_key, live, path_key

FORMATS = ("parquet", "delta", "iceberg")
ENGINE = "snaplake"


def _settings(folder: TableFolder) -> dict:
    at = f"{folder.path}/_mirrors.json"
    return folder.store.read_json(at) if folder.store.exists(at) else {"formats": [], "base": None}


def configured(folder: TableFolder) -> list[str]:
    return _settings(folder)["formats"]


def configure(folder: TableFolder, formats: list[str], base: str | None = None) -> list[str]:
    """Which mirrors a table has; with a base they are brought up to date after each commit."""
    wanted = sorted({f.strip().lower() for f in formats})
    if bad := [f for f in wanted if f not in FORMATS]:
        raise ValueError(f"mirrors in {bad} aren't made")
    folder.store.write_json(f"{folder.path}/_mirrors.json", {"formats": wanted, "base": base}, overwrite=True)
    return wanted


def after_commit(folder: TableFolder) -> None:
    base = _settings(folder)["base"]
    if base:
        mirror(folder, base)


def mirror(folder: TableFolder, base: str) -> dict[str, str]:
    """Brings all configured mirrors below base up to the current version."""
    made = {"parquet": _parquet, "delta": _delta, "iceberg": mirror_iceberg}
    return {f: made[f](folder, f"{base}/{f}/{folder.name}") for f in configured(folder)}


def _files(folder: TableFolder, path: str) -> list[tuple[str, int]]:
    return [(p, n) for p, n, d in folder.store.list(path) if not d and p.endswith(".parquet")]


def _parquet(folder: TableFolder, path: str) -> str:
    """New files come first, then old ones go."""
    old, snapshot = [p for p, _, _ in folder.store.list(path)], folder.snapshot()
    live(folder.spark, snapshot).write.option("compression", "zstd").parquet(f"{path}/v{snapshot.version}-{uuid.uuid4().hex[:8]}")
    for p in old:
        folder.store.delete(p)
    return path


def _dead_rows(folder: TableFolder, snapshot: Snapshot) -> dict[str, int]:
    """Deleted rows of each file that has any."""
    dead = deletions(folder.spark, snapshot)
    return {r["k"]: r["n"] for r in dead.groupBy(file_key(F.col(ROW_FILE)).alias("k")).agg(F.count("*").alias("n")).collect()} if dead is not None else {}


def _stats(folder: TableFolder, files: list[str], schema: T.StructType) -> dict[str, dict]:
    """Per file, from its footer: numRecords, minValues, maxValues and nullCount of columns whose values JSON can hold."""
    from ..plans.stats import collect_stats, footers

    simple = {f.name: f.dataType for f in schema.fields if isinstance(f.dataType, (T.StringType, T.IntegralType, T.DoubleType, T.BooleanType, T.DateType))}
    out = {p: {"numRecords": n, "minValues": {}, "maxValues": {}, "nullCount": {}} for p, n in footers(folder.spark, files).items()}
    stats = collect_stats(folder.spark, files).where(F.col("column_name").isin(list(simple))) if simple else None
    lanes = ("bigint", "double", "timestamp", "string")
    bounds = [f(F.col(f"{n}_{lane}")).alias(f"{n}_{lane}") for n, f in (("min", F.min), ("max", F.max)) for lane in lanes]
    # a column's bounds hold only if each of its row groups has some, or nothing but nulls
    whole = F.min(F.col("stats_available") | F.coalesce(F.col("null_count") == F.col("row_group_rows"), F.lit(False))).alias("whole")
    for r in stats.groupBy("file_path", "column_name").agg(*bounds, whole, F.sum("null_count").alias("nulls"), F.count("null_count").alias("known"), F.count("*").alias("groups")).collect() if simple else []:
        mine, c = out[r["file_path"]], r["column_name"]
        for name, key in (("min", "minValues"), ("max", "maxValues")):
            value = next((v for lane in lanes if (v := r[f"{name}_{lane}"]) is not None), None)
            if r["whole"] and value is not None:
                kind = simple[c]
                mine[key][c] = value.date().isoformat() if isinstance(kind, T.DateType) else bool(value) if isinstance(kind, T.BooleanType) else value
        if r["known"] == r["groups"]:
            mine["nullCount"][c] = r["nulls"]
    return out


def _protocol(schema: T.StructType) -> dict:
    if "timestamp_ntz" in schema.simpleString():
        return {"minReaderVersion": 3, "minWriterVersion": 7, "readerFeatures": ["timestampNtz"], "writerFeatures": ["timestampNtz"]}
    return {"minReaderVersion": 1, "minWriterVersion": 2}


def _delta(folder: TableFolder, path: str) -> str:
    store, snapshot, log = folder.store, folder.snapshot(), f"{path}/_delta_log"
    state_at = f"{path}/_snaplake/state.json"
    state = store.read_json(state_at) if store.exists(state_at) else {"version": None, "next": 0, "id": str(uuid.uuid4()), "schema": None, "groups": []}
    if state["version"] == snapshot.version:
        return path
    schema = live(folder.spark, snapshot).schema
    dead = _dead_rows(folder, snapshot)
    now_files = {path_key(r.file): r for r in snapshot.resources}
    same = lambda g: state["schema"] == schema.json() and all(k in now_files and dead.get(k, 0) == n for k, n in g["sources"].items())
    kept = [g for g in state["groups"] if same(g)]
    gone = [g for g in state["groups"] if g not in kept]
    have = {k for g in kept for k in g["sources"]}
    fresh = {k: r for k, r in now_files.items() if k not in have}
    added, now = [], int(time.time() * 1000)
    if fresh:
        part = f"v{snapshot.version}-{uuid.uuid4().hex[:8]}"
        live(folder.spark, snapshot, list(fresh.values())).write.option("compression", "zstd").parquet(f"{path}/{part}")
        files = _files(folder, f"{path}/{part}")
        stats = _stats(folder, [p for p, _ in files], schema) if files else {}
        added = [{"path": f"{part}/{p.rsplit('/', 1)[1]}", "size": n, "stats": json.dumps(stats[p])} for p, n in files if stats[p]["numRecords"]]
        kept.append({"sources": {k: dead.get(k, 0) for k in fresh}, "files": [a["path"] for a in added]})
    actions = [
        {"commitInfo": {"timestamp": now, "operation": "WRITE", "operationParameters": {"mode": "Append" if state["groups"] and not gone else "Overwrite", "sourceVersion": snapshot.version}, "engineInfo": ENGINE}},
        *([{"protocol": _protocol(schema)}, {"metaData": {"id": state["id"], "format": {"provider": "parquet", "options": {}}, "schemaString": schema.json(), "partitionColumns": [], "configuration": {}, "createdTime": now}}] if state["schema"] != schema.json() else []),
        *({"remove": {"path": p, "deletionTimestamp": now, "dataChange": True}} for g in gone for p in g["files"]),
        *({"add": {**a, "partitionValues": {}, "modificationTime": now, "dataChange": True}} for a in added),
    ]
    store.write_text(f"{log}/{state['next']:020d}.json", "".join(json.dumps(a) + "\n" for a in actions))
    store.write_json(state_at, {"version": snapshot.version, "next": state["next"] + 1, "id": state["id"], "schema": schema.json(), "groups": kept}, overwrite=True)
    return path
