"""Metrics: events are kept per kind and UTC day as JSON lines, and drained into tables by a file stream."""

from __future__ import annotations

import atexit
import contextlib
import datetime
import json
import threading
import time
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import Store

KINDS = ("plans", "writes", "compact", "mcp", "odata", "errors", "locks")
KEEP_DAYS, AT_ONCE = 7, 64


class Monitor:
    def __init__(self, store: Store, path: str, enabled: bool = True):
        self.store, self.path, self.enabled = store, path, enabled
        self.waiting: dict[str, list[dict]] = {}
        self.lock = threading.Lock()
        atexit.register(self._last)

    def _last(self) -> None:
        """What still waits when Python ends is written if the session is still there."""
        with contextlib.suppress(Exception):
            self.flush()

    def record(self, kind: str, **values: Any) -> None:
        """Kept in memory and written in groups; a table whose name is like __x__ is a sink of metrics and gives none."""
        name = str(values.get("table_name") or "")
        if not self.enabled or name.startswith("__") and name.endswith("__"):
            return
        if kind not in KINDS:
            raise ValueError(f"metrics of kind {kind!r} aren't known")
        with self.lock:
            waiting = self.waiting.setdefault(kind, [])
            waiting.append({"query_id": uuid.uuid4().hex, "recorded_at": datetime.datetime.now(datetime.timezone.utc).isoformat(), **values})
            full = len(waiting) >= AT_ONCE
        if full:
            self.flush()

    def flush(self) -> int:
        """Writes what waits, each event under its own day; returns how many."""
        with self.lock:
            waiting, self.waiting = self.waiting, {}
        for kind, rows in waiting.items():
            days: dict[str, list[dict]] = {}
            for r in rows:
                days.setdefault(r["recorded_at"][:10], []).append(r)
            for day, mine in days.items():
                self.store.write_text(f"{self.path}/{kind}/day={day}/{time.time_ns()}-{uuid.uuid4().hex[:8]}.json", "".join(json.dumps(r, default=str) + "\n" for r in mine))
        return sum(map(len, waiting.values()))

    def recent(self, spark: SparkSession, kind: str, n: int = 100) -> DataFrame:
        """The newest n events (query_id, recorded_at, event: JSON); days are read from the last one back until there are enough."""
        self.flush()
        have, total = [], 0
        for path in sorted((p for p, _, d in self.store.list(f"{self.path}/{kind}") if d), reverse=True):
            have.append(path)
            total += spark.read.text(path).count()
            if total >= n:
                break
        if not have:
            return spark.createDataFrame([], "query_id string, recorded_at string, event string")
        lines = spark.read.text(have).select(F.get_json_object("value", "$.query_id").alias("query_id"), F.get_json_object("value", "$.recorded_at").alias("recorded_at"), F.col("value").alias("event"))
        return lines.orderBy(F.desc("recorded_at"), "query_id").limit(n)

    def read(self, spark: SparkSession, kind: str) -> DataFrame:
        self.flush()
        return spark.read.json(f"{self.path}/{kind}")

    def expire(self, today: datetime.date | None = None) -> list[str]:
        """Drops days older than KEEP_DAYS."""
        first = (today or datetime.datetime.now(datetime.timezone.utc).date()) - datetime.timedelta(days=KEEP_DAYS)
        gone = [p for k in KINDS for p, _, d in self.store.list(f"{self.path}/{k}") if d and p.rsplit("day=", 1)[1] < first.isoformat()]
        for p in gone:
            self.store.delete(p)
        return gone


#: Columns of each kind's sink table; other values of an event stay in the day's files.
SINKS = {
    "plans": "query_id string, recorded_at string, role_name string, sql string, engine string, files long, files_read long, planning_seconds double",
    "writes": "query_id string, recorded_at string, table_name string, role_name string, overwrite_columns array<string>, newer_than string, delete_only boolean, total_columns long, inserted long, deleted long, duration double",
    "compact": "query_id string, recorded_at string, table_name string, role_name string, version long, files_before long, files_after long, deleted_rows_dropped long",
}


def drain(lake, kind: str) -> int:
    """Moves what was recorded since the last drain into the table `__kind__`; a checkpoint and batch numbers in the table's log make it exactly once."""
    lake.monitor.flush()
    table = lake.table(f"__{kind}__")

    def put(batch: DataFrame, number: int) -> None:
        done = table.folder.last_batch("drain", kind) if table.folder.exists() else -1
        if number > done and not batch.isEmpty():
            table.append(batch, lineage={"operation": "drain", "pipe": kind, "batch": number})

    if not lake.store.exists(f"{lake.path}/_metrics/{kind}"):
        return 0
    before = table.read().count() if table.folder.exists() else 0
    rows = lake.spark.readStream.schema(SINKS[kind]).option("recursiveFileLookup", "true").json(f"{lake.path}/_metrics/{kind}")
    rows.writeStream.foreachBatch(put).option("checkpointLocation", f"{lake.path}/_checkpoints/metrics-{kind}").trigger(availableNow=True).start().awaitTermination()
    return (table.read().count() if table.folder.exists() else 0) - before
