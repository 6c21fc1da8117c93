"""Staging areas and pipes: files that land in a folder are upserted into a table by Structured Streaming, exactly once."""

from __future__ import annotations

import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..lake import Lake


class Staging:
    """A landing folder of Parquet files with an index of what was saved."""

    def __init__(self, lake: Lake, name: str):
        self.lake, self.name = lake, name
        self.path = f"{lake.path}/_staging/{name}"

    def save(self, df: DataFrame, base: str, role: str = "superadmin") -> str:
        self.lake.roles.get(role).need("write")
        name, start = f"{base}_{time.time_ns()}", time.time()
        df.write.option("compression", "zstd").parquet(f"{self.path}/files/{name}.parquet")
        rows = self.lake.spark.read.parquet(f"{self.path}/files/{name}.parquet").count()
        self.lake.store.write_json(f"{self.path}/index/{name}.json", {"file": name, "written_at_ns": time.time_ns(), "rows": rows, "duration_ms": int(1000 * (time.time() - start)), "status": "saved"})
        return name

    def files(self) -> DataFrame:
        rows = [self.lake.store.read_json(p) for p, _, _ in self.lake.store.list(f"{self.path}/index")]
        return self.lake.spark.createDataFrame([(r["file"], r["written_at_ns"], r["rows"], r["status"]) for r in rows], "file string, written_at_ns long, rows long, status string")

    def tree(self) -> dict:
        return self.lake.store.tree(self.path)

    def delete(self, name: str) -> None:
        self.lake.store.delete(f"{self.path}/files/{name}.parquet")
        self.lake.store.delete(f"{self.path}/index/{name}.json")


class Pipe:
    """A definition: which staging area feeds which table, and how."""

    def __init__(self, lake: Lake, name: str, staging: str, table: str, keys: list[str] | None = None, newer_than: str | None = None, transformation: list[str] | None = None, enabled: bool = True):
        self.lake, self.name, self.enabled = lake, name, enabled
        self.definition: dict[str, Any] = {"name": name, "staging": staging, "table": table, "keys": keys or [], "newer_than": newer_than, "transformation": transformation or [], "enabled": enabled}

    def save(self) -> Pipe:
        self.lake.store.write_json(f"{self.lake.path}/_pipes/{self.name}.json", self.definition, overwrite=True)
        return self

    @staticmethod
    def load(lake: Lake, name: str) -> Pipe:
        return Pipe(lake, **lake.store.read_json(f"{lake.path}/_pipes/{name}.json"))

    def start(self, schema: T.StructType, once: bool = True) -> StreamingQuery | None:
        """Runs the pipe over the files that are there (once) or all that will come; None if it is switched off."""
        if not self.enabled:
            return None
        d = self.definition
        source = Staging(self.lake, d["staging"])
        rows = self.lake.spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{source.path}/files")
        if d["transformation"]:
            rows = rows.selectExpr(*d["transformation"])
        writer = rows.writeStream.foreachBatch(self._write).option("checkpointLocation", f"{self.lake.path}/_checkpoints/{self.name}")
        return (writer.trigger(availableNow=True) if once else writer).start()

    def _write(self, batch: DataFrame, batch_id: int) -> None:
        """A batch that the table's log has already is skipped, so a restart adds nothing twice."""
        d = self.definition
        table = self.lake.table(d["table"])
        if table.folder.exists() and table.folder.last_batch("pipe", self.name) >= batch_id:
            return
        how = {"lineage": {"operation": "pipe", "pipe": self.name, "batch": batch_id}}
        if d["keys"]:
            table.upsert(batch, d["keys"], d["newer_than"], **how)
        else:
            table.append(batch, **how)


def tumbling(events: DataFrame, time_column: str, width: str, keys: list[str], value: str, late: str | None = None) -> DataFrame:
    """Counts and sums per window and keys, for batches and streams; late: how long a stream waits for late rows."""
    rows = events.withWatermark(time_column, late) if late and events.isStreaming else events
    return rows.groupBy(F.window(time_column, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, time_column: str, gap: str, key: str, late: str | None = None) -> DataFrame:
    """Sessions of each key: their start, end and number of rows."""
    rows = events.withWatermark(time_column, late) if late and events.isStreaming else events
    return rows.groupBy(F.session_window(time_column, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def collected(stream: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Runs a stream over all that is there now and gives its output as a table."""
    writer = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True)
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
