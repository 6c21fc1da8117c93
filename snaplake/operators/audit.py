"""Audit log: batches of events as day-partitioned Parquet, chained by hashes; query, verification, retention, export."""

from __future__ import annotations

import datetime
import hashlib
import json
import uuid
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import Store

#: Columns of the stored events (fixed values).
FIELDS = ["event_id", "timestamp_ms", "category", "action", "severity", "actor_type", "actor_id", "actor_username", "actor_ip", "actor_user_agent", "organization", "super_name", "correlation_id", "session_id", "server", "resource_type", "resource_id", "detail", "outcome", "reason", "chain_hash", "instance_id"]
SCHEMA = T.StructType([T.StructField(f, T.LongType() if f == "timestamp_ms" else T.StringType()) for f in FIELDS])
#: Control criteria with the categories and actions of the events that are their evidence (fixed values); none given: all.
CRITERIA: dict[str, tuple[list[str], list[str]]] = {
    "CC6.1": (["authentication"], []),
    "CC6.2": (["authorization"], []),
    "CC6.3": (["rbac_change"], []),
    "CC7.1": (["system"], []),
    "CC7.2": (["security_alert", "authentication"], ["brute_force_detected", "privilege_escalation", "unusual_access_pattern", "login_failure", "token_auth_failure", "mcp_auth_failure"]),
    "CC7.3": ([], []),
    "CC8.1": (["config_change"], []),
    "PI1.3": (["data_mutation"], []),
    "A1.2": (["system", "config_change"], ["service_start", "service_stop", "health_check_failure", "retention_execute", "legal_hold_change", "engine_config_change"]),
}
GENESIS, RETENTION_DAYS = "0" * 64, 2555


def batch_hash(ids: list[str], file_hash: str) -> str:
    return hashlib.sha256("\n".join([*sorted(ids), file_hash]).encode()).hexdigest()


def chain_hash(previous: str, batch: str) -> str:
    return hashlib.sha256((previous + batch).encode()).hexdigest()


def content_hash(events: list[dict[str, Any]]) -> str:
    """Hash over all stored fields of a batch's events, but for the head that follows from it."""
    return hashlib.sha256("\n".join(sorted(json.dumps({f: e.get(f) for f in FIELDS if f != "chain_hash"}, sort_keys=True) for e in events)).encode()).hexdigest()


def _contents(batch: pa.Table) -> pa.Table:
    events = batch.to_pylist()
    return pa.Table.from_pydict({"chain_hash": [events[0]["chain_hash"]], "ids": [sorted(e["event_id"] or "" for e in events)], "content": [content_hash(events)]}, pa.schema([("chain_hash", pa.string()), ("ids", pa.list_(pa.string())), ("content", pa.string())]))


def batch_hashes(events: DataFrame, keys: list[str], content: Column) -> DataFrame:
    """For each group of keys, the hash over its sorted event ids and the hash of its sorted contents; a group is one batch, so it is small."""
    hashed = events.groupBy(*keys).agg(F.array_sort(F.collect_list("event_id")).alias("ids"), F.sha2(F.array_join(F.array_sort(F.collect_list(content)), "\n"), 256).alias("file_hash"))
    return hashed.select(*keys, F.sha2(F.array_join(F.concat("ids", F.array("file_hash")), "\n"), 256).alias("batch_hash"))


def daily_root(heads: DataFrame) -> DataFrame:
    """day, root: the hash over the instances' heads (day, instance_id, head) in the order of their ids."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("instance_id", "head"))), lambda x: x["head"])
    return heads.groupBy("day").agg(F.sha2(F.array_join(ordered, "\n"), 256).alias("root"))


class AuditLog:
    def __init__(self, spark: SparkSession, path: str, instance: str = "main", key: str | None = None):
        """key: 16, 24 or 32 characters; details are then kept encrypted."""
        self.spark, self.path, self.instance, self.key = spark, path, instance, key
        self.store = Store(spark)

    def _head_path(self) -> str:
        return f"{self.path}/chain/{self.instance}"

    def _links(self) -> list[dict]:
        return [self.store.read_json(p) for p, _, _ in self.store.list(self._head_path()) if p.endswith(".json")]

    def append(self, events: list[dict[str, Any]]) -> str:
        """Writes a batch; returns the new head of the chain."""
        now = datetime.datetime.now(datetime.timezone.utc)
        rows = [{**dict.fromkeys(FIELDS), "event_id": uuid.uuid4().hex, "timestamp_ms": int(now.timestamp() * 1000), "severity": "info", "outcome": "success", **e, "instance_id": self.instance} for e in events]
        links = self._links()
        previous = links[-1]["chain_hash"] if links else GENESIS
        if unknown := {k for r in rows for k in r} - set(FIELDS):
            raise ValueError(f"events have no fields {sorted(unknown)}")
        body = content_hash(rows)
        batch = batch_hash([r["event_id"] for r in rows], body)
        head = chain_hash(previous, batch)
        df = self.spark.createDataFrame([tuple({**r, "chain_hash": head}[f] for f in FIELDS) for r in rows], SCHEMA)
        if self.key:
            df = df.withColumn("detail", F.base64(F.aes_encrypt("detail", F.lit(self.key))))
        day = now.date().isoformat()
        df.coalesce(1).write.mode("append").parquet(f"{self.path}/events/day={day}")
        self.store.write_json(f"{self._head_path()}/{len(links):012d}.json", {"previous": previous, "chain_hash": head, "batch_hash": batch, "content_hash": body, "ids": sorted(r["event_id"] for r in rows), "day": day})
        return head

    def events(self) -> DataFrame:
        df = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/events") if self.store.exists(f"{self.path}/events") else self.spark.createDataFrame([], SCHEMA)
        return df.withColumn("detail", F.aes_decrypt(F.unbase64("detail"), F.lit(self.key)).cast("string")) if self.key else df

    def query(self, since_ms: int | None = None, until_ms: int | None = None, limit: int = 100, **equal: Any) -> DataFrame:
        return query_events(self.events(), since_ms, until_ms, limit, **equal)

    def verify(self) -> tuple[bool, str]:
        """Walks the chain: every link follows from the one before, and its batch's events, hashed again from the table, are those that were appended.

        Batches of days that retention has taken out are only followed by their links.  Events that no link names are a fault too.
        """
        previous, kept_from = GENESIS, self._kept_from()
        hashed = self.events().groupBy("chain_hash").applyInArrow(_contents, "chain_hash string, ids array<string>, content string")
        have = {r["chain_hash"]: (r["ids"], r["content"]) for r in hashed.toLocalIterator()}
        for k, link in enumerate(self._links()):
            if link["previous"] != previous or chain_hash(previous, link["batch_hash"]) != link["chain_hash"] or batch_hash(link["ids"], link["content_hash"]) != link["batch_hash"]:
                return False, f"link {k} doesn't follow"
            ids, content = have.pop(link["chain_hash"], ([], ""))
            if link["day"] >= kept_from or ids:
                if ids != sorted(link["ids"]):
                    return False, f"events of link {k} are missing or added"
                if content != link["content_hash"]:
                    return False, f"events of link {k} were changed"
            previous = link["chain_hash"]
        # what is left belongs to the chains of other instances, if there are any
        return (False, "events without a link") if None in have or have and self._alone() else (True, previous)

    def _alone(self) -> bool:
        """Whether no other instance writes to this log."""
        return len([1 for _, _, d in self.store.list(f"{self.path}/chain") if d]) <= 1

    def _kept_from(self) -> str:
        at = f"{self.path}/retention.json"
        return self.store.read_json(at)["kept_from"] if self.store.exists(at) else ""

    def expire(self, days: int = RETENTION_DAYS, legal_hold: bool = False, today: datetime.date | None = None) -> list[str]:
        if legal_hold or days <= 0:
            return []
        first = ((today or datetime.datetime.now(datetime.timezone.utc).date()) - datetime.timedelta(days=days)).isoformat()
        gone = [p for p, _, d in self.store.list(f"{self.path}/events") if d and p.rsplit("day=", 1)[1] < first]
        if gone:
            self.store.write_json(f"{self.path}/retention.json", {"kept_from": max(first, self._kept_from())}, overwrite=True)
        for p in gone:
            self.store.delete(p)
        return gone

    def export(self, target: str, kind: str = "jsonl", since_ms: int | None = None, until_ms: int | None = None, criterion: str | None = None) -> None:
        """Events of a period, all or those that are evidence of a criterion, as JSON lines or CSV; a period's file is also the incident report."""
        events = within(self.events(), since_ms, until_ms)
        writer = (events.where(is_evidence(criterion)) if criterion else events).write.mode("errorifexists")
        if kind == "jsonl":
            writer.json(target)
        elif kind == "csv":
            writer.option("header", True).csv(target)
        else:
            raise ValueError("jsonl or csv")

    def evidence(self, since_ms: int | None = None, until_ms: int | None = None) -> DataFrame:
        return evidence(within(self.events(), since_ms, until_ms))


def within(events: DataFrame, since_ms: int | None, until_ms: int | None) -> DataFrame:
    if since_ms is not None:
        events = events.where(F.col("timestamp_ms") >= since_ms)
    return events if until_ms is None else events.where(F.col("timestamp_ms") <= until_ms)


def query_events(events: DataFrame, since_ms: int | None = None, until_ms: int | None = None, limit: int = 100, **equal: Any) -> DataFrame:
    """Events with the given values, newest first; an event that is there twice is shown once."""
    for name, value in equal.items():
        if name not in FIELDS:
            raise ValueError(f"{name} isn't a field of events")
        events = events.where(F.col(name) == F.lit(value))
    return within(events, since_ms, until_ms).dropDuplicates(["event_id"]).orderBy(F.desc("timestamp_ms"), "event_id").limit(limit)


def is_evidence(criterion: str) -> Column:
    categories, actions = CRITERIA[criterion]
    out = F.lit(True)
    for name, values in (("category", categories), ("action", actions)):
        if values:
            out = out & F.coalesce(F.col(name).isin(values), F.lit(False))
    return out


def evidence(events: DataFrame) -> DataFrame:
    """criterion, events: how many events are evidence of each control criterion."""
    each = F.array(*(F.when(is_evidence(k), F.lit(k)) for k in CRITERIA))
    return events.select(F.explode(F.array_compact(each)).alias("criterion")).groupBy("criterion").agg(F.count("*").alias("events"))
