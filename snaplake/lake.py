"""The library's front: lakes, tables, SQL with roles, metadata."""

from __future__ import annotations

import json
import random
import re
import threading
import time
import uuid
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.compat import register
from .operators import compact as compaction
from .operators import write as writing
from .operators.monitor import Monitor
from .operators.rbac import Role, Roles, compile_filter
from .plans import dialect, pruning
from .sources.catalog import Conflict, Database, NotFound, Snapshot
from .sources.mirror import after_commit
from .sources.scan import live
from .sources.storage import Store
from .types import union_all


#: Tries of a write that other writers overtake.
ATTEMPTS = 10


class Table:
    def __init__(self, lake: Lake, database: Database, name: str):
        self.lake, self.database, self.name = lake, database, name
        self.folder = database.folder(name)

    @property
    def full_name(self) -> str:
        return f"{self.database.name}.{self.name}"

    def _write(self, role: str, df: DataFrame, **how: Any) -> tuple[int, int, int, int]:
        """A write that another one overtakes starts again from the new version; what it had written is named by no version."""
        self.lake.roles.get(role).need("write", self.full_name)
        start = time.time()
        for left in range(ATTEMPTS - 1, -1, -1):
            try:
                out = writing.write(self.folder, df, **how)
                break
            except Conflict:
                if not left:
                    raise
                time.sleep(random.uniform(0, 0.1 * (ATTEMPTS - left)))
        after_commit(self.folder)
        self.lake.monitor.record("writes", table_name=self.name, role_name=role, overwrite_columns=how.get("keys") or [], newer_than=how.get("newer_than"), delete_only=how.get("delete_only", False), total_columns=out[0], inserted=out[2], deleted=out[3], duration=time.time() - start)
        return out

    def append(self, df: DataFrame, role: str = "superadmin", **how: Any) -> tuple[int, int, int, int]:
        return self._write(role, df, **how)

    def upsert(self, df: DataFrame, keys: list[str], newer_than: str | None = None, role: str = "superadmin", **how: Any) -> tuple[int, int, int, int]:
        return self._write(role, df, keys=keys, newer_than=newer_than, **how)

    def delete(self, df: DataFrame, keys: list[str], role: str = "superadmin") -> tuple[int, int, int, int]:
        return self._write(role, df, keys=keys, delete_only=True)

    def delete_all(self, role: str = "superadmin") -> tuple[int, int, int, int]:
        return self._write(role, self.read().limit(0), delete_only=True)

    def compact(self, small_only: bool = True, force_deletions: bool = True, role: str = "superadmin") -> dict:
        """force_deletions: rows are taken out of the files however few are deleted, else only beyond the table's limit."""
        self.lake.roles.get(role).need("control")
        done = compaction.compact(self.folder, small_only, force_deletions=force_deletions)
        self.lake.monitor.record("compact", table_name=self.name, role_name=role, **done)
        return done

    def export(self, target: str, files: int | None = None, level: int | None = None) -> dict:
        return compaction.export(self.folder, target, files, level)

    def configure(self, **values: int) -> None:
        self.folder.configure(**values)

    def read(self, version: int | None = None, schema_mode: str = "last", spark: SparkSession | None = None) -> DataFrame:
        """Live rows of the current or an older version."""
        return live(spark or self.lake.spark, self.folder.snapshot(version), schema_mode=schema_mode)

    def snapshot(self, version: int | None = None) -> Snapshot:
        return self.folder.snapshot(version)

    def history(self) -> DataFrame:
        rows = [(s.version, s.previous, len(s.resources), sum(r.rows for r in s.resources), s.deletion_rows, s.live_rows, json.dumps(s.lineage)) for s in self.folder.history()]
        return self.lake.spark.createDataFrame(rows, "version long, previous long, files long, physical_rows long, deleted_rows long, live_rows long, lineage string")

    def stats(self) -> DataFrame:
        """Statistics of the current files' columns, from their footers."""
        snapshot = self.folder.snapshot()
        names = self.lake.spark.createDataFrame([(r.file,) for r in snapshot.resources], "file_path string")
        return pruning.stats_frame(self.lake.spark, snapshot).join(names, "file_path", "left_semi")

    def set_row_filter(self, f: Any) -> None:
        """A share's filter: it holds for every reader, beside those of roles."""
        self.folder.store.write_json(f"{self.folder.path}/_share.json", f, overwrite=True)

    def row_filter(self) -> Any:
        at = f"{self.folder.path}/_share.json"
        return self.folder.store.read_json(at) if self.folder.store.exists(at) else None

    def drop(self, role: str = "superadmin") -> None:
        self.lake.roles.get(role).need("control")
        self.folder.drop()


class Lake:
    """Databases of tables below one folder of any store that Spark reads."""

    def __init__(self, spark: SparkSession, path: str, default: str = "main"):
        self.spark, self.default = spark, default
        self.store = Store(spark)
        self.path = self.store.qualified(path)
        self.roles = Roles(self.store, f"{self.path}/_access", default)
        self.monitor = Monitor(self.store, f"{self.path}/_metrics")

    def database(self, name: str | None = None) -> Database:
        return Database(self.spark, f"{self.path}/{name or self.default}", name or self.default)

    def databases(self) -> list[str]:
        return [n for p, _, d in self.store.list(self.path) if d and not (n := p.rsplit("/", 1)[1]).startswith("_")]

    def table(self, name: str) -> Table:
        db, _, table = name.rpartition(".")
        return Table(self, self.database(db or None), table)

    # --- reading -------------------------------------------------------------------------------------------------

    def _relations(self, session: SparkSession, sql: str) -> list[list[str]]:
        """Names of relations that a statement reads, from Spark's own parser."""
        plan = session._jsparkSession.sessionState().sqlParser().parsePlan(sql)  # noqa: SLF001
        found = re.findall(r"'UnresolvedRelation \[([^\]]*)\]", plan.treeString())
        return [[p.strip() for p in x.split(",")] for x in dict.fromkeys(found)]

    def _view(self, session: SparkSession, name: str, table: Table, snapshot: Snapshot, files: list | None, role: Role, schema_mode: str, collation: str | None) -> None:
        """The view under which a statement reads a table: all its files, or those that a first plan has left."""
        rows = live(session, snapshot, files, schema_mode=schema_mode)
        if (shared := table.row_filter()) is not None:
            rows = rows.where(compile_filter(shared))
        rows = role.view(rows, table.full_name)
        if collation == "nocase":
            rows = rows.select(*(F.collate(F.col(f"`{f.name}`"), "UTF8_LCASE").alias(f.name) if f.dataType == T.StringType() else F.col(f"`{f.name}`") for f in rows.schema.fields))
        rows.createOrReplaceTempView(name)

    def _fewer_files(self, session: SparkSession, plan: DataFrame, tables: dict[str, tuple[Table, Snapshot]]) -> dict[str, list]:
        """For each view, the files that its table's occurrences in the plan need, where these are fewer than all."""
        optimized, out = None, {}
        for view, (table, snapshot) in tables.items():
            if not snapshot.stats or len(snapshot.resources) < 2:
                continue
            optimized = optimized or plan._jdf.queryExecution().optimizedPlan()  # noqa: SLF001
            if wanted := pruning.occurrences(optimized, table.folder.path):
                files = pruning.pruned(session, snapshot, wanted)
                if len(files) < len(snapshot.resources):
                    out[view] = files
        return out

    def sql(self, query: str, role: str = "superadmin", limit: int | None = None, prune: bool = True, schema_mode: str = "last", collation: str | None = None, timeout: float | None = None) -> DataFrame:
        """A lazy DataFrame of a SELECT, WITH, EXPLAIN [ANALYZE] or SHOW STATS.

        limit: for statements without a LIMIT of their own.  collation "nocase" compares strings without case.  timeout: the
        statement is run at once, for so many seconds at most, and its result is kept (persisted); else it runs when the result is used.
        """
        kind, body = dialect.classify(query)
        who = self.roles.get(role)
        start = time.time()
        if kind == "show stats":
            who.need("read", self.table(body).full_name)
            return self.table(body).stats()
        session = self.spark.newSession()
        for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.autoBroadcastJoinThreshold"):
            session.conf.set(key, self.spark.conf.get(key))
        register(session)
        spark_sql = dialect.to_spark(body)
        known: dict[tuple[str, str], str] = {}
        seen: dict[str, tuple[Table, Snapshot]] = {}
        for parts in self._relations(session, spark_sql):
            db, name = (self.default, parts[0]) if len(parts) == 1 else (parts[-2], parts[-1])
            try:
                table = Table(self, self.database(db), name)
                there = table.folder.exists()
            except (ValueError, NotFound):
                there = False
            if not there:
                if len(parts) == 1:
                    continue  # the name of a WITH part, or unknown: then Spark's analyser says so
                raise NotFound(f"table {db}.{name} is not there")
            view = name if len(parts) == 1 else f"{db}__{name}"
            if len(parts) > 1:
                known[(db.lower(), name.lower())] = view
            seen[view] = (table, table.folder.snapshot())
            self._view(session, view, *seen[view], None, who, schema_mode, collation)
        final = dialect.rename_tables(spark_sql, known)
        try:
            out = session.sql(final)
        except AnalysisException as e:
            for table, snapshot in seen.values():
                hidden = who.hidden([f.name for f in snapshot.struct.fields], table.full_name)
                missing = re.search(r"with name (.+?) cannot be resolved", str(e))
                if missing and missing[1].replace("`", "").split(".")[-1].lower() in hidden:
                    raise PermissionError(f"role {role} may not read {missing[1]}") from None
            if (missing := re.search(r"with name (.+?) cannot be resolved", str(e))) and seen:
                raise ValueError(f"Missing required column(s): {missing[1]}") from e
            raise
        files = self._fewer_files(session, out, seen) if prune else {}
        if files:
            for view, use in files.items():
                self._view(session, view, *seen[view], use, who, schema_mode, collation)
            out = session.sql(final)
        if kind != "select":
            plan = out._jdf.queryExecution()  # noqa: SLF001
            if kind == "explain analyze":
                n = out.count()
                return session.createDataFrame([(plan.toString(), n, time.time() - start)], "plan string, rows long, seconds double")
            return session.createDataFrame([(plan.toString(),)], "plan string")
        if limit is not None and not any(t.word == "limit" for t in _outer(dialect.tokens(body))):
            out = out.limit(limit)
        self.monitor.record("plans", role_name=role, sql=query[:500], engine="spark", tables=sorted(seen), files=sum(len(x.resources) for _, x in seen.values()), files_read=sum(len(files.get(v, x.resources)) for v, (_, x) in seen.items()), planning_seconds=time.time() - start)
        if timeout:
            _within(out, timeout)
        return out

    # --- metadata ------------------------------------------------------------------------------------------------

    def diagnostics(self) -> DataFrame:
        """check, status (ok or fail), detail: the store can be written, the session computes, the default database can be read."""

        def trial(f) -> tuple[str, str]:
            try:
                return "ok", str(f())
            except Exception as e:  # noqa: BLE001  the outcome is the report
                return "fail", f"{type(e).__name__}: {str(e)[:300]}"

        def written() -> str:
            at = f"{self.path}/_probe/{time.time_ns()}"
            self.store.write_text(at, "x")
            self.store.delete(at)
            return self.path

        checks = {"store": written, "session": lambda: self.spark.range(1000).agg(F.sum("id")).first()[0], "catalog": lambda: len(self.database().tables()), "task slots": lambda: self.spark.sparkContext.defaultParallelism}
        return self.spark.createDataFrame([(name, *trial(f)) for name, f in checks.items()], "check string, status string, detail string")

    def tables_frame(self, database: str | None = None) -> DataFrame:
        """One row for each table: version, files, live rows, bytes; no data file is opened."""
        db = self.database(database)
        rows = []
        for name in db.tables():
            s = db.folder(name).snapshot()
            rows.append((db.name, name, s.version, len(s.resources), s.live_rows, sum(r.file_size for r in s.resources), s.deletion_rows))
        return self.spark.createDataFrame(rows, "database_name string, table_name string, version long, files long, live_rows long, bytes long, deleted_rows long")

    def schema_frame(self, table: str) -> DataFrame:
        fields = self.table(table).snapshot().struct.fields
        return self.spark.createDataFrame([(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(fields)], "position int, column_name string, data_type string, nullable boolean")

    def whole_database(self, database: str | None = None) -> DataFrame:
        """All tables of a database as one relation under their union schema."""
        db = self.database(database)
        names = [t for t in db.tables() if not (t.startswith("__") and t.endswith("__"))]
        if not names:
            raise NotFound(f"database {db.name} has no table")
        return union_all([live(self.spark, db.folder(t).snapshot()) for t in names])


def _outer(ts: list[dialect.Token]) -> list[dialect.Token]:
    out, depth = [], 0
    for t in ts:
        depth += (t.word == "(") - (t.word == ")")
        if not depth:
            out.append(t)
    return out


def _within(df: DataFrame, seconds: float) -> None:
    """Computes and persists df; jobs of this thread carry a tag meanwhile, by which they are cancelled after so many seconds."""
    context, tag = df.sparkSession.sparkContext, f"snaplake-{uuid.uuid4().hex}"
    late = threading.Event()

    def cancel() -> None:
        late.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, cancel)
    timer.daemon = True
    context.addJobTag(tag)
    timer.start()
    try:
        df.persist().count()
    except Exception as e:
        df.unpersist()
        if late.is_set():
            raise TimeoutError(f"cancelled after {seconds} seconds") from e
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)
