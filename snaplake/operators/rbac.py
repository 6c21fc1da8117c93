"""Roles: who may read and write which tables, columns and rows.  Filters are built as Columns, never as SQL text."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import Store

ALLOWED = {"superadmin": {"control", "create", "write", "read", "meta"}, "admin": {"control", "create", "write", "read", "meta"}, "writer": {"meta", "read", "write"}, "reader": {"meta", "read"}, "meta": {"meta"}}
_COMPARE = {"=": "__eq__", "!=": "__ne__", "<>": "__ne__", "<": "__lt__", ">": "__gt__", "<=": "__le__", ">=": "__ge__"}


def _value(f: dict) -> Column:
    kind = f.get("type", "value")
    if kind == "value":
        return F.lit(f["value"])
    if kind == "null":
        return F.lit(None)
    if kind == "column":
        return F.col(f"`{f['value']}`")
    raise ValueError(f"a filter's value can't be of type {kind!r}")


def compile_filter(f: Any) -> Column:
    """A JSON filter as a Column: lists are AND; {"AND"|"OR": [...]}, {"NOT": f}; {"column", "operation", "value", "type", "range", "escape"}."""
    if isinstance(f, list):
        out = F.lit(True)
        for x in f:
            out = out & compile_filter(x)
        return out
    if not isinstance(f, dict):
        raise ValueError("a filter is an object or a list")
    if "AND" in f:
        return compile_filter(list(f["AND"]))
    if "OR" in f:
        out = F.lit(False)
        for x in f["OR"]:
            out = out | compile_filter(x)
        return out
    if "NOT" in f:
        return ~compile_filter(f["NOT"])
    if "range" in f:
        return compile_filter([{"column": f["column"], **r} for r in f["range"]])
    c, op = F.col(f"`{f['column']}`"), str(f["operation"]).upper().strip()
    negated = op.startswith("NOT ") or op == "IS NOT"
    base = op.removeprefix("NOT ").replace("IS NOT", "IS")
    if base in _COMPARE:
        out = getattr(c, _COMPARE[base])(_value(f))
    elif base == "IS":
        if f.get("type") == "null" or f.get("value") is None:
            out = c.isNull()
        elif isinstance(f["value"], bool):
            out = c.eqNullSafe(F.lit(f["value"]))
        else:
            raise ValueError("IS takes null, true or false")
    elif base == "IN":
        out = c.isin(list(f["value"]))
    elif base == "BETWEEN":
        out = c.between(F.lit(f["value"][0]), F.lit(f["value"][1]))
    elif base in ("LIKE", "ILIKE"):
        pattern, mark = str(f["value"]), f.get("escape", "\\")
        if mark != "\\":
            pattern = pattern.replace("\\", "\\\\").replace(mark, "\\")
        out = c.like(pattern) if base == "LIKE" else c.ilike(pattern)
    else:
        raise ValueError(f"operation {op!r} isn't known")
    return ~out if negated else out


@dataclass
class Role:
    """tables: name -> {"columns": [...], "filters": filter}; [] or ["*"] are all columns.

    A name is "database.table", "database.*" or "*.*"; "table" and "*" alone are those of the home database, the lake's default.
    """

    name: str
    kind: str
    tables: dict[str, dict] = field(default_factory=dict)
    role_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    home: str = "main"

    def __post_init__(self) -> None:
        if self.kind not in ALLOWED:
            raise ValueError(f"role {self.kind!r} isn't known")

    @property
    def unbound(self) -> bool:
        return self.kind in ("superadmin", "admin")

    @property
    def content_hash(self) -> str:
        return hashlib.sha256(json.dumps({"role": self.kind, "tables": self.tables}, sort_keys=True).encode()).hexdigest()

    def need(self, what: str, table: str | None = None) -> None:
        if what not in ALLOWED[self.kind] or table is not None and not self.unbound and self.rule(table) is None:
            raise PermissionError(f"role {self.name} may not {what} {table or ''}".strip())

    def rule(self, table: str) -> dict | None:
        """The rule for "database.table", or "table" of the home database: the closest one that is given."""
        db, _, name = table.rpartition(".")
        db = db or self.home
        names = [f"{db}.{name}", *([name] if db == self.home else []), f"{db}.*", *(["*"] if db == self.home else []), "*.*"]
        return next((self.tables[n] for n in names if n in self.tables), None)

    def view(self, rows: DataFrame, table: str) -> DataFrame:
        """What the role sees of the table's rows; filters may use columns that it doesn't see."""
        self.need("read", table)
        if self.unbound:
            return rows
        rule = self.rule(table) or {}
        if rule.get("filters"):
            rows = rows.where(compile_filter(rule["filters"]))
        columns = rule.get("columns") or ["*"]
        if "*" in columns:
            return rows
        wanted = {c.lower() for c in columns}
        return rows.select(*(f"`{c}`" for c in rows.columns if c.lower() in wanted))

    def hidden(self, columns: list[str], table: str) -> set[str]:
        allowed = (self.rule(table) or {}).get("columns") or ["*"]
        return set() if self.unbound or "*" in allowed else {c.lower() for c in columns} - {c.lower() for c in allowed}


class Roles:
    """Roles and users as documents of a lake."""

    def __init__(self, store: Store, path: str, home: str = "main"):
        self.store, self.path, self.home = store, path, home

    def save(self, role: Role) -> Role:
        self.store.write_json(f"{self.path}/roles/{role.role_id}.json", {"name": role.name, "kind": role.kind, "tables": role.tables, "role_id": role.role_id, "content_hash": role.content_hash}, overwrite=True)
        return role

    def all(self) -> list[Role]:
        return [Role(**{k: v for k, v in self.store.read_json(p).items() if k != "content_hash"}, home=self.home) for p, _, _ in self.store.list(f"{self.path}/roles") if p.endswith(".json")]

    def get(self, name: str) -> Role:
        found = next((r for r in self.all() if name in (r.name, r.role_id)), None)
        if found is None:
            if name == "superadmin":
                return Role("superadmin", "superadmin")
            raise PermissionError(f"role {name} isn't known")
        return found

    def delete(self, name: str) -> None:
        self.store.delete(f"{self.path}/roles/{self.get(name).role_id}.json")

    def save_user(self, user: str, roles: list[str]) -> None:
        self.store.write_json(f"{self.path}/users/{user}.json", {"user": user, "roles": [self.get(r).role_id for r in roles]}, overwrite=True)

    def of_user(self, user: str) -> list[Role]:
        at = f"{self.path}/users/{user}.json"
        return [self.get(r) for r in self.store.read_json(at)["roles"]] if self.store.exists(at) else []
