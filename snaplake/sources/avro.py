"""Avro container files: a small encoder and decoder, driven by the schema, for the manifests of mirrors."""

from __future__ import annotations

import hashlib
import io
import json
import struct
from typing import Any

MAGIC = b"Obj\x01"


def zigzag(n: int) -> bytes:
    n = n << 1 if n >= 0 else (-n << 1) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _unzigzag(source: io.BytesIO) -> int:
    n = shift = 0
    while True:
        b = source.read(1)[0]
        n |= (b & 0x7F) << shift
        if not b & 0x80:
            return (n >> 1) ^ -(n & 1)
        shift += 7


def encode(schema: Any, value: Any) -> bytes:
    if isinstance(schema, list):  # a union with null
        branch = next(i for i, s in enumerate(schema) if (s == "null") == (value is None))
        return zigzag(branch) + encode(schema[branch], value)
    kind = schema["type"] if isinstance(schema, dict) else schema
    if kind == "record":
        return b"".join(encode(f["type"], value.get(f["name"])) for f in schema["fields"])
    if kind == "array":
        return (zigzag(len(value)) + b"".join(encode(schema["items"], v) for v in value) if value else b"") + b"\x00"
    if kind == "map":
        return (zigzag(len(value)) + b"".join(encode("string", k) + encode(schema["values"], v) for k, v in value.items()) if value else b"") + b"\x00"
    if kind == "null":
        return b""
    if kind == "boolean":
        return b"\x01" if value else b"\x00"
    if kind in ("int", "long"):
        return zigzag(value)
    if kind in ("float", "double"):
        return struct.pack("<f" if kind == "float" else "<d", value)
    if kind in ("string", "bytes"):
        raw = value.encode() if isinstance(value, str) else value
        return zigzag(len(raw)) + raw
    raise ValueError(f"no encoding of {kind}")


def decode(schema: Any, source: io.BytesIO) -> Any:
    if isinstance(schema, list):
        return decode(schema[_unzigzag(source)], source)
    kind = schema["type"] if isinstance(schema, dict) else schema
    if kind == "record":
        return {f["name"]: decode(f["type"], source) for f in schema["fields"]}
    if kind in ("array", "map"):
        out: list = []
        while n := _unzigzag(source):
            for _ in range(n):
                out.append(decode(schema["items"], source) if kind == "array" else (decode("string", source), decode(schema["values"], source)))
        return out if kind == "array" else dict(out)
    if kind == "null":
        return None
    if kind == "boolean":
        return source.read(1) == b"\x01"
    if kind in ("int", "long"):
        return _unzigzag(source)
    if kind in ("float", "double"):
        return struct.unpack("<f" if kind == "float" else "<d", source.read(4 if kind == "float" else 8))[0]
    raw = source.read(_unzigzag(source))
    return raw.decode() if kind == "string" else raw


def container(schema: dict, rows: list[dict], metadata: dict[str, str]) -> bytes:
    meta = {"avro.schema": json.dumps(schema).encode(), "avro.codec": b"null", **{k: v.encode() for k, v in metadata.items()}}
    body = b"".join(encode(schema, r) for r in rows)
    mark = hashlib.md5(body + meta["avro.schema"]).digest()
    block = zigzag(len(rows)) + zigzag(len(body)) + body + mark if rows else b""
    return MAGIC + encode({"type": "map", "values": "bytes"}, meta) + mark + block


def read_container(raw: bytes) -> tuple[dict[str, bytes], list[dict]]:
    source = io.BytesIO(raw)
    if source.read(4) != MAGIC:
        raise ValueError("not an Avro container")
    meta = decode({"type": "map", "values": "bytes"}, source)
    source.read(16)
    schema, rows = json.loads(meta["avro.schema"]), []
    while source.tell() < len(raw):
        n = _unzigzag(source)
        _unzigzag(source)
        rows += [decode(schema, source) for _ in range(n)]
        source.read(16)
    return meta, rows
