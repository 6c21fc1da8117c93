"""Files through Spark's Hadoop FileSystem, so any store that Spark reads will do."""

from __future__ import annotations

import json
import os
import re
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def address(uri: str) -> str:
    """The address of a file for Arrow: Hadoop writes file:/x where others write file:///x, and has names of its own for S3."""
    uri = re.sub(r"^s3[an]:", "s3:", uri)
    return re.sub(r"^(\w+):/(?!/)", r"\1:///", uri) if re.match(r"[A-Za-z][\w+.-]*:", uri) else f"file://{uri}"


def _write_local(path: str, text: str, overwrite: bool) -> None:
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with open(tmp, "x", encoding="utf-8") as out:
            out.write(text)
            out.flush()
            os.fsync(out.fileno())
        if overwrite:
            os.replace(tmp, path)
        else:
            os.link(tmp, path)  # fails if there is one
    finally:
        if os.path.exists(tmp):
            os.unlink(tmp)


class Store:
    """Small documents and folders under one session."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.jvm = spark._jvm  # noqa: SLF001
        self.conf = spark._jsc.hadoopConfiguration()  # noqa: SLF001

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read_text(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def read_json(self, path: str) -> Any:
        return json.loads(self.read_text(path))

    def write_text(self, path: str, text: str, overwrite: bool = False) -> None:
        """Appears whole or not at all, and without `overwrite` only where nothing is: of writers that race for a path one wins, the others get FileExistsError.

        Local files are linked or replaced in one step, HDFS renames in one step, and object stores put whole objects, on the condition that
        there is none.
        """
        fs, p = self._at(path)
        fs.mkdirs(p.getParent())
        kind = fs.getUri().getScheme()
        if kind == "file":
            _write_local(p.toUri().getPath(), text, overwrite)
        elif kind in ("hdfs", "viewfs"):
            tmp = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
            self._put(fs.create(tmp, True), text)
            rename = self.jvm.org.apache.hadoop.fs.Options.Rename
            options = self.spark.sparkContext._gateway.new_array(rename, 1)  # noqa: SLF001
            options[0] = rename.OVERWRITE if overwrite else rename.NONE
            try:
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf).rename(tmp, p, options)
            except Py4JJavaError as e:
                fs.delete(tmp, False)
                raise self._exists(e, path) from e
        else:
            try:
                made = fs.createFile(p).overwrite(overwrite)
                self._put((made if overwrite else made.opt("fs.option.create.conditional.overwrite", "true")).build(), text)
            except Py4JJavaError as e:
                raise self._exists(e, path) from e

    def _put(self, out, text: str) -> None:
        try:
            self.jvm.org.apache.commons.io.IOUtils.write(text, out, "UTF-8")
        finally:
            out.close()

    @staticmethod
    def _exists(e: Py4JJavaError, path: str) -> Exception:
        name = e.java_exception.getClass().getName()
        # stores answer a failed condition with status 412
        return FileExistsError(path) if "FileAlreadyExists" in name or "412" in str(e.java_exception.getMessage()) else e

    def read_bytes(self, path: str) -> bytes:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write_bytes(self, path: str, body: bytes) -> None:
        """A new file; its name is made up by the caller, so no one reads it before it is named elsewhere."""
        fs, p = self._at(path)
        fs.mkdirs(p.getParent())
        out = fs.create(p, False)
        try:
            out.write(bytearray(body))
        finally:
            out.close()

    def write_json(self, path: str, value: Any, overwrite: bool = False) -> None:
        self.write_text(path, json.dumps(value, indent=1, default=str), overwrite)

    def delete(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, True)

    def list(self, path: str) -> list[tuple[str, int, bool]]:
        """(path, bytes, is a folder) of what lies in a folder, by name; empty if there is none."""
        fs, p = self._at(path)
        if not fs.exists(p):
            return []
        return sorted((s.getPath().toString(), s.getLen(), s.isDirectory()) for s in fs.listStatus(p))

    def tree(self, path: str) -> dict:
        return {x.rsplit("/", 1)[1]: self.tree(x) if d else n for x, n, d in self.list(path)}

    def qualified(self, path: str) -> str:
        fs, p = self._at(path)
        return p.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()
