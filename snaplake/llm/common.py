"""What the corpus operators share: the shared folder, written intermediate tables, Arrow batches and token caches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the word-based contracts: runs of anything but space, \t, \n, \v, \f and \r.
WORD_SEPARATORS = "[\\x20\\x09-\\x0D]+"
#: Text that one step of a Python stage turns into Python strings at a time, in bytes, unless one document is longer.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or a temporary one where all run in one process (local tests)."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    context = spark.sparkContext
    if not re.match(r"local(\[|$)", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="snaplake-shared-")
    return _LOCAL[context.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/snaplake/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut, and a lost executor costs nothing that was written."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def learn_rows(doc_id: Column) -> Column:
    """Rows that models may learn from: crc32 of the id as text, mod 4, is not 2 (null ids: may)."""
    return ~held_out(doc_id)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def spread(*cols: Column) -> Column:
    """A value in [0, 1) that depends on the columns alone; used to draw documented samples the same way on every run."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


#: Bytes of an Arrow batch that goes to Python, unless one row has more.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Limits the session's Arrow batches by bytes: both sides of a Python stage hold whole batches, and Spark's own limit is 64 MB."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, list]]:
    """(place of the first, values) of consecutive values of a string column, about `most` bytes at a time or one longer value."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(column):
        before = int(upto[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, before + most, side="right")))
        yield start, column.slice(start, stop - start).to_pylist()
        start = stop


def text_chunks(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """(rows, their texts) in steps of about `most` bytes of text, or one document if it is longer; the batch itself stays in Arrow buffers."""
    give_back()
    for batch in batches:
        for start, texts in chunks(batch.column(text), most):
            yield batch.slice(start, len(texts)), texts


class Generations(dict):
    """Key -> make(key) in bounded memory: `weigh` says how many bytes a pair takes.

    When `budget` bytes are held, the pairs become the old generation and those that are used again are carried over, so what is
    common stays and what is held is twice the budget at most.
    """

    def __init__(self, make: Callable, weigh: Callable, budget: int = 12 << 20):
        super().__init__()
        self.make, self.weigh, self.budget, self.size, self.old = make, weigh, budget, 0, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        self.size += self.weigh(key, found)
        if self.size > self.budget:
            self.old, self.size = dict(self), self.weigh(key, found)
            self.clear()
        self[key] = found
        return found


class TokenRows(dict):
    """Token -> row of a matrix of values that depend on the token alone.

    Values of new tokens are computed together by `compute(list of tokens) -> [n, width]`, some 100,000 characters at a time.  When the
    tokens and rows take more than `budget` bytes all are forgotten, so memory stays bounded whatever the vocabulary of the corpus is.
    """

    def __init__(self, width: int, compute: Callable[[list[str]], np.ndarray], budget: int = 40 << 20):
        super().__init__()
        self.width, self.compute, self.budget, self.size = width, compute, budget, 0
        self.values, self.new = np.zeros((1024, width)), []

    def __missing__(self, token: str) -> int:
        self[token] = i = len(self)
        self.new.append(token)
        return i

    def lookup(self, tokens: list[str]) -> np.ndarray:
        """Values of the tokens, [len(tokens), width]."""
        if self.size > self.budget:
            self.clear()
            self.size, self.values = 0, np.zeros((1024, self.width))
        ids = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        if self.new:
            if len(self) > len(self.values):
                more = np.zeros((max(2 * len(self.values), len(self)), self.width))
                more[: len(self.values)] = self.values
                self.values = more
            at, start, held_ = len(self) - len(self.new), 0, 0
            for i, token in enumerate(self.new):
                held_ += len(token) + 1
                self.size += 220 + 2 * len(token) + 8 * self.width
                if held_ > 100_000 or i == len(self.new) - 1:
                    self.values[at + start : at + i + 1] = self.compute(self.new[start : i + 1])
                    start, held_ = i + 1, 0
            self.new = []
        return self.values[ids]


def sums_by_row(values: np.ndarray, counts: list[int]) -> np.ndarray:
    """Sums of consecutive runs of rows; counts may hold zeros."""
    out = np.zeros((len(counts), values.shape[1]))
    counts_ = np.asarray(counts)
    full = counts_ > 0
    if full.any():
        starts = np.concatenate([[0], np.cumsum(counts_)])[:-1]
        out[full] = np.add.reduceat(values, starts[full], axis=0)
    return out


def give_back() -> None:
    """Returns freed memory to the machine: workers live on from stage to stage, and what one stage has freed is of no use to the executor's JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # of the GNU library alone
        ctypes.CDLL(None).malloc_trim(0)


#: The model that a Python worker has unpacked last, with the id its driver gave it.
_HELD: dict[str, object] = {}


def held(kind: str, key: str, make: Callable[[], object]) -> object:
    """make(), kept between the tasks of one Python worker until another model is asked for: workers live on from stage to stage."""
    name = f"{kind} {key}"
    if name not in _HELD:
        _HELD.clear()
        give_back()
        _HELD[name] = make()
    return _HELD[name]
