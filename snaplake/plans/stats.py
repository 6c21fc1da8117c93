"""Column statistics of data files, from their Parquet footers: one row for each file, row group and column."""

from __future__ import annotations

import datetime
import io
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.catalog import SYSTEM
from ..sources.storage import address

L, D, S, B, N = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.TimestampNTZType()
STATS = T.StructType(
    [
        T.StructField(n, t)
        for n, t in (
            *(("file_path", S), ("row_group_id", L), ("column_name", S), ("physical_type", S), ("logical_type", S)),
            *(("min_bigint", L), ("max_bigint", L), ("min_double", D), ("max_double", D), ("min_timestamp", N), ("max_timestamp", N), ("min_string", S), ("max_string", S)),
            *(("null_count", L), ("row_group_rows", L), ("compressed_bytes", L), ("stats_available", B), ("min_is_exact", B), ("max_is_exact", B)),
        )
    ]
)
LANES = ("bigint", "double", "timestamp", "string")


def _footer(path: str):
    import pyarrow.fs
    import pyarrow.parquet as pq

    store, at = pyarrow.fs.FileSystem.from_uri(address(path))
    return pq.read_metadata(at, filesystem=store)


def lane(value: object) -> tuple[str, object] | None:
    """(lane, value in it) of a literal or bound; None for what has no lane."""
    if isinstance(value, bool):
        return "bigint", int(value)
    if isinstance(value, int):
        return "bigint", value
    if isinstance(value, float):
        return None if value != value else ("double", value)
    if isinstance(value, datetime.datetime):
        return "timestamp", value.astimezone(datetime.timezone.utc).replace(tzinfo=None) if value.tzinfo else value
    if isinstance(value, datetime.date):
        return "timestamp", datetime.datetime(value.year, value.month, value.day)
    if isinstance(value, str):
        return "string", value
    return None


def footer_rows(path: str) -> list[dict]:
    meta, out = _footer(path), []
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        for c in range(group.num_columns):
            col = group.column(c)
            if col.path_in_schema in SYSTEM:
                continue
            s = col.statistics
            row = {f.name: None for f in STATS.fields} | {"file_path": path, "row_group_id": g, "column_name": col.path_in_schema, "physical_type": col.physical_type, "row_group_rows": group.num_rows, "compressed_bytes": col.total_compressed_size, "stats_available": False, "min_is_exact": False, "max_is_exact": False}
            if s is not None:
                row["logical_type"] = str(s.logical_type.type)
                row["null_count"] = s.null_count if s.has_null_count else None
                if s.has_min_max and col.physical_type != "INT96" and (low := lane(s.min)) and (high := lane(s.max)):
                    row[f"min_{low[0]}"], row[f"max_{high[0]}"] = low[1], high[1]
                    row |= {"stats_available": True, "min_is_exact": True, "max_is_exact": True}
            out.append(row)
    return out


def footers(spark: SparkSession, paths: list[str]) -> dict[str, int]:
    """Rows of each file."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"path": pdf["path"], "n": [_footer(p).num_rows for p in pdf["path"]]})

    if len(paths) <= 8:  # not worth a job
        return {p: _footer(p).num_rows for p in paths}
    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(min(len(paths), spark.sparkContext.defaultParallelism * 2))
    return {r["path"]: r["n"] for r in rows.mapInPandas(run, "path string, n long").collect()}


def collect_stats(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Statistics of the files; footers are read by the executors."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [r for p in pdf["path"] for r in footer_rows(p)]
            out = pd.DataFrame(rows, columns=STATS.names)
            for f in STATS.fields:
                if f.dataType == L:
                    out[f.name] = out[f.name].astype("Int64")
            yield out

    if len(paths) <= 8:  # not worth a job
        rows = [r for p in paths for r in footer_rows(p)]
        return spark.createDataFrame([tuple(r[n] for n in STATS.names) for r in rows], STATS).coalesce(1)
    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(min(len(paths), spark.sparkContext.defaultParallelism * 2))
    return rows.mapInPandas(run, STATS)


def write_stats(spark: SparkSession, paths: list[str], target: str, store) -> None:
    """Writes the statistics of some files; a few rows go straight into a file, without a job."""
    if len(paths) > 8:
        collect_stats(spark, paths).coalesce(max(1, len(paths) // 2000)).write.option("compression", "zstd").parquet(target)
        return
    import pyarrow as pa
    import pyarrow.parquet as pq

    kinds = {L: pa.int64(), D: pa.float64(), S: pa.string(), B: pa.bool_(), N: pa.timestamp("us")}
    rows = [r for p in paths for r in footer_rows(p)]
    table = pa.Table.from_pylist(rows, pa.schema([(f.name, kinds[f.dataType]) for f in STATS.fields]))
    out = io.BytesIO()
    pq.write_table(table, out, compression="zstd")
    store.write_bytes(f"{target}/part-00000.parquet", out.getvalue())
