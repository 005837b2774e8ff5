"""Helpers shared by the training-data operators: table access, written
intermediate tables in the shared checkpoint folder, and Arrow text access."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.session import scratch_path
from lectern.sources.tables import load  # noqa: F401  (re-exported for the queries)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` once as Parquet under ``spark.checkpoint.dir`` and read it back.

    ``batch_rows`` bounds the rows Spark hands to Python at a time during this write, for wide rows. The
    folder is marked for deletion when the application's file system closes.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
    before = spark.conf.get(_BATCH)
    try:
        if batch_rows is not None:
            spark.conf.set(_BATCH, str(batch_rows))
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    _hadoop_path(spark, path)[1].deleteOnExit(_hadoop_path(spark, path)[0])
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def long_key(df: DataFrame, key: Column) -> Column:
    """``key`` as BIGINT: integers as they are, other types through xxhash64; null gives 0."""
    kind = df.select(key).schema[0].dataType
    whole = isinstance(kind, T.IntegralType)
    return F.coalesce(key.cast("long") if whole else F.when(key.isNotNull(), F.xxhash64(key)), F.lit(0).cast("long"))


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that no later plan reads."""
    path, fs = _hadoop_path(df.sparkSession, df._written_path)
    fs.delete(path, True)


def _hadoop_path(spark: SparkSession, path: str):
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(sc._jsc.hadoopConfiguration())


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], n: str, share: int = 1000) -> DataFrame:
    """Inner join on ``keys`` (nulls equal) with a table that has each key once and, in column ``n``, about how
    many rows of ``left`` carry it. Keys with more than 1/``share`` of the rows, fewer than ``share`` of them, are
    joined by broadcast; the others by a shuffle in which no key is large."""
    total = right.agg(F.sum(n)).first()[0] or 0
    more = [c for c in right.columns if c not in (*keys, n)]

    def part(cond) -> DataFrame:
        return right.where(cond).select(*[F.col(k).alias(f"_right_{k}") for k in keys], *more)

    on = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    own = [f"_right_{k}" for k in keys]
    hot = part(F.col(n) * share > total)
    cold = part(F.col(n) * share <= total)
    return (left.join(F.broadcast(hot), on).drop(*own)
            .unionByName(left.join(F.broadcast(hot.select(*own)), on, "left_anti").join(cold, on).drop(*own)))


def iter_bytes(col: pa.Array) -> Iterator[bytes | None]:
    """UTF-8 bytes of each value of a string column (None for null), as zero-copy memoryviews."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    n = len(col)
    if n == 0:
        return
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64)[col.offset: col.offset + n + 1].tolist()
    view = memoryview(data) if data is not None else memoryview(b"")
    valid = None if col.null_count == 0 else col.is_valid().to_pylist()
    for i in range(n):
        yield view[off[i]: off[i + 1]] if valid is None or valid[i] else None


def iter_text(col: pa.Array) -> Iterator[str | None]:
    """Python strings of a string column, one at a time."""
    for b in iter_bytes(col):
        yield None if b is None else str(b, "utf-8", "replace")
