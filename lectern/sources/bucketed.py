"""A keyed store of which an upsert rewrites only the buckets it touches.

Rows are dealt to ``buckets`` folders by a hash of the key. Every write goes to a folder of its own
(``data/v=N/bucket=B``), and the commit, a small table that names the version holding each bucket and its
row count, is written last. Readers follow the newest complete commit, so a failed write leaves nothing behind that
is read, a retried one overwrites its own folder, and a reader that has begun keeps its files. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators import incremental as INC
from lectern.sources.store import versions

COMMIT = "bucket int, version int, n long"


class BucketedStore:
    """``key`` decides the bucket: the record id for plain upserts, the file's path where files are replaced whole."""

    def __init__(self, spark: SparkSession, base: str, schema: str | T.StructType, key: str, buckets: int = 256) -> None:
        self.spark, self.base, self.key, self.buckets = spark, base.rstrip("/"), key, buckets
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)

    def _commit(self) -> dict[int, tuple[int, int]]:
        """Bucket -> (version, rows) of the newest complete commit; at most ``buckets`` rows."""
        return {r.bucket: (r.version, r.n) for r in self.sizes().collect()}

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _read(self, commit: dict[int, tuple[int, int]]) -> DataFrame:
        paths = [f"{self.base}/data/v={v}/bucket={b}" for b, (v, n) in sorted(commit.items()) if n]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """All rows; an empty frame before the first write."""
        return self._read(self._commit())

    def sizes(self) -> DataFrame:
        """(bucket, version, n) of the newest complete commit; no rows before the first write."""
        done = versions(self.spark, f"{self.base}/commits")
        return self.spark.read.schema(COMMIT).parquet(f"{self.base}/commits/v={done[-1]}") if done else self.spark.createDataFrame([], COMMIT)

    def count(self) -> int:
        """The number of rows, from the commit alone (0: retrieval refuses)."""
        return sum(n for _, n in self._commit().values())

    def _write(self, rows: DataFrame, commit: dict[int, tuple[int, int]], touched: list[int] | range) -> int:
        new = (versions(self.spark, f"{self.base}/commits") or [0])[-1] + 1
        folder = f"{self.base}/data/v={new}"
        placed = rows.select(*[f.name for f in self.schema.fields]).withColumn("bucket", self._bucket())
        # a crowded bucket becomes several files, small ones share a task
        (placed.repartitionByRange("bucket", F.xxhash64(*[f.name for f in self.schema.fields if f.dataType.typeName() != "map"]))
         .write.mode("overwrite").partitionBy("bucket").parquet(folder))
        held = {r.bucket: r.n for r in self.spark.read.schema(T.StructType(self.schema.fields + [T.StructField("bucket", T.IntegerType())]))
                .parquet(folder).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
        commit = {**commit, **{b: (new, held.get(b, 0)) for b in touched}}
        (self.spark.createDataFrame([(b, v, n) for b, (v, n) in sorted(commit.items())], COMMIT).coalesce(1)
         .write.mode("overwrite").parquet(f"{self.base}/commits/v={new}"))
        return new

    def rebuild(self, rows: DataFrame) -> int:
        """Replace everything; returns the version written."""
        return self._write(rows, {}, range(self.buckets))

    def merge(self, updates: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Rewrite the buckets that ``updates`` touch as ``how(their rows, updates)``; returns them. No updates
        write nothing. ``updates`` is read twice."""
        touched = sorted(r.b for r in updates.select(self._bucket().alias("b")).distinct().collect())   # at most ``buckets``
        if touched:
            commit = self._commit()
            old = self._read({b: commit[b] for b in touched if b in commit})
            self._write(how(old, updates), commit, touched)
        return touched

    def upsert(self, updates: DataFrame, version: str = "version") -> list[int]:
        """S7 by key: the row with the largest ``version`` of each key stays."""
        return self.merge(updates, lambda old, new: INC.upsert_latest(old, new, self.key, version))

    def replace_files(self, updates: DataFrame, record_key: str = "record_id", version: str = "version") -> list[int]:
        """S7 with stale-id removal: the newest records of each updated file (``key``) replace all it had."""
        return self.merge(updates, lambda old, new: INC.replace_files(old, new, self.key, record_key, version))
