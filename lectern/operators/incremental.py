"""Incremental ingestion as table operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprint(files: DataFrame, content: str = "text") -> DataFrame:
    """MD5 of each file's content."""
    return files.withColumn("md5", F.md5(F.col(content)))


def newest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key: the one with the largest ``order`` (combined map-side, so a hot key is one row a task)."""
    cols = rows.columns
    return (rows.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*cols), F.col(order)).alias("_r"))
            .select("_r.*"))


def changed_files(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files whose (path, md5) is not in the ingestion state (new or changed)."""
    return files.join(state.select("path", "md5"), ["path", "md5"], "left_anti")


def upsert_latest(store: DataFrame, updates: DataFrame, key: str, version: str = "version") -> DataFrame:
    """S7 (plain keyed upsert): union, keep the newest version per key."""
    return newest(store.unionByName(updates, allowMissingColumns=True), key, version)


def replace_files(store: DataFrame, updates: DataFrame, file_key: str = "path", record_key: str = "record_id",
                  version: str = "version") -> DataFrame:
    """S7 with stale-id removal (T4): every record of a re-ingested file is replaced by that file's
    newest records; other files keep theirs. Updates may hold several versions of a file. Of rows with
    equal version and record id the greatest by content counts, so that a retry keeps the same one."""
    last = updates.groupBy(file_key).agg(F.max(version).alias("_last"))
    content = [f.name for f in updates.schema.fields if f.dataType.typeName() != "map"]
    kept = (updates.join(last, file_key).where(F.col(version) == F.col("_last")).drop("_last")
            .withColumn("_content", F.struct(*content)))
    kept = newest(kept, record_key, "_content").drop("_content")
    return store.join(last, file_key, "left_anti").unionByName(kept, allowMissingColumns=True)


def batch_counts(n_col, batch: int = 32):
    """A10: number of embedding batches for n records."""
    return F.ceil(n_col / F.lit(batch)).cast("long")
