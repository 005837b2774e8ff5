"""ST1: incremental ingestion of a file stream.

The stream keeps the md5 of each path's last version in the state store (one value a path), so a micro-batch
costs what its own files cost, however many came before: fingerprint (S2) -> newest row of each path -> paths
whose md5 differs from the state (J4) -> append their records to the store (S7). Store and state table are
append-only, partitioned by batch id: a path's live records are those of its last batch. A batch is committed by
its state part, written after its records; a retried batch gets the same changed rows from the state store and
overwrites its own two parts.

``compact`` folds the parts into a base part outside the batch numbers; a stream started on it takes its state
from there. ``ingest_batch`` is the same step for batch jobs, with the state read from the table (S6).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lectern.operators import incremental as INC
from lectern.streaming.common import start

STATE_SCHEMA = "path string, md5 string"
BASE = -1                 # the batch number of a compacted store


def _committed(spark: SparkSession, base: str, before: int | None = None) -> list[int]:
    """Ids of the committed batches (below ``before``)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(base + "/state")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    ids = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(p)
           if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(i for i in ids if before is None or i < before)


def _parts(spark: SparkSession, base: str, ids: list[int], schema: str) -> DataFrame:
    """The given batches of a table, with their ``batch`` column."""
    if not ids:
        return spark.createDataFrame([], schema + ", batch long")
    return (spark.read.schema(schema + ", batch long").option("basePath", base)
            .parquet(*[f"{base}/batch={i}" for i in ids]))


def live_state(spark: SparkSession, base: str, before: int | None = None) -> DataFrame:
    """(path, md5, batch) of the last ingested version of each path."""
    s = _parts(spark, base + "/state", _committed(spark, base, before), STATE_SCHEMA)
    return s.groupBy("path").agg(F.max_by("md5", "batch").alias("md5"), F.max("batch").alias("batch"))


def live_records(spark: SparkSession, base: str, record_schema: str) -> DataFrame:
    """The records of each path's last version."""
    ids = _committed(spark, base)
    store = _parts(spark, base + "/store", ids, record_schema)
    return store.join(live_state(spark, base).select("path", "batch"), ["path", "batch"], "left_semi").drop("batch")


def _write(changed: DataFrame, base: str, batch_id: int, to_records: Callable[[DataFrame, int], DataFrame]) -> None:
    to_records(changed, batch_id + 1).write.mode("overwrite").parquet(f"{base}/store/batch={batch_id}")
    changed.select("path", "md5").write.mode("overwrite").parquet(f"{base}/state/batch={batch_id}")


def ingest_batch(base: str, to_records: Callable[[DataFrame, int], DataFrame], order: str):
    """A batch job's step, and a ``foreachBatch`` body; ``to_records(files, version)`` builds store rows. If a batch
    holds a path more than once, the row with the largest ``order`` counts."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        files = INC.fingerprint(INC.newest(batch, "path", order))
        changed = INC.changed_files(files, live_state(spark, base, before=batch_id)).cache()
        _write(changed, base, batch_id, to_records)
        changed.unpersist()
    return run


class ChangedFiles(StatefulProcessor):
    """One path: lets the newest row of a micro-batch through if its md5 is not that of the last version."""

    def __init__(self, order: str) -> None:
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.md5 = handle.getValueState("md5", "md5 string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.md5.update((initialState["md5"].iloc[0],))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest, best = None, None
        for pdf in rows:
            top = pdf.sort_values([self.order, "md5"]).iloc[-1:]
            rank = (top[self.order].iloc[0], str(top["md5"].iloc[0]))
            if best is None or rank > best:
                newest, best = top, rank
        held = self.md5.get()
        if newest is not None and (held is None or held[0] != newest["md5"].iloc[0]):
            self.md5.update((newest["md5"].iloc[0],))
            yield newest

    def close(self) -> None:
        pass


def changed_stream(files: DataFrame, known: DataFrame, order: str) -> DataFrame:
    """The rows of a file stream ``(path, text, ...)`` whose content is new for their path, with ``md5``. ``known``
    (path, md5) is what the state holds before the first batch."""
    f = INC.fingerprint(files)
    return f.groupBy("path").transformWithStateInPandas(ChangedFiles(order), f.schema, "Append", "None",
                                                        initialState=known.select("path", "md5").groupBy("path"))


def compact(spark: SparkSession, base: str, target: str, record_schema: str) -> None:
    """Write the live records and state as the base part of a new folder; a stream started there goes on from it."""
    live_records(spark, base, record_schema).write.mode("overwrite").parquet(f"{target}/store/batch={BASE}")
    live_state(spark, base).select("path", "md5").write.mode("overwrite").parquet(f"{target}/state/batch={BASE}")


def run_ingest(files_stream: DataFrame, base: str, to_records, record_schema: str, order: str = "doc_id") -> DataFrame:
    """Take in all that the stream has now; returns the live records. A folder whose batches have no checkpoint of
    theirs is refused, as a new stream would number its batches from 0 again: compact it first."""
    spark = files_stream.sparkSession
    jvm = spark.sparkContext._jvm
    checkpoint = jvm.org.apache.hadoop.fs.Path(base + "/_checkpoint/offsets")
    fs = checkpoint.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(checkpoint) and any(i > BASE for i in _committed(spark, base)):
        raise RuntimeError(f"{base} holds batches but no checkpoint: compact it into a new folder")
    known = _parts(spark, base + "/state", [i for i in _committed(spark, base) if i == BASE], STATE_SCHEMA)

    def run(changed: DataFrame, batch_id: int) -> None:
        changed = changed.persist()
        _write(changed, base, batch_id, to_records)
        changed.unpersist()

    q = start(changed_stream(files_stream, known, order).writeStream.foreachBatch(run)
              .option("checkpointLocation", base + "/_checkpoint").trigger(availableNow=True), spark)
    q.awaitTermination()
    return live_records(spark, base, record_schema)
