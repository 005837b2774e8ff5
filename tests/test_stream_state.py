"""The streams' state: restart from a checkpoint, expiry, compaction, retried batches."""

import os
import time

import pytest
from pyspark.sql import functions as F

from lectern import registry as R
from lectern.streaming import cache_stream, common, history_stream, ingest_stream as I

FILES = "doc_id long, path string, text string"


def land(df, folder, name):
    """One file appears in a landing folder at once."""
    tmp = f"{folder}-{name}"
    df.coalesce(1).write.parquet(tmp)
    os.makedirs(folder, exist_ok=True)
    src = next(f for f in os.listdir(tmp) if f.endswith(".parquet"))
    os.rename(f"{tmp}/{src}", f"{folder}/{name}.parquet")


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).parquet(folder)


def run_once(df, folder):
    q = (df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", folder + "/_c")
         .option("path", folder + "/out").trigger(availableNow=True).start())
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(folder + "/out")


def events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, key string, t long").select("event_id", "key", F.timestamp_seconds("t").alias("ts"))


def test_cache_and_history_go_on_from_a_checkpoint(spark, tmp_path):
    e = str(tmp_path / "e")
    land(events(spark, [(1, "a", 100), (2, "b", 100)]), e, "p0")
    jobs = cache_stream.cache_stream(stream(spark, e, "event_id long, key string, ts timestamp"), 50)
    run_once(jobs, str(tmp_path / "c"))
    land(events(spark, [(3, "a", 120), (4, "a", 150), (5, "c", 1)]), e, "p1")
    jobs = cache_stream.cache_stream(stream(spark, e, "event_id long, key string, ts timestamp"), 50)     # a new query, the old checkpoint
    got = {r.event_id: (r.hit, r.stored_at_us // 1_000_000) for r in run_once(jobs, str(tmp_path / "c")).collect()}
    assert got == {1: (False, 100), 2: (False, 100), 3: (True, 100), 4: (False, 150), 5: (False, 1)}

    m, schema = str(tmp_path / "m"), "conv_id long, turn int, role string, text string"
    land(spark.createDataFrame([(1, 0, "user", "q0"), (1, 1, "assistant", "a0"), (1, 2, "user", "q1")], schema), m, "p0")
    run_once(history_stream.history_stream(stream(spark, m, schema), 2), str(tmp_path / "h"))
    land(spark.createDataFrame([(1, 3, "assistant", "a1"), (1, 4, "user", "q2")], schema), m, "p1")
    got = {r.turn: (r.n_hist, r.history_text) for r in run_once(history_stream.history_stream(stream(spark, m, schema), 2), str(tmp_path / "h")).collect()}
    assert got[0] == (0, "") and got[2][0] == 2 and got[4][0] == 2
    assert got[4][1].endswith("q1\nAssistant: a1") or ("q1" in got[4][1] and "a1" in got[4][1] and "a0" not in got[4][1])


def follow(df, seen):
    """A running query whose rows are gathered; processing time goes on without data."""
    def keep(batch, _):
        seen.extend(batch.collect())
    return df.writeStream.foreachBatch(keep).trigger(processingTime="300 milliseconds").start()


def wait(seen, n):
    end = time.time() + 60
    while len(seen) < n and time.time() < end:
        time.sleep(0.2)
    assert len(seen) >= n


@pytest.mark.parametrize("keep", [2, 3600])
def test_state_of_silent_keys_expires(spark, tmp_path, keep):
    m, schema = str(tmp_path / "m"), "conv_id long, turn int, role string, text string"
    e = str(tmp_path / "e")
    land(spark.createDataFrame([(1, 0, "user", "q0")], schema), m, "p0")
    land(events(spark, [(1, "a", 100)]), e, "p0")
    history, cache = [], []
    one = follow(history_stream.history_stream(stream(spark, m, schema), 5, keep), history)
    two = follow(cache_stream.cache_stream(stream(spark, e, "event_id long, key string, ts timestamp"), 50, keep), cache)
    try:
        wait(history, 1)
        wait(cache, 1)
        time.sleep(4)
        land(spark.createDataFrame([(1, 1, "user", "q1")], schema), m, "p1")
        land(events(spark, [(2, "a", 120)]), e, "p1")
        wait(history, 2)
        wait(cache, 2)
    finally:
        one.stop()
        two.stop()
    assert {r.turn: r.n_hist for r in history} == {0: 0, 1: 0 if keep == 2 else 1}
    assert {r.event_id: r.hit for r in cache} == {1: False, 2: keep != 2}


def records(spark, base):
    return sorted((r.record_id, r.content_md5) for r in I.live_records(spark, base, R._RECORD_SCHEMA).select("record_id", "content_md5").collect())


def test_ingest_goes_on_after_a_restart_and_after_compaction(spark, tmp_path):
    land_at, base, folded = str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "folded")
    land(spark.createDataFrame([(1, "p.pdf", "a\nb"), (2, "q.pdf", "c"), (3, "r.pdf", "d")], FILES), land_at, "p0")
    I.run_ingest(stream(spark, land_at, FILES), base, R._records, R._RECORD_SCHEMA)
    land(spark.createDataFrame([(4, "p.pdf", "x"), (5, "q.pdf", "c"), (6, "p.pdf", "a2")], FILES), land_at, "p1")
    I.run_ingest(stream(spark, land_at, FILES), base, R._records, R._RECORD_SCHEMA)           # restart: state from the checkpoint
    after = records(spark, base)
    assert [r for r, _ in after] == ["p.pdf#1", "q.pdf#1", "r.pdf#1"]
    assert spark.read.parquet(f"{base}/state/batch=1").count() == 1                           # q.pdf was known
    I.compact(spark, base, folded, R._RECORD_SCHEMA)
    assert records(spark, folded) == after
    new_at = str(tmp_path / "new")
    land(spark.createDataFrame([(7, "q.pdf", "c"), (8, "s.pdf", "e"), (9, "r.pdf", "d2\nd3")], FILES), new_at, "p0")
    I.run_ingest(stream(spark, new_at, FILES), folded, R._records, R._RECORD_SCHEMA)          # a new stream on the compacted store
    assert [r for r, _ in records(spark, folded)] == ["p.pdf#1", "q.pdf#1", "r.pdf#1", "r.pdf#2", "s.pdf#1"]
    assert sorted(r.path for r in spark.read.parquet(f"{folded}/state/batch=0").collect()) == ["r.pdf", "s.pdf"]
    again = str(tmp_path / "again")
    I.compact(spark, folded, again, R._RECORD_SCHEMA)
    assert records(spark, again) == records(spark, folded)


def test_batches_without_their_checkpoint_are_refused(spark, tmp_path):
    base, land_at = str(tmp_path / "store"), str(tmp_path / "in")
    I.ingest_batch(base, R._records, "doc_id")(spark.createDataFrame([(1, "p.pdf", "a")], FILES), 0)
    land(spark.createDataFrame([(2, "q.pdf", "b")], FILES), land_at, "p0")
    with pytest.raises(RuntimeError, match="compact"):
        I.run_ingest(stream(spark, land_at, FILES), base, R._records, R._RECORD_SCHEMA)
    assert [r for r, _ in records(spark, base)] == ["p.pdf#1"]
