"""W6 against a direct fold; ST1-ST3 streaming equals the batch operators."""

import random

from pyspark.sql import functions as F

from lectern.operators import cache as CA
from lectern.registry import QUERIES
from tests.conftest import SF_SMALL


def fold(events, ttl):
    out, anchor = {}, {}
    for eid, key, t in sorted(events, key=lambda e: (e[1], e[2], e[0])):
        a = anchor.get(key)
        if a is not None and t < a + ttl:
            out[eid] = (True, a)
        else:
            anchor[key] = t
            out[eid] = (False, t)
    return out


def test_replay_matches_fold(spark):
    rng = random.Random(3)
    ev = [(i, f"k{rng.randint(0, 4)}", rng.randint(0, 10_000)) for i in range(3000)]
    df = spark.createDataFrame(ev, "event_id long, key string, t long").select(
        "event_id", "key", F.timestamp_seconds("t").alias("ts"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")  # keys straddle batches
    try:
        got = {r["event_id"]: (r["hit"], r["stored_at_us"] // 1_000_000) for r in CA.replay(df, 500).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == fold(ev, 500)


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_stream_cache_equals_batch(spark):
    cols = ["event_id", "hit", "stored_at_us"]
    assert _rows(QUERIES["stream_cache"](spark, SF_SMALL), cols) == _rows(QUERIES["cache_replay"](spark, SF_SMALL), cols)


def test_stream_history_equals_batch(spark):
    from lectern.operators import history as HI
    from lectern.sources.tables import load
    m = load(spark, SF_SMALL, "conversations")
    batch = HI.previous_messages(m, 5, targets=m.where("role = 'user'").select("conv_id", "turn"))
    batch = batch.select("conv_id", "turn", F.size("history").cast("long").alias("n_hist"),
                         F.array_join(HI.history_lines(F.col("history"), ""), "\n").alias("history_text"))
    cols = ["conv_id", "turn", "n_hist", "history_text"]
    assert _rows(QUERIES["stream_history"](spark, SF_SMALL), cols) == _rows(batch, cols)


def _stream_of(spark, parts, folder):
    """A file stream that takes one part a micro-batch, in the order of their modification."""
    import os
    import time
    for k, df in enumerate(parts):
        df.coalesce(1).write.parquet(f"{folder}/p{k}")
        for f in os.listdir(f"{folder}/p{k}"):
            if f.endswith(".parquet"):
                os.utime(f"{folder}/p{k}/{f}", (time.time() - 1000 + k, time.time() - 1000 + k))
    return (spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", "true").parquet(folder))


def test_stream_cache_keeps_late_events(spark, tmp_path):
    from lectern.streaming import cache_stream, common
    schema = "event_id long, key string, t long"
    parts = [spark.createDataFrame(x, schema).select("event_id", "key", F.timestamp_seconds("t").alias("ts"))
             for x in ([(1, "a", 100_000), (2, "a", 100_050)], [(3, "a", 100), (4, "a", 100_060), (5, "b", 5)])]
    out = common.run_to_parquet(cache_stream.cache_stream(_stream_of(spark, parts, str(tmp_path / "in")), 500), spark, "late")
    got = {r.event_id: (r.hit, r.stored_at_us // 1_000_000, r.late) for r in out.collect()}
    assert got == {1: (False, 100_000, False), 2: (True, 100_000, False), 3: (False, 100, True),
                   4: (True, 100_000, False), 5: (False, 5, False)}


def test_ingest_batches_append_and_retry(spark, tmp_path):
    from lectern import registry as R
    from lectern.streaming import ingest_stream as I
    schema = "doc_id long, path string, text string"
    one = spark.createDataFrame([(1, "p.pdf", "a\nb"), (2, "q.pdf", "c")], schema)
    two = spark.createDataFrame([(3, "p.pdf", "old"), (4, "p.pdf", "a2"), (5, "q.pdf", "c")], schema)
    base = str(tmp_path / "store")
    run = I.ingest_batch(base, R._records, "doc_id")
    run(one, 0)
    run(two, 1)
    run(two, 1)                      # a retried batch reads only earlier ones and rewrites its own part
    got = sorted((r.record_id, r.version) for r in I.live_records(spark, base, R._RECORD_SCHEMA).collect())
    assert got == [("p.pdf#1", 2), ("q.pdf#1", 1)]      # newest row of a path; the stale p.pdf#2 is gone
    assert spark.read.parquet(f"{base}/store/batch=1").count() == 1     # the unchanged file is not written again
    I.compact(spark, base, str(tmp_path / "compact"), R._RECORD_SCHEMA)
    assert sorted(r.record_id for r in I.live_records(spark, str(tmp_path / "compact"), R._RECORD_SCHEMA).collect()) == \
        ["p.pdf#1", "q.pdf#1"]


def test_replace_files_takes_the_newest_version_of_a_path(spark):
    from lectern.operators import incremental as INC
    schema = "record_id string, path string, version long"
    store = spark.createDataFrame([("p#1", "p", 1), ("p#2", "p", 1), ("q#1", "q", 1)], schema)
    updates = spark.createDataFrame([("p#1", "p", 2), ("p#2", "p", 2), ("p#1", "p", 3), ("p#1", "p", 3)], schema)
    got = sorted(tuple(r) for r in INC.replace_files(store, updates).select("record_id", "version").collect())
    assert got == [("p#1", 3), ("q#1", 1)]
    assert sorted(tuple(r) for r in INC.upsert_latest(store, updates, "record_id").select("record_id", "version").collect()) \
        == [("p#1", 3), ("p#2", 2), ("q#1", 1)]


def test_lookup_returns_one_row_for_several_live_entries(spark):
    req = spark.createDataFrame([(1, "a", 100)], "event_id long, key string, t long") \
        .select("event_id", "key", F.timestamp_seconds("t").alias("ts"))
    cache = spark.createDataFrame([("a", 10, 150, "old"), ("a", 50, 150, "new")],
                                  "key string, s long, e long, response string") \
        .select("key", F.timestamp_seconds("s").alias("stored_at"), F.timestamp_seconds("e").alias("expires_at"), "response")
    assert [(r.hit, r.response) for r in CA.lookup(req, cache).collect()] == [(True, "new")]


def test_stream_ingest_equals_batch_store(spark):
    from lectern import registry as R
    from lectern.functions import paths as P
    files = R.fx.file_paths(spark, SF_SMALL).where(P.is_document_path(F.col("path")))
    batch = R._records(files, 1).select("record_id", "version", "content_md5")
    cols = ["record_id", "version", "content_md5"]
    assert _rows(QUERIES["stream_ingest"](spark, SF_SMALL), cols) == _rows(batch, cols)


def test_lookup_respects_expiry(spark):
    req = spark.createDataFrame([(1, "a", 100), (2, "a", 200), (3, "b", 150)], "event_id long, key string, t long") \
        .select("event_id", "key", F.timestamp_seconds("t").alias("ts"))
    cache = spark.createDataFrame([("a", 50, 150, "x"), ("b", 10, 160, None)],
                                  "key string, s long, e long, response string") \
        .select("key", F.timestamp_seconds("s").alias("stored_at"), F.timestamp_seconds("e").alias("expires_at"),
                "response")
    got = {r["event_id"]: r["hit"] for r in CA.lookup(req, cache).collect()}
    assert got == {1: True, 2: False, 3: False}  # F8: empty response is a miss
