"""TTL response cache as data operators.

W6 replay rule (per key, requests ordered by time then id): a request is a
hit iff an unexpired stored answer exists, i.e. ``t < anchor + ttl`` where the
anchor is the time of the last miss; a hit does not renew; a miss stores.
This is a fold whose state is one timestamp, so it is not expressible with
``lag``. Rows are hash-partitioned by key and sorted by Spark's external sort;
each task then streams its keys in order (state = one anchor per key, memory
O(batch)), jumping from miss to miss with ``searchsorted``. A key with more
requests than one task should read is split: pointers from each request time to
the next possible miss, doubled, mark the misses, and an as-of join tells every
request the miss before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.session import materialise

HOT = 5_000_000           # requests of a key that one task folds, at most


def _fold(ttl_us: int):
    def run(batches):
        carry_key, anchor = None, None
        for rb in batches:
            n = rb.num_rows
            if n == 0:
                continue
            keys = rb.column("key").to_pylist()
            t = rb.column("t_us").to_numpy(zero_copy_only=False).astype(np.int64)
            hit = np.zeros(n, np.bool_)
            stored = np.empty(n, np.int64)
            i = 0
            while i < n:
                j = i
                k = keys[i]
                while j < n and keys[j] == k:
                    j += 1
                a = anchor if k == carry_key else None
                seg = t[i:j]
                miss_idx = []
                pos = 0
                while pos < len(seg):
                    if a is not None and seg[pos] < a + ttl_us:
                        # hits up to the first event at/after expiry
                        pos = int(np.searchsorted(seg, a + ttl_us, side="left"))
                        continue
                    a = int(seg[pos])
                    miss_idx.append(pos)
                    pos += 1
                h = np.ones(len(seg), np.bool_)
                mi = np.array(miss_idx, np.int64)
                h[mi] = False
                # anchor in force at each row: last miss at or before it, else the carried anchor
                last = np.full(len(seg), -1, np.int64)
                last[mi] = mi
                last = np.maximum.accumulate(last)
                st = np.where(last >= 0, seg[np.maximum(last, 0)], anchor if k == carry_key and anchor is not None else 0)
                hit[i:j] = h
                stored[i:j] = st
                carry_key, anchor = k, a
                i = j
            yield pa.RecordBatch.from_arrays(
                [rb.column("event_id"), rb.column("key"), rb.column("t_us"), pa.array(hit), pa.array(stored)],
                names=["event_id", "key", "t_us", "hit", "stored_at_us"])
    return run


def replay(requests: DataFrame, ttl_seconds: int, key: str = "key", ts: str = "ts", rid: str = "event_id",
           hot: int = HOT) -> DataFrame:
    """``(rid, key, ts)`` -> ``event_id, key, t_us, hit, stored_at_us`` (the
    store that answered a hit, or the row's own time for a miss).

    Keys of up to ``hot`` requests are folded a key at a time; the misses of larger ones are found by
    :func:`hot_misses`, whose tasks share a key. Both give the same rows."""
    ttl = int(ttl_seconds) * 1_000_000
    r = requests.select(F.col(rid).alias("event_id"), F.col(key).cast("string").alias("key"),
                        F.unix_micros(F.col(ts).cast("timestamp")).alias("t_us"))
    timed = r.where("key IS NOT NULL AND t_us IS NOT NULL")
    crowded = materialise(timed.groupBy(F.col("key").alias("_hot")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("_hot"),
                          "hot-keys")
    if not crowded.limit(1).count():
        return _folded(r, ttl)
    # fewer than (rows / hot) keys: the list stays small against the requests
    few = r.join(crowded, (F.col("key") == F.col("_hot")) & F.col("t_us").isNotNull(), "left_anti")
    many = materialise(timed.join(crowded, F.col("key") == F.col("_hot"), "left_semi"), "hot-requests")
    misses = hot_misses(many, ttl)
    last = nearest_before(many, misses, "key", "t_us", F.col("t_us"))
    first = many.groupBy("key", "t_us").agg(F.min("event_id").alias("_first"))
    own = first.join(misses, ["key", "t_us"], "left_semi")
    # (key, time) is as fine as the requests themselves: no key is a hot one here
    told = (last.join(own, ["key", "t_us"], "left")
            .select("event_id", "key", "t_us", F.coalesce(F.col("event_id") != F.col("_first"), F.lit(True)).alias("hit"),
                    F.col("found").alias("stored_at_us")))
    return _folded(few, ttl).unionByName(told)


def _folded(r: DataFrame, ttl_us: int) -> DataFrame:
    r = r.repartition("key").sortWithinPartitions("key", "t_us", "event_id")
    return r.mapInArrow(_fold(ttl_us),
                        f"event_id {r.schema['event_id'].dataType.simpleString()}, key string, t_us long, hit boolean, stored_at_us long")


def hot_misses(requests: DataFrame, ttl_us: int) -> DataFrame:
    """``(key, t_us)`` of the misses, for keys of any number of requests.

    The miss after one at t is the key's first request at or after t + ttl: a pointer that every request time has
    on its own, found by an as-of join. Pointers are doubled until none is left; the misses are what the key's
    first request reaches, followed through the doubled tables from the longest step to the shortest."""
    times = materialise(requests.select("key", "t_us").distinct(), "times")
    step = (nearest_before(times, times.select("key", (-F.col("t_us")).alias("t_us")), "key", "t_us", -(F.col("t_us") + F.lit(ttl_us)))
            .select("key", "t_us", (-F.col("found")).alias("to")).where("to IS NOT NULL"))
    tables = []
    while True:
        step = materialise(step, "jumps")
        if not step.limit(1).count():
            break
        tables.append(step)
        far = step.select("key", F.col("t_us").alias("to"), F.col("to").alias("_to"))
        step = step.join(far, ["key", "to"]).select("key", "t_us", F.col("_to").alias("to"))
    misses = times.groupBy("key").agg(F.min("t_us").alias("t_us"))
    for table in reversed(tables):
        misses = materialise(misses.union(misses.join(table, ["key", "t_us"]).select("key", F.col("to").alias("t_us"))), "misses")
    return misses


def nearest_before(asks: DataFrame, events: DataFrame, key: str, t: str, at: Column) -> DataFrame:
    """``asks`` with ``found``: the largest ``events.t`` of its key that is not above ``at`` (a column of asks), or null.

    Both sides are sorted together by range partitions, so a key may span any number of them. What lies before
    a partition comes from one number a (partition, key), not from the rows."""
    rows = [F.struct(*asks.columns).alias("_a"), F.col(key).alias("_k"), at.alias("_t"), F.lit(1).alias("_kind")]
    u = asks.select(*rows)
    none = F.lit(None).cast(u.schema["_a"].dataType).alias("_a")
    u = u.unionByName(events.select(none, F.col(key).alias("_k"), F.col(t).alias("_t"), F.lit(0).alias("_kind")))
    u = u.withColumn("_tie", F.xxhash64("_a")).repartitionByRange("_k", "_t", "_kind", "_tie")
    u = materialise(u.withColumn("_part", F.spark_partition_id()), "asof")
    event = F.when(F.col("_kind") == 0, F.col("_t"))
    within = Window.partitionBy("_part", "_k").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    ends = u.groupBy("_k", "_part").agg(F.max(event).alias("_m"))
    carry = ends.select("_k", "_part", F.max("_m").over(Window.partitionBy("_k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_c"))
    return (u.withColumn("_f", F.max(event).over(within)).where("_kind = 1").join(carry.where("_c IS NOT NULL"), ["_part", "_k"], "left")
            .select("_a.*", F.coalesce("_f", "_c").alias("found")))


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole parts, sorted by (key, time), entries before requests: the last live entry of each request."""
    held: list[pa.RecordBatch] = []
    now = None

    def finish() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        n = t.num_rows
        keys = t.column("_k").combine_chunks()
        new = np.ones(n, bool)
        new[1:] = ~pc.equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
        time, entry = t.column("_t").to_numpy(), t.column("_kind").to_numpy() == 0
        until = t.column("_x").to_numpy()
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        before = np.maximum.accumulate(np.where(entry, np.arange(n), -1))
        asks = np.flatnonzero(~entry)
        at = np.where(before[asks] >= start[asks], before[asks], -1)
        older = None
        while True:
            dead = np.flatnonzero((at >= 0) & (until[at] <= time[asks]))
            if not len(dead):
                break
            if older is None:
                older = _outliving(np.flatnonzero(entry), start, until)
            at[dead] = older[at[dead]]
        chosen = t.column("_e").combine_chunks().take(pa.array(at, mask=at < 0))
        yield from pa.table([t.column("_r").combine_chunks().take(pa.array(asks)), chosen], names=["_r", "_e"]).to_batches(10_000)

    for b in batches:
        parts = b.column("_part").to_numpy()
        cut = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
        for lo, hi in zip(cut, cut[1:]):
            if hi == lo:
                continue
            if parts[lo] != now:
                yield from finish()
                now = parts[lo]
            held.append(b.slice(lo, hi - lo))
    yield from finish()


def _outliving(entries: np.ndarray, start: np.ndarray, until: np.ndarray) -> np.ndarray:
    """For each entry row the last earlier one of its key that expires after it, or -1."""
    older = np.full(len(until), -1)
    stack: list[int] = []
    for i in entries.tolist():
        while stack and (stack[-1] < start[i] or until[stack[-1]] <= until[i]):
            stack.pop()
        older[i] = stack[-1] if stack else -1
        stack.append(i)
    return older


def lookup(requests: DataFrame, cache: DataFrame, key: str = "key", ts: str = "ts", rid: str = "event_id") -> DataFrame:
    """Request LEFT JOIN cache ON key AND stored_at <= t < expires_at; of several live entries of a key
    the one stored last answers. F8: an entry without a response value counts as a miss.

    Requests and entries are sorted together by range partitions and each partition is read once, so no request
    meets more than the entry that answers it, and a key may span any number of partitions. Entries that no later
    one of the partition outlives are copied to the partitions in which the key goes on. Columns: those of
    ``requests``, then stored_at, expires_at, response, hit; a null key or time is a miss. Of entries stored
    at the same time the one that expires last answers, then the greater response."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    r = requests.select(F.struct(*requests.columns).alias("_r"), F.col(key).cast("string").alias("_k"), micros(ts).alias("_t"))
    e = (cache.where("response IS NOT NULL AND stored_at < expires_at").where(F.col(key).isNotNull())
         .select(F.struct("stored_at", "expires_at", "response").alias("_e"), F.col(key).cast("string").alias("_k"),
                 micros("stored_at").alias("_t"), micros("expires_at").alias("_x")))
    no_r, no_e = F.lit(None).cast(r.schema["_r"].dataType), F.lit(None).cast(e.schema["_e"].dataType)
    asked = r.where("_k IS NOT NULL AND _t IS NOT NULL")
    u = (asked.select("_r", no_e.alias("_e"), "_k", "_t", F.lit(0).cast("long").alias("_x"), F.lit(1).alias("_kind"))
         .unionByName(e.select(no_r.alias("_r"), "_e", "_k", "_t", "_x", F.lit(0).alias("_kind"))))
    order = ["_k", "_t", "_kind", "_x", "_tie"]
    u = u.withColumn("_tie", F.when(F.col("_kind") == 1, F.xxhash64("_r")).otherwise(0))
    u = materialise(u.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "lookup")
    parts = u.groupBy("_part").agg(F.min(F.struct("_k", "_t")).alias("first"), F.max("_k").alias("last"))
    ends = parts.select("_part", F.col("last").alias("_k"))
    later = Window.partitionBy("_part", "_k").orderBy(F.col("_t").desc(), F.col("_x").desc()).rowsBetween(Window.unboundedPreceding, -1)
    left = (u.where("_kind = 0").join(ends, ["_part", "_k"], "left_semi").withColumn("_above", F.max("_x").over(later))
            .where("_above IS NULL OR _above < _x").drop("_above"))
    starts = parts.select(F.col("_part").alias("_p"), F.col("first._k").alias("_fk"), F.col("first._t").alias("_ft"))
    carried = (left.join(starts, (F.col("_k") == F.col("_fk")) & (F.col("_part") < F.col("_p")) & (F.col("_x") > F.col("_ft")))
               .withColumn("_part", F.col("_p")).select(*u.columns))
    rows = u.unionByName(carried).repartition("_part").sortWithinPartitions("_part", "_k", "_t", "_kind", "_x", F.col("_e.response"))
    schema = T.StructType([T.StructField("_r", r.schema["_r"].dataType), T.StructField("_e", e.schema["_e"].dataType)])
    found = rows.mapInArrow(_answers, schema).unionByName(r.where("_k IS NULL OR _t IS NULL").select("_r", no_e.alias("_e")))
    return (found.select("_r.*", "_e.stored_at", "_e.expires_at", "_e.response").withColumn("hit", F.col("expires_at").isNotNull()))
