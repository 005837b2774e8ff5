"""W6 and J3 on keys that many tasks share, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import cache as CA


@pytest.fixture
def many_parts(spark):
    """No coalescing, so that small tables really span all shuffle partitions."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


def plain_replay(rows, ttl):
    out, anchor = [], {}
    for i, key, t in sorted(rows, key=lambda r: (str(r[1]), r[2], r[0])):
        hit = key in anchor and t < anchor[key] + ttl
        if not hit:
            anchor[key] = t
        out.append((i, hit, anchor[key] * 1_000_000))
    return sorted(out)


@pytest.mark.parametrize("span,ttl", [(3000, 100), (100_000, 100), (400, 1000), (900, 1)])
def test_one_key_over_many_tasks_equals_the_fold(spark, many_parts, span, ttl):
    rng = random.Random(span)
    rows = [(i, "hot" if rng.random() < 0.8 else f"k{rng.randrange(5)}", rng.randrange(span)) for i in range(1500)]
    req = spark.createDataFrame(rows, "event_id long, key string, ts long")
    for hot in (10, 10**9):                       # every key split; every key folded
        got = CA.replay(req, ttl, hot=hot).select("event_id", "hit", "stored_at_us").collect()
        assert sorted(map(tuple, got)) == plain_replay(rows, ttl)


def test_hot_misses_take_a_round_a_doubling(spark, many_parts):
    times = spark.range(4000).select(F.lit("k").alias("key"), (F.col("id") * 7).alias("t_us"))
    got = sorted(r.t_us for r in CA.hot_misses(times, 100).collect())
    want, t = [], 0
    while t < 28_000:
        want.append(t)
        t = -(-(t + 100) // 7) * 7
    assert got == [x for x in want if x < 28_000]


def plain_lookup(requests, entries):
    out = []
    for i, key, t in requests:
        live = [(s, x, r) for k, s, x, r in entries if k == key and k is not None and r is not None and t is not None and s <= t < x]
        best = max(live, default=None)
        out.append((i, best and best[0], best and best[1], best and best[2], best is not None))
    return sorted(out)


@pytest.mark.parametrize("keys,ttl", [(1, (50, 51)), (1, (1, 3000)), (40, (1, 600))])
def test_last_live_entry_of_a_key_over_many_tasks(spark, many_parts, keys, ttl):
    """Entries of one or of very different lives: an old one may outlive those stored after it."""
    rng = random.Random(keys + ttl[1])
    entries = []
    for i in range(700):
        s = rng.randrange(3000)
        entries.append((f"k{rng.randrange(keys)}", s, s + rng.randrange(*ttl), f"r{i}" if rng.random() < 0.95 else None))
    entries += [(None, 0, 5000, "none"), ("k0", 100, 100, "never"), ("k0", 5, 4000, "long")]
    requests = [(i, f"k{rng.randrange(keys + 1)}", rng.randrange(3200)) for i in range(900)] + [(9000, None, 10), (9001, "k0", None), (9002, "k0", -5)]
    cache = spark.createDataFrame(entries, "key string, stored_at long, expires_at long, response string")
    req = spark.createDataFrame(requests, "event_id long, key string, ts long")
    got = CA.lookup(req, cache).select("event_id", "stored_at", "expires_at", "response", "hit").collect()
    assert sorted(map(tuple, got)) == plain_lookup(requests, entries)


def test_lookup_reads_each_request_once(spark, many_parts):
    """No row a (request, entry) pair: the plan joins nothing on the key alone but the parts' few open entries."""
    req = spark.range(2000).select(F.col("id").alias("event_id"), F.lit("k").alias("key"), F.col("id").alias("ts"))
    cache = spark.range(2000).select(F.lit("k").alias("key"), F.col("id").alias("stored_at"), (F.col("id") + 50).alias("expires_at"),
                                     F.lit("r").alias("response"))
    got = CA.lookup(req, cache)
    assert got.count() == 2000 and got.where("hit AND stored_at = ts").count() == 2000


def test_empty_sides(spark):
    req = spark.createDataFrame([(1, "a", 5)], "event_id long, key string, ts long")
    cache = spark.createDataFrame([("a", 0, 9, "x")], "key string, stored_at long, expires_at long, response string")
    assert [r.hit for r in CA.lookup(req, cache.limit(0)).collect()] == [False]
    assert CA.lookup(req.limit(0), cache).collect() == []
    assert CA.replay(req.limit(0), 10).collect() == []
