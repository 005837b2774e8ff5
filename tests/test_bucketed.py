"""The bucketed store: touched buckets only, retries, readers that have begun."""

import os

import pytest

from lectern.sources.bucketed import BucketedStore

SCHEMA = "record_id string, path string, version long, text string"


def rows(spark, items):
    return spark.createDataFrame(items, SCHEMA)


def content(store):
    return sorted(tuple(r) for r in store.read().collect())


def test_upsert_rewrites_only_touched_buckets(spark, tmp_path):
    store = BucketedStore(spark, str(tmp_path / "s"), SCHEMA, "record_id", 16)
    assert content(store) == [] and store.count() == 0
    store.rebuild(rows(spark, [(f"r{i}", "p", 1, "a") for i in range(200)]))
    before = store._commit()
    touched = store.upsert(rows(spark, [("r3", "p", 2, "b"), ("r3", "p", 0, "old"), ("new", "p", 1, "c")]))
    assert 1 <= len(touched) <= 2
    written = {int(d.split("=")[1]) for d in os.listdir(f"{store.base}/data/v=2") if d.startswith("bucket=")}
    assert written == set(touched)
    assert {b: v for b, v in store._commit().items() if b not in touched} == {b: v for b, v in before.items() if b not in touched}
    got = {r[0]: r[2:] for r in content(store)}
    assert got["r3"] == (2, "b") and got["new"] == (1, "c") and len(got) == 201 and store.count() == 201


def test_a_failed_write_is_not_seen_and_its_retry_overwrites_it(spark, tmp_path, monkeypatch):
    store = BucketedStore(spark, str(tmp_path / "s"), SCHEMA, "path", 8)
    store.rebuild(rows(spark, [("p#1", "p", 1, "a"), ("p#2", "p", 1, "b"), ("q#1", "q", 1, "c")]))
    reader = store.read()
    real = spark.createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
    update = real([("p#1", "p", 2, "a2")], SCHEMA)
    with pytest.raises(OSError):
        store.replace_files(update)                       # the data is there, the commit is not
    monkeypatch.undo()
    assert store.count() == 3 and len(content(store)) == 3
    store.replace_files(update)
    assert content(store) == [("p#1", "p", 2, "a2"), ("q#1", "q", 1, "c")]
    assert reader.count() == 3                            # files of the earlier version are still there


def test_a_file_can_vanish_and_no_update_writes_nothing(spark, tmp_path):
    store = BucketedStore(spark, str(tmp_path / "s"), SCHEMA, "path", 4)
    store.rebuild(rows(spark, [("p#1", "p", 1, "a")]))
    assert store.merge(rows(spark, []), lambda old, new: old) == []
    store.merge(rows(spark, [("p#1", "p", 2, "x")]), lambda old, new: old.limit(0))
    assert content(store) == [] and store.count() == 0


def test_equal_versions_of_a_record_keep_the_same_row(spark, tmp_path):
    from lectern.operators import incremental as INC
    store = rows(spark, [("p#1", "p", 1, "a")])
    for order in (["x", "y"], ["y", "x"]):
        new = rows(spark, [("p#1", "p", 2, t) for t in order]).repartition(2)
        assert [r.text for r in INC.replace_files(store, new).collect()] == ["y"]
