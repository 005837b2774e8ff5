"""The kNN join and the index on blocks dealt over a grid: exact, and few copies whatever the vectors are like."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.operators import knn, vector_index
from lectern.params import DEFAULT


@pytest.mark.parametrize("after, k, floor", [(False, 3, -np.inf), (False, 8, 0.6), (True, 3, -np.inf), (True, 300, -np.inf)])
def test_nearest_equals_brute_force_with_equal_vectors(after, k, floor):
    rng = np.random.default_rng(0)
    q = rng.integers(0, 5, size=(300, 16)).astype(float)
    q[7] = 0
    c = np.concatenate([q, q[:100], np.repeat(q[5:6], 300, 0)])
    ids = rng.permutation(len(c))
    near = knn.Nearest(q, pa.array(ids[:300]), k, floor, True, after)
    for lo in range(0, len(c), 90):
        near.offer(c[lo:lo + 90], pa.array(ids[lo:lo + 90]))
    got = sorted((a, b, round(s, 9)) for x in near.found() for a, b, s in zip(*(y.to_pylist() for y in x)))
    with np.errstate(all="ignore"):
        qn, cn = (np.sqrt((m * m).sum(axis=1)) for m in (q, c))
        x, y = (q, c) if after else (q / qn[:, None], c / cn[:, None])
        sims = np.stack([np.einsum("ij,ij->i", np.broadcast_to(v, y.shape), y) for v in x])
        sims = sims / (qn[:, None] * cn) if after else sims
    sims[(ids[:300, None] == ids) | ~(sims >= floor)] = np.nan
    r, j = knn._best(sims, ids, k)
    assert got == sorted((int(ids[a]), int(ids[b]), round(float(sims[a, b]), 9)) for a, b in zip(r, j))


def test_a_block_is_copied_to_one_side_of_the_grid(spark):
    block = "key string, dim int, ids array<long>, data binary"
    stored = spark.createDataFrame([("hot", 4, [i], b"0") for i in range(200)] + [("one", 4, [0], b"0")], block)
    asked = spark.createDataFrame([("hot", 4, [i], b"0") for i in range(100)] + [("one", 4, [0], b"0"), ("none", 4, [0], b"0")], block)
    q, c = (x.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("_row", "_col").alias("cells")).collect()
            for x in knn.grid(asked, stored, ["key", "dim"]))
    assert sorted((r.key, r.n) for r in q) == [("hot", 100 * knn.COLUMNS), ("one", 1)]
    assert sorted((r.key, r.n) for r in c) == [("hot", 200 * knn.ROWS), ("one", 1)]
    assert {r.cells for r in c} == {1, knn.ROWS * knn.COLUMNS}


def test_written_blocks_are_small_and_sized_without_their_vectors(spark, monkeypatch):
    x = np.random.default_rng(5).integers(0, 9, size=(3000, 64)).astype(float)
    rows = spark.createDataFrame([(f"c{i}", v.tolist()) for i, v in enumerate(x)], "chunk_id string, embedding array<double>").coalesce(2).cache()
    asks = rows.where("hash(chunk_id) % 10 = 0").withColumnRenamed("chunk_id", "query_id")
    written, sizes, real = {}, [], knn.materialise

    def spy(df, name):
        if name == "knn-cells":
            sizes.append(df._jdf.queryExecution().executedPlan().toString())
        written[name] = real(df, name)
        return written[name]

    monkeypatch.setattr(knn, "materialise", spy)
    got = knn.knn_join(asks, rows, 5, normalize="after")
    # Spark reads 4096 rows of a table at once: they have to fit a task, several times
    assert written["knn-corpus"].agg(F.max(F.length("data"))).first()[0] <= knn.PIECE
    assert written["knn-corpus"].agg(F.sum("n")).first()[0] == len(x)
    assert sizes and "data" not in sizes[0]
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    found = {(r.query_id, r["rank"]): r.chunk_id for r in got.collect()}
    for i in sorted(int(q[1:]) for q, rank in found if rank == 1)[:20]:
        s = unit @ unit[i]
        want = sorted(range(len(x)), key=lambda j: (-round(s[j], 9), f"c{j}"))[:5]
        assert [found[f"c{i}", rank] for rank in range(1, 6)] == [f"c{j}" for j in want]


def test_pieces_of_a_batch_are_copied_and_offered_together(monkeypatch):
    offered, n, k = [], 40, 3
    rng = np.random.default_rng(1)
    q, c = rng.normal(size=(4, 8)), rng.normal(size=(n * 4, 8))
    real = knn.Nearest.offer

    def spy(self, m, ids, rows=None):
        offered.append((len(m), m.base is None))
        return real(self, m, ids, rows)

    monkeypatch.setattr(knn.Nearest, "offer", spy)
    pieces = [(list(range(4)), None, q)] + [(None, list(range(4 * i, 4 * i + 4)), c[4 * i:4 * i + 4]) for i in range(n)]
    batch = pa.RecordBatch.from_pylist(
        [{"key": "", "dim": 8, "_row": 0, "_col": 0, "qids": a, "ids": b, "data": m.tobytes()} for a, b, m in pieces],
        pa.schema([("key", pa.string()), ("dim", pa.int32()), ("_row", pa.int32()), ("_col", pa.int32()), ("qids", pa.list_(pa.int64())),
                   ("ids", pa.list_(pa.int64())), ("data", pa.binary())]))
    run = knn._scorer(k, None, False, False, ["query_id", "chunk_id", "similarity"], 64, 1 << 20)
    rows = [r for b in run(iter([batch.slice(0, 21), batch.slice(21)])) for r in b.to_pylist()]
    assert offered == [(64, True), (16, True), (64, True), (16, True)]
    s = (q / np.linalg.norm(q, axis=1)[:, None]) @ (c / np.linalg.norm(c, axis=1)[:, None]).T
    assert {(r["query_id"], r["chunk_id"]) for r in rows} == {(i, int(j)) for i in range(4) for j in np.argsort(-s[i])[:k]}


def test_queries_of_an_index_without_clusters_are_not_copied_to_every_cell(spark, tmp_path, monkeypatch):
    x = np.random.default_rng(3).normal(size=(1500, 24)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, embedding array<float>").repartition(4).cache()
    asks = rows.withColumnRenamed("chunk_id", "query_id")
    index = vector_index.build(rows, str(tmp_path / "ivf"))
    packed, real = [], vector_index.materialise

    def spy(df, name):
        out = real(df, name)
        if name == "ivf-visits":
            packed.append(out)
        return out

    monkeypatch.setattr(vector_index, "materialise", spy)
    hits, reads = vector_index.search(index, asks, 5, exclude_self=True)
    want = knn.knn_join(asks, rows, 5, DEFAULT.with_(knn_query_block=100), exclude_self=True)
    key = lambda d: sorted((r.query_id, r["rank"], r.chunk_id) for r in d.collect())
    assert key(hits) == key(want)
    assert len(index.centres[24]) > 20 and reads.agg(F.avg("vectors_read")).first()[0] > 700        # nearly all cells matter
    copies = sum(p.agg(F.sum("n")).first()[0] for p in packed)
    assert copies <= 1500 * (vector_index.FIRST + 1)


def test_counts_are_written_in_few_bytes_and_a_large_corpus_is_copied_once(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 9, size=(4000, 32)).astype(float)
    x[5], x[6, 0], x[7, 0], x[8, 0] = 300, 1e9 + 1, 0.1, 2.0 ** -160
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, embedding array<double>").coalesce(2).cache()
    asks = rows.where("chunk_id < 40").withColumnRenamed("chunk_id", "query_id")
    written, real = {}, knn.materialise
    monkeypatch.setattr(knn, "materialise", lambda df, name: written.setdefault(name, real(df, name)))
    got = knn.knn_join(asks, rows, 5, normalize="after")
    stored = written["knn-corpus"]
    assert stored.agg(F.sum(F.length("data"))).first()[0] < 2 * x.size
    assert {r._rows for r in written["knn-cells"].collect()} == {1}
    back = np.concatenate([knn.vectors_of(pa.scalar(bytes(r.data), pa.binary()), r.dim, r.n).astype(float)[np.argsort(r.ids)]
                           for r in stored.orderBy(F.array_min("ids")).collect()])
    assert sorted(map(tuple, back)) == sorted(map(tuple, x))
    found = {(r.query_id, r["rank"]): (r.chunk_id, r.similarity) for r in got.collect()}
    norm = np.sqrt((x * x).sum(axis=1))
    for i in range(40):
        s = (x @ x[i]) / (norm * norm[i])
        want = np.sort(s)[::-1][:5]
        assert np.allclose([found[i, rank][1] for rank in range(1, 6)], want, atol=1e-12)
