"""The inverted file against the exact kNN join: same rows, fewer vectors read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import knn, vector_index

ROW = "chunk_id long, embedding array<double>, semester int, subject string"


def corpus(spark, rows):
    return spark.createDataFrame([(i, v, i % 3 + 1, f"s{i % 4}") for i, v in rows], ROW)


def clustered(seed=1, groups=40, each=30, dim=12):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(groups, dim))
    x = (c[:, None] + rng.normal(size=(groups, each, dim)) * 0.15).reshape(-1, dim)
    return [(i, v.tolist()) for i, v in enumerate(x)]


def rows_of(hits):
    """The equal vectors count as one: their products differ in the last bit with the shape of a block."""
    return sorted((r.query_id, r["rank"], 5000 if 5000 <= r.chunk_id < 9000 else r.chunk_id, round(r.similarity, 9)) for r in hits.collect())


@pytest.fixture(scope="module")
def data(spark):
    rows = clustered()
    hot = [x + 0.01 for x in rows[0][1]]
    rows += [(5000 + i, hot) for i in range(400)]                         # a cell with a quarter of the vectors
    rows += [(9000, None), (9001, []), (9002, [0.0] * 12), (9003, [float("nan")] * 12), (9004, [1.0] * 5), (9005, [0.5, 1.0, 0.0, 0.0, 0.0])]
    return corpus(spark, rows).repartition(6).cache()


def test_equal_to_the_exact_join_and_reads_less(spark, data, tmp_path):
    queries = data.where("chunk_id % 7 = 0 OR chunk_id >= 9000").withColumnRenamed("chunk_id", "query_id")
    index = vector_index.build(data, str(tmp_path / "ivf"))
    hits, reads = vector_index.search(index, queries, 8, exclude_self=True)
    want = knn.knn_join(queries, data, 8, exclude_self=True)
    assert rows_of(hits) == rows_of(want)
    share = reads.where("query_id < 5000").agg(F.avg("vectors_read")).first()[0] / data.count()
    assert 0 < share < 0.5                                                # nearest groups and rings only
    again, _ = vector_index.search(vector_index.open_index(spark, str(tmp_path / "ivf")), queries, 8, exclude_self=True, min_score=0.9)
    assert rows_of(again) == rows_of(knn.knn_join(queries, data, 8, exclude_self=True, min_score=0.9))


def test_keys_small_blocks_and_more_than_there_are(spark, data, tmp_path):
    from lectern.params import DEFAULT
    small = DEFAULT.with_(knn_query_block=16)                             # several blocks a cell, salted keys
    queries = data.where("chunk_id % 29 = 0").select(
        F.col("chunk_id").alias("query_id"), "embedding", F.when(F.col("chunk_id") % 2 == 0, F.col("semester")).otherwise(0).alias("q_semester"),
        F.when(F.col("chunk_id") % 5 == 0, F.lit("s1")).alias("q_subject"))
    index = vector_index.build(data, str(tmp_path / "ivf"), keys=knn.corpus_keys(F.col("semester"), F.col("subject")), params=small)
    hits, _ = vector_index.search(index, queries, 300, key=knn.query_keys(F.col("q_semester"), F.col("q_subject")), params=small)
    want = knn.knn_join(queries, data, 300, query_semester="q_semester", query_subject="q_subject")
    assert rows_of(hits) == rows_of(want)


def test_empty_sides(spark, data, tmp_path):
    none = data.where("chunk_id < 0")
    index = vector_index.build(none, str(tmp_path / "empty"))
    assert vector_index.search(index, data.withColumnRenamed("chunk_id", "query_id"), 3)[0].collect() == []
    index = vector_index.build(data, str(tmp_path / "full"))
    assert vector_index.search(index, none.withColumnRenamed("chunk_id", "query_id"), 3)[0].collect() == []
