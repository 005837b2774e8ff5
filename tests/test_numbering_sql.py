"""Global numbers over range partitions; SQL table functions; catalog views."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import sql
from lectern.operators import numbering
from lectern.plans import catalog


def test_numbers_follow_the_order_over_many_partitions(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        rng = random.Random(2)
        rows = [(rng.choice([None, "a", "hot", "hot", "hot"]), rng.randrange(50), f"t{i}") for i in range(2000)] + [("dup", 1, "same")] * 5
        df = spark.createDataFrame(rows, "k string, n int, _part string")         # a clashing column is kept
        got = numbering.number_rows(df, ["k", -F.col("n")], start=7).collect()
    finally:
        spark.conf.set(name, before)
    assert sorted(r["index"] for r in got) == list(range(7, 7 + len(rows)))
    inside = [(r.k is not None, r.k or "", -r.n) for r in sorted(got, key=lambda r: r["index"])]
    assert inside == sorted(inside)
    assert numbering.number_rows(df.drop("_part").limit(0), ["k"]).collect() == []


def test_global_ids_name_file_slide_and_place(spark):
    df = spark.createDataFrame([("b.pdf", 2, "y"), ("a.pdf", None, "x"), (None, 1, "z")], "source_filename string, slide_number int, text string")
    got = {r.text: r.chunk_id for r in numbering.global_chunk_ids(df, ["text"]).collect()}
    assert got == {"x": "a.pdf_0_0", "y": "b.pdf_2_1", "z": "unknown_1_2"}


def test_token_windows_in_sql(spark):
    sql.register(spark)
    got = spark.sql("SELECT * FROM token_windows('a b  c\td e', 3, 1)").collect()
    assert [tuple(r) for r in got] == [(1, 3, 3, "a b c"), (2, 3, 3, "c d e"), (3, 3, 1, "e")]
    assert spark.sql("SELECT * FROM token_windows(CAST(NULL AS STRING), 3, 1)").collect() == []
    with pytest.raises(Exception, match="smaller"):
        spark.sql("SELECT * FROM token_windows('a b', 2, 2)").collect()


def test_best_rows_and_the_catalog_views_in_sql(spark):
    sql.register(spark)
    store = spark.createDataFrame([(1, "one", 3, "os"), (2, "two", 3, "os"), (3, "three", 4, "db")],
                                  "chunk_id long, content string, semester int, subject string")
    kb = spark.createDataFrame([(3, "os", "u1"), (3, "os", "u2"), (4, "db", "u1")], "semester int, subject string, unit_name string")
    catalog.register(spark, store, kb)
    spark.createDataFrame([(7, 1, 0.5, "x"), (7, 2, 0.5, "y"), (7, 3, 0.9, "z"), (8, 3, 0.1, "w")],
                          "query_id int, chunk_id long, similarity double, note string").createOrReplaceTempView("hits")
    got = spark.sql("""SELECT b.query_id, b.rank, b.note, c.content FROM best_rows(TABLE(hits), 2) b
                       JOIN chunks c ON c.chunk_id = b.chunk_id ORDER BY 1, 2""").collect()
    assert [tuple(r) for r in got] == [(7, 1, "z", "three"), (7, 2, "x", "one"), (8, 1, "w", "three")]
    assert {(r.semester, r.subject, r.n_units) for r in catalog.lists(kb).collect()} == {(3, "os", 2), (4, "db", 1)}
