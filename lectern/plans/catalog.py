"""Catalog views over the store / KB for plain SQL, and selection lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import kb


def register(spark: SparkSession, store: DataFrame, kb_docs: DataFrame) -> None:
    store.createOrReplaceTempView("chunks")
    kb.register_catalog(spark, kb_docs, "kb_docs")


def lists(kb_docs: DataFrame) -> DataFrame:
    """A5: one row per (semester, subject), each once, for lists sorted by both."""
    return kb_docs.groupBy("semester", "subject").agg(F.count(F.lit(1)).alias("n_units"))
