"""Gapless numbers over a whole table in a given order, without a sort in one task.

Rows go to range partitions of the order; a partition's rows are numbered on their own and lifted by the number of
rows before it, a prefix sum over one count a partition.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import materialise


def number_rows(rows: DataFrame, order: list[str | Column], name: str = "index", start: int = 0) -> DataFrame:
    """``rows`` with the column ``name`` (long): ``start``, ``start`` + 1, ... in the ascending order of ``order``.

    Rows equal in ``order`` are numbered in the order of a hash of their content, which also spreads them over
    partitions; rows equal in every column are exchangeable. Nulls come first. An empty table stays empty."""
    content = [F.col(f.name) for f in rows.schema.fields if f.dataType.typeName() != "map"]
    by = [F.col(o) if isinstance(o, str) else o for o in order]
    keys = [f"_order_{i}" for i in range(len(by))] + ["_tie"]
    keyed = rows.select(F.struct(*rows.columns).alias("_row"), *[c.alias(k) for c, k in zip(by, keys)], F.xxhash64(*content).alias("_tie"))
    placed = materialise(keyed.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "numbered")
    counts = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    before = [0, *accumulate(n for _, n in counts)]
    offsets = rows.sparkSession.createDataFrame([(p, b + start) for (p, _), b in zip(counts, before)], "_part int, _before long")
    w = Window.partitionBy("_part").orderBy(*keys)
    # one row a partition
    return (placed.withColumn("_n", F.row_number().over(w)).join(F.broadcast(offsets), "_part")
            .select("_row.*", (F.col("_before") + F.col("_n") - 1).alias(name)))


def global_chunk_ids(chunks: DataFrame, order: list[str | Column], file: str = "source_filename", slide: str = "slide_number") -> DataFrame:
    """P23 with a global index: ``chunk_id`` is file name, slide and the chunk's number among all chunks, from 0."""
    numbered = number_rows(chunks, order, "chunk_index")
    return numbered.withColumn("chunk_id", F.concat_ws("_", F.coalesce(F.col(file), F.lit("unknown")),
                                                       F.coalesce(F.col(slide).cast("string"), F.lit("0")), F.col("chunk_index").cast("string")))
