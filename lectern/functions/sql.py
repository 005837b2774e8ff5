"""U1/W7/L6 for SQL: table functions over the store's texts.

``register(spark)`` makes them known to a session; see ``plans.catalog.register`` for the views they are used with.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import LongType, StructType

from lectern.params import DEFAULT

_WORD = re.compile(r"\S+")


@udtf(returnType="chunk_part bigint, total_parts bigint, n_tokens bigint, content string")
class TokenWindows:
    """``token_windows(text, size, overlap)``: the windows of a text's tokens, one row each; none for null or blank."""

    def eval(self, text: str, size: int = DEFAULT.chunk_size, overlap: int = DEFAULT.chunk_overlap) -> Iterator[tuple]:
        if not 0 <= overlap < size:
            raise ValueError("the overlap must be smaller than the window")
        tokens = _WORD.findall(text or "")
        starts = range(0, len(tokens), size - overlap)
        for part, at in enumerate(starts, 1):
            window = tokens[at:at + size]
            yield part, len(starts), len(window), " ".join(window)


class BestRows:
    """``best_rows(TABLE(hits), k)``: the first ``k`` rows of each query_id by similarity, ties to the smaller chunk_id,
    with their rank. The table is partitioned and sorted by Spark; a row a call, nothing is held."""

    def __init__(self) -> None:
        self.seen = 0

    @staticmethod
    def analyze(hits: AnalyzeArgument, k: AnalyzeArgument) -> AnalyzeResult:
        schema = StructType(list(hits.dataType.fields)).add("rank", LongType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("query_id")],
                             orderBy=[OrderingColumn("similarity", ascending=False), OrderingColumn("chunk_id")])

    def eval(self, hits: Row, k: int) -> Iterator[tuple]:
        self.seen += 1
        if self.seen <= k:
            yield (*hits, self.seen)


def register(spark: SparkSession) -> None:
    spark.udtf.register("token_windows", TokenWindows)
    spark.udtf.register("best_rows", udtf(BestRows))
