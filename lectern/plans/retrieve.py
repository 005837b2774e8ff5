"""L2: batch retrieval: F1 -> J2/K2 -> F2/P19 -> W5 -> F7/A8."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lectern.operators import retrieval
from lectern.operators.knn import knn_join
from lectern.params import DEFAULT, Params

HIT_META = ["content", "semester", "subject", "unit_number", "unit_name", "slide_number", "source_filename",
            "source_url"]


def retrieve(queries: DataFrame, store: DataFrame, params: Params = DEFAULT, *, semester: str | None = "semester",
             subject: str | None = "subject", normalize: str = "rows",
             carry: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``queries(query_id, embedding[, semester, subject])`` against
    ``store(chunk_id, embedding, *meta)``. Returns ``(hits, results)``: final
    ranked hits (<= cap per query) and one result row per query."""
    hits = knn_join(queries, store, params.top_k, params, corpus_id="chunk_id",
                    query_semester=semester if semester in queries.columns else None,
                    query_subject=subject if subject in queries.columns else None,
                    min_score=params.threshold, carry=carry or [c for c in HIT_META if c in store.columns],
                    normalize=normalize)
    final = retrieval.precision_filter(retrieval.threshold(hits, params), params)
    results = retrieval.retrieval_state(queries, final, store.isEmpty())
    return final, results
