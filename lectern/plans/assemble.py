"""L3: per request, the prompt and the source records (model call via hook U3)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import dialog
from lectern.operators import history, retrieval


def assemble(requests: DataFrame, hits: DataFrame, system_prompt: str = dialog.DEFAULT_SYSTEM_PROMPT,
             answer: Callable[[Column], Column] | None = None) -> DataFrame:
    """``requests(query_id, query, semester, subject, history, rewritten)`` +
    final hits -> ``prompt``, ``sources`` and the response record (P30-P32).
    ``answer`` maps the prompt column to an answer column (e.g. a pandas UDF
    calling a model); without it the answer is NULL."""
    a = requests.join(retrieval.answer_parts(hits), "query_id", "left")
    prompt = dialog.build_prompt(F.lit(system_prompt), F.col("query"), F.coalesce(F.col("context_text"), F.lit("")),
                                 F.col("subject"), F.col("semester"), history.history_section(F.col("history")))
    a = a.withColumn("prompt", prompt)
    ans = answer(F.col("prompt")) if answer is not None else F.lit(None).cast("string")
    return a.withColumn("response", F.struct(
        ans.alias("answer"), F.coalesce(F.col("sources"), F.array()).alias("sources"),
        F.col("rewritten").alias("rewritten_query"), F.lit(False).alias("was_cached"),
        F.lit(False).alias("should_refuse")))
