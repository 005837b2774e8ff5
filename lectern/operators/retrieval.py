"""The retrieval contract after the kNN join.

Order is part of the contract: top-k -> threshold on the unrounded score ->
round -> subject isolation -> gap -> cap. Every window here is partitioned by
``query_id`` and holds at most ``top_k`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import citation, match_percent
from lectern.params import DEFAULT, Params

# Fixed value: the refusal text used when nothing has been indexed.
EMPTY_INDEX_MESSAGE = "No syllabus data has been indexed yet. Please run the ingestion pipeline first."

SOURCES_TYPE = ("array<struct<slide_number:int,subject:string,unit_name:string,unit_number:int,semester:int,"
                "source_filename:string,citation:string,similarity_score:double>>")


def metadata_predicate(semester: int | None = None, subject: str | None = None) -> Column:
    """F1 for one request: ``semester = n`` only if n > 0, ``subject = s`` only if
    s is non-blank (exact case); TRUE when neither applies."""
    cond = F.lit(True)
    if semester is not None and semester > 0:
        cond = cond & (F.col("semester") == semester)
    if subject is not None and subject.strip():
        cond = cond & (F.col("subject") == subject)
    return cond


def _order(p: Params):
    return [F.col("similarity").desc(), F.col("chunk_id").asc()]


def threshold(hits: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """F2 + P19: keep ``similarity >= threshold`` (unrounded), then round."""
    return (hits.where(F.col("similarity") >= params.threshold)
            .withColumn("similarity_score", F.round("similarity", params.score_digits)))


def precision_filter(hits: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Subject isolation, gap filter and cap on thresholded, rounded hits.

    Input needs ``query_id, chunk_id, similarity, similarity_score, subject``.
    Output adds ``rank`` (1..cap) in final order.
    """
    p = params
    w = Window.partitionBy("query_id").orderBy(*_order(p))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    h = (hits.withColumn("best", F.first("similarity_score").over(whole))
         .withColumn("top_subject", F.first("subject").over(whole)))
    isolate = (F.col("best") > p.isolation_floor) & (F.coalesce(F.col("top_subject"), F.lit("")) != "")
    h = h.where(~isolate | (F.col("subject") == F.col("top_subject")))
    h = h.where(F.col("similarity_score") >= F.col("best") - F.lit(p.gap))
    return (h.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= p.cap)
            .drop("best", "top_subject"))


def with_citation(hits: DataFrame) -> DataFrame:
    """P18 on hit rows (missing metadata read as 0 / '')."""
    return hits.withColumn("citation", citation(F.col("subject"), F.col("semester"), F.col("unit_number"),
                                                F.col("slide_number"), F.col("source_filename")))


def context_blocks(hits: DataFrame) -> DataFrame:
    """Per query, '[Source i: citation]\\ncontent' blocks joined by separators."""
    blocks = F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "citation", "content"))),
        lambda x: F.concat(F.lit("[Source "), x["rank"].cast("string"), F.lit(": "), x["citation"],
                           F.lit("]\n"), x["content"]))
    return (with_citation(hits).groupBy("query_id")
            .agg(F.count(F.lit(1)).alias("n_hits"), F.array_join(blocks, "\n\n---\n\n").alias("context_text")))


def retrieval_state(queries: DataFrame, final_hits: DataFrame, corpus_empty: bool) -> DataFrame:
    """One row per query: refusal flag and message, context presence and text.

    An empty collection refuses; a query with no passing hit is not refused
    and has an empty context.
    """
    agg = context_blocks(final_hits)
    out = queries.select("query_id").join(agg, "query_id", "left")
    return out.select(
        "query_id",
        F.lit(corpus_empty).alias("should_refuse"),
        F.when(F.lit(corpus_empty), F.lit(EMPTY_INDEX_MESSAGE)).otherwise(F.lit("")).alias("refusal_message"),
        F.coalesce(F.col("n_hits"), F.lit(0)).cast("long").alias("n_hits"),
        ((F.coalesce(F.col("n_hits"), F.lit(0)) > 0) & ~F.lit(corpus_empty)).alias("has_context"),
        F.when(F.lit(corpus_empty), F.lit("")).otherwise(F.coalesce(F.col("context_text"), F.lit("")))
        .alias("context_text"))


def queries_with_context(queries: DataFrame, final_hits: DataFrame) -> DataFrame:
    """Queries having at least one passing hit."""
    return queries.join(final_hits.select("query_id"), "query_id", "left_semi")


def unit_key(unit_name: Column, unit_number: Column) -> Column:
    """Dedup key of a source's unit: its name, else its number."""
    return F.coalesce(F.nullif(unit_name, F.lit("")), unit_number.cast("string"))


def unique_sources(hits: DataFrame) -> DataFrame:
    """Per query, first (best) hit per (subject, semester, unit), order kept."""
    w = Window.partitionBy("query_id", "subject", "semester", "ukey").orderBy("rank")
    return (hits.withColumn("ukey", unit_key(F.col("unit_name"), F.col("unit_number")))
            .withColumn("dup", F.row_number().over(w)).where(F.col("dup") == 1)
            .withColumn("match_percent", match_percent(F.col("similarity_score")))
            .drop("dup", "ukey"))


def answer_parts(hits: DataFrame) -> DataFrame:
    """A8 + P31 in one aggregation: per query ``n_hits, context_text, sources``."""
    h = with_citation(hits)
    src = F.struct(
        F.col("slide_number"), F.col("subject"), F.col("unit_name"), F.col("unit_number"),
        F.col("semester"), F.col("source_filename"), F.col("citation"), F.col("similarity_score"))
    parts = F.sort_array(F.collect_list(F.struct("rank", "citation", "content", src.alias("s"))))
    g = h.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"), parts.alias("_p"))
    blocks = F.transform("_p", lambda x: F.concat(F.lit("[Source "), x["rank"].cast("string"), F.lit(": "),
                                                  x["citation"], F.lit("]\n"), x["content"]))
    return g.select("query_id", "n_hits", F.array_join(blocks, "\n\n---\n\n").alias("context_text"),
                    F.transform("_p", lambda x: x["s"]).alias("sources"))
