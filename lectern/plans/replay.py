"""L4: request-log replay: rewrite -> cache key -> TTL cache -> retrieve misses only -> record."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import dialog, text
from lectern.operators import cache, retrieval
from lectern.params import DEFAULT, Params
from lectern.plans import retrieve
from lectern.session import materialise


def replay_requests(requests: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """``requests(request_id, ts, rewritten, semester, subject, history)`` ->
    the same rows with ``key`` (P22), ``hit`` and ``stored_at_us`` (W6).
    Only rows with ``hit = false`` need retrieval and generation."""
    keyed = requests.withColumn("key", text.cache_key(F.col("rewritten"), F.col("semester"), F.col("subject"),
                                                      F.col("history")))
    rep = cache.replay(keyed.select(F.col("request_id").alias("event_id"), "key", "ts"), params.cache_ttl_seconds)
    return keyed.join(rep.select(F.col("event_id").alias("request_id"), "hit", "stored_at_us"), "request_id")


def answer_requests(requests: DataFrame, store: DataFrame, embed: Callable[[DataFrame], DataFrame],
                    params: Params = DEFAULT, candidate: Column | None = None,
                    answer: Callable[[Column], Column] | None = None, normalize: str = "rows") -> DataFrame:
    """A request log answered end to end: ``requests(request_id, ts, query, semester, subject, history)`` ->
    request_id, rewritten_query, was_cached, should_refuse, refusal_message, sources, answer (P32).

    The question is rewritten (P24-P27), keyed (P22) and looked up in the TTL cache (W6); ``embed`` adds an
    ``embedding`` of ``rewritten`` to the misses, and only they are retrieved (L2) and answered. A hit returns
    the record its miss stored. An empty collection refuses every request, and refusals are never cached.
    ``answer`` maps the context text to an answer (hook U3; NULL without it).
    """
    asked = requests.withColumn("rewritten", dialog.rewrite(F.col("query"), F.col("subject"), F.col("history"), candidate))
    if store.isEmpty():
        return asked.select("request_id", F.col("rewritten").alias("rewritten_query"), F.lit(False).alias("was_cached"),
                            F.lit(True).alias("should_refuse"), F.lit(retrieval.EMPTY_INDEX_MESSAGE).alias("refusal_message"),
                            F.array().cast(retrieval.SOURCES_TYPE).alias("sources"), F.lit(None).cast("string").alias("answer"))
    log = materialise(replay_requests(asked, params), "request-log")
    misses = embed(log.where("NOT hit").select(F.col("request_id").alias("query_id"), "rewritten", "semester", "subject"))
    hits, _ = retrieve.retrieve(misses, store, params, normalize=normalize)
    parts = retrieval.answer_parts(hits)
    made = answer(F.col("context_text")) if answer is not None else F.lit(None).cast("string")
    stored = (log.where("NOT hit").select(F.col("request_id").alias("query_id"), "key", "stored_at_us")
              .join(parts, "query_id", "left")
              .select("key", "stored_at_us", F.coalesce("sources", F.array().cast(retrieval.SOURCES_TYPE)).alias("sources"),
                      made.alias("answer")))
    return (log.join(stored, ["key", "stored_at_us"])
            .select("request_id", F.col("rewritten").alias("rewritten_query"), F.col("hit").alias("was_cached"),
                    F.lit(False).alias("should_refuse"), F.lit("").alias("refusal_message"), "sources", "answer"))


def hit_rate(replayed: DataFrame) -> DataFrame:
    return replayed.agg(F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.count(F.lit(1)).alias("n"))
