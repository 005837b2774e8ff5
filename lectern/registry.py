"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator
of the coverage checklist. Every query reads whole tables (or Spark derivations
of them, see ``lectern.sources.fixtures``); column names match ``lectern.oracle``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import sql
from lectern.functions import text as T
from lectern.operators import chunking, numbering, retrieval, vector_index
from lectern.operators.knn import corpus_keys, knn_join, query_keys
from lectern.params import DEFAULT, Params
from lectern.session import materialise, scratch_path
from lectern.sources import fixtures as fx
from lectern.sources.bucketed import BucketedStore
from lectern.sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ====================================================================== retrieval
# Self-match is excluded, so the fixture's cut-offs are threshold 0.30 and
# isolation floor 0.25 (nearest other vector has cosine 0.27-0.51).
RETRIEVAL = DEFAULT.with_(threshold=0.30, isolation_floor=0.25)
_META = ["subject", "semester", "unit_number", "unit_name", "slide_number", "source_filename",
         "source_url", "slides_covered_json", "content"]


def _knn(spark, d, k=8, filtered=False, exclude_self=True, min_score=None, p: Params = RETRIEVAL):
    kw = dict(query_semester="q_semester", query_subject="q_subject") if filtered else {}
    return knn_join(fx.vector_queries(spark, d), fx.vectors(spark, d), k, p, corpus_id="chunk_id",
                    exclude_self=exclude_self, min_score=min_score, carry=_META, **kw)


def _final_hits(spark, d, p: Params = RETRIEVAL):
    hits = retrieval.threshold(_knn(spark, d, k=p.top_k, min_score=p.threshold, p=p), p)
    return retrieval.precision_filter(hits, p)


def _score(c="similarity"):
    return F.round(F.col(c), RETRIEVAL.score_digits).alias("score")


@query("knn_topk")
def q_knn_topk(spark, d):
    return _knn(spark, d).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), _score())


@query("knn_filtered")
def q_knn_filtered(spark, d):
    return _knn(spark, d, filtered=True).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"),
                                                _score())


def _indexed(spark, d, keys=None, key=None):
    index = vector_index.build(fx.vectors(spark, d), scratch_path(spark, f"ivf-{uuid.uuid4().hex}"), keys=keys)
    hits, _ = vector_index.search(index, fx.vector_queries(spark, d), 8, key=key, exclude_self=True)
    return hits.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), _score())


@query("knn_index_topk")
def q_knn_index_topk(spark, d):
    return _indexed(spark, d)


@query("knn_index_filtered")
def q_knn_index_filtered(spark, d):
    return _indexed(spark, d, corpus_keys(F.col("semester"), F.col("subject")), query_keys(F.col("q_semester"), F.col("q_subject")))


@query("knn_threshold")
def q_knn_threshold(spark, d):
    h = retrieval.threshold(_knn(spark, d, min_score=RETRIEVAL.threshold), RETRIEVAL)
    return h.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), "similarity_score")


@query("precision_filter")
def q_precision_filter(spark, d):
    return _final_hits(spark, d).select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id",
                                        "similarity_score", "subject")


@query("retrieve_state")
def q_retrieve_state(spark, d):
    corpus = fx.vectors(spark, d)
    st = retrieval.retrieval_state(fx.vector_queries(spark, d), _final_hits(spark, d), corpus.isEmpty())
    return st.select("query_id", "should_refuse", "n_hits", "has_context")


@query("citation")
def q_citation(spark, d):
    return retrieval.with_citation(_final_hits(spark, d)).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "citation")


@query("context_text")
def q_context_text(spark, d):
    return retrieval.context_blocks(_final_hits(spark, d)).select("query_id", "context_text")


@query("unique_sources")
def q_unique_sources(spark, d):
    return retrieval.unique_sources(_final_hits(spark, d)).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "subject", "semester", "unit_name",
        "unit_number", "match_percent")


@query("match_percent")
def q_match_percent(spark, d):
    from lectern.functions.text import match_percent
    return _final_hits(spark, d).select("query_id", F.col("rank").cast("long").alias("rank"),
                                        match_percent(F.col("similarity_score")).alias("match_percent"))


@query("knn_top10_report")
def q_knn_top10(spark, d):
    return _knn(spark, d, k=10, exclude_self=False).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", _score(), "subject", "unit_name")


# ====================================================================== chunking
def _lines(spark, d):
    return fx.doc_lines(spark, d)


@query("token_count")
def q_token_count(spark, d):
    return load(spark, d, "documents").select("doc_id", T.token_count(F.col("text")).alias("n_tokens"))


@query("token_windows")
def q_token_windows(spark, d):
    p = DEFAULT
    el = _lines(spark, d).select("doc_id", F.col("ord").alias("element_no"), T.strip(F.col("text")).alias("text"))
    el = el.withColumn("tok", T.words(F.col("text"))).where(F.size("tok") > p.max_chunk_tokens)
    starts = F.sequence(F.lit(0), F.size("tok") - 1, F.lit(p.chunk_size - p.chunk_overlap))
    w = el.select("doc_id", "element_no", "tok", F.posexplode(starts).alias("pos", "st"),
                  F.size(starts).cast("long").alias("total_parts"))
    win = F.slice("tok", F.col("st") + 1, p.chunk_size)
    return w.select("doc_id", "element_no", (F.col("pos") + 1).cast("long").alias("chunk_part"), "total_parts",
                    F.size(win).cast("long").alias("n_tokens"), T.detokenize(win).alias("content"))


@query("token_windows_sql")
def q_token_windows_sql(spark, d):
    sql.register(spark)
    el = _lines(spark, d).select("doc_id", F.col("ord").alias("element_no"), T.strip(F.col("text")).alias("text"))
    el.createOrReplaceTempView("elements")
    return spark.sql(f"""
        SELECT doc_id, element_no, chunk_part, total_parts, n_tokens, content
        FROM (SELECT * FROM elements WHERE size(split(text, '\\\\s+')) > {DEFAULT.max_chunk_tokens}) e,
             LATERAL token_windows(e.text, {DEFAULT.chunk_size}, {DEFAULT.chunk_overlap})""")


@query("knn_top10_sql")
def q_knn_top10_sql(spark, d):
    sql.register(spark)
    knn_join(fx.vector_queries(spark, d), fx.vectors(spark, d), 16, RETRIEVAL, corpus_id="chunk_id").drop("rank") \
        .createOrReplaceTempView("hits")
    fx.vectors(spark, d).createOrReplaceTempView("chunks")
    return spark.sql("""
        SELECT b.query_id, b.rank, b.chunk_id, round(b.similarity, 4) AS score, c.subject, c.unit_name
        FROM best_rows(TABLE(hits), 10) b JOIN chunks c ON c.chunk_id = b.chunk_id""")


def _chunks(spark, d):
    return chunking.chunk_elements(_lines(spark, d), meta_cols=["doc_id"])


@query("chunk_assign")
def q_chunk_assign(spark, d):
    el = _lines(spark, d).where(T.non_blank(F.col("text"))).select("file", "ord", T.token_count(F.col("text")).alias("n"))
    return chunking.assign_chunks(el).select(
        F.col("file").cast("long").alias("doc_id"), F.col("ord").alias("element_no"), "chunk_no")


@query("chunk_text")
def q_chunk_text(spark, d):
    return _chunks(spark, d).select("doc_id", "chunk_no", F.col("chunk_part").cast("long").alias("chunk_part"),
                                    "n_tokens", "content")


@query("global_chunk_ids")
def q_global_chunk_ids(spark, d):
    c = _chunks(spark, d).select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("source_filename"), "doc_id",
                                 F.col("chunk_no").cast("long").alias("chunk_no"), F.col("chunk_part").cast("long").alias("chunk_part"))
    return numbering.global_chunk_ids(c, ["doc_id", "chunk_no", F.coalesce("chunk_part", F.lit(0))], slide="chunk_no") \
        .select("chunk_index", "chunk_id", "doc_id", "chunk_no", "chunk_part")


@query("slides_covered")
def q_slides_covered(spark, d):
    c = _chunks(spark, d).where(F.col("chunk_part").isNull())
    return c.select("doc_id", "chunk_no", F.col("slide_number").cast("long").alias("slide_number"),
                    F.array_join(F.transform("slides_covered", lambda x: x.cast("string")), ",").alias("slides"))


# ====================================================================== metadata
from lectern.functions import paths as P  # noqa: E402
from lectern.operators import enrich as EN  # noqa: E402
from lectern.operators import links as LK  # noqa: E402
from lectern.functions import links as LF  # noqa: E402

BASE_URL = "https://portal.example/"


def _discovered(spark, d):
    return fx.file_paths(spark, d).where(P.is_document_path(F.col("path")))


def _resources(spark, d):
    return LK.download_plan(LK.all_resources(fx.subject_pages(spark, d)))


@query("file_discovery")
def q_file_discovery(spark, d):
    return _discovered(spark, d).select("doc_id", "path").orderBy("path")


@query("content_hash")
def q_content_hash(spark, d):
    return fx.file_paths(spark, d).select("doc_id", "path", F.md5(F.col("text")).alias("md5"))


@query("meta_semester")
def q_meta_semester(spark, d):
    return fx.file_paths(spark, d).select("doc_id", P.semester_from_path(F.col("path")).alias("semester"))


@query("meta_subject")
def q_meta_subject(spark, d):
    return fx.file_paths(spark, d).select("doc_id", P.subject_from_path(F.col("path")).alias("subject"))


@query("meta_unit_filename")
def q_meta_unit_filename(spark, d):
    f = fx.file_paths(spark, d).select("doc_id", T.basename(F.col("path")).alias("source_filename"))
    return f.select("doc_id", "source_filename", P.unit_from_filename(F.col("source_filename")).alias("unit_number"))


@query("meta_unit_content")
def q_meta_unit_content(spark, d):
    return fx.file_elements(spark, d).select("doc_id", F.col("element_no").cast("long").alias("element_no"),
                                             P.unit_from_content(F.col("text")).alias("unit_number"))


@query("enrich_elements")
def q_enrich_elements(spark, d):
    files = EN.enrich_files(_discovered(spark, d), LK.manifest_order(_resources(spark, d)))
    e = EN.explode_elements(files, F.concat(fx.unit_prefix(F.col("doc_id")), F.col("text")))
    return e.select("doc_id", F.col("element_no").cast("long").alias("element_no"), "semester", "subject",
                    "unit_number", "slide_number", "source_filename", "source_url")


@query("manifest_lookup")
def q_manifest_lookup(spark, d):
    f = EN.enrich_files(_discovered(spark, d).drop("text"), LK.manifest_order(_resources(spark, d)))
    return f.select("doc_id", "semester", "source_filename", "source_url")


@query("metadata_flatten")
def q_metadata_flatten(spark, d):
    c = _chunks(spark, d)
    js = F.when(F.col("slides_covered").isNotNull(), EN.int_list_text(F.col("slides_covered")))
    return c.select("doc_id", "chunk_no",
                    EN.flatten_scalar(F.col("chunk_part")).alias("chunk_part"),
                    EN.flatten_scalar(F.col("slide_number")).alias("slide_number"),
                    EN.flatten_scalar(js).alias("slides_covered"),
                    F.array_join(F.transform(EN.parse_int_list(EN.flatten_scalar(js)), lambda x: x.cast("string")),
                                 ",").alias("slides_parsed"))


@query("safe_name")
def q_safe_name(spark, d):
    p = load(spark, d, "part")
    nm = T.safe_name(F.col("p_name"))
    path = F.concat(F.lit("semester_"), (F.col("p_size") % 8 + 1).cast("string"), F.lit("/"),
                    T.safe_name(F.col("p_brand")), F.lit("/"),
                    F.coalesce(F.nullif(nm, F.lit("")), F.concat(F.lit("id"), F.col("p_partkey").cast("string"))))
    return p.select("p_partkey", nm.alias("safe_name"), path.alias("target_path"))


# ====================================================================== links / manifest
def _anchors(spark, d):
    return LK.anchors(fx.subject_pages(spark, d))


@query("drive_id")
def q_drive_id(spark, d):
    a = _anchors(spark, d).where(F.col("href").isNotNull())
    did = LF.drive_id(F.col("href"))
    return a.select("page_id", F.col("pos").cast("long").alias("pos"), did["drive_id"].alias("drive_id"),
                    did["drive_type"].alias("drive_type"))


@query("resource_class")
def q_resource_class(spark, d):
    a = _anchors(spark, d)
    name = F.coalesce(F.nullif(F.col("text"), F.lit("")), F.lit("Resource"))
    return a.select("page_id", F.col("pos").cast("long").alias("pos"), LF.resource_class(name).alias("resource_type"))


@query("viewer_target")
def q_viewer_target(spark, d):
    a = _anchors(spark, d).where(F.col("href").isNotNull() & LF.is_viewer_link(F.col("href")))
    return a.select("page_id", F.col("pos").cast("long").alias("pos"), LF.viewer_target(F.col("href")).alias("target"))


@query("page_links")
def q_page_links(spark, d):
    r = LK.page_resources(fx.subject_pages(spark, d))
    return r.select("page_id", F.col("strategy").cast("long").alias("strategy"), F.col("pos").cast("long").alias("pos"),
                    "name", "resource_type", "drive_url", "drive_id", "drive_type")


@query("subject_links")
def q_subject_links(spark, d):
    s = LK.subject_links(fx.subject_pages(spark, d), BASE_URL)
    return s.select("page_id", F.col("pos").cast("long").alias("pos"), "name", "url")


@query("link_union_dedup")
def q_link_union_dedup(spark, d):
    r = LK.all_resources(fx.subject_pages(spark, d))
    return r.select("page_id", F.col("strategy").cast("long").alias("strategy"), F.col("pos").cast("long").alias("pos"),
                    "name", "resource_type", "drive_id")


@query("manifest_totals")
def q_manifest_totals(spark, d):
    return LK.manifest_totals(fx.subject_pages(spark, d), _resources(spark, d))


@query("manifest_nested")
def q_manifest_nested(spark, d):
    m = LK.manifest_subjects(fx.subject_pages(spark, d), _resources(spark, d))
    return m.select("page_id", "name", "semester", "url", F.size("resources").cast("long").alias("n_resources"),
                    F.array_join(F.transform("resources", lambda x: x["name"]), "|").alias("resource_names"),
                    F.size(F.filter("resources", lambda x: x["downloaded"])).cast("long").alias("n_downloaded"))


@query("path_hash_map")
def q_path_hash_map(spark, d):
    return LK.path_hash_map(_resources(spark, d))


# ====================================================================== knowledge base
from lectern.operators import kb as KB  # noqa: E402


@query("kb_flatten")
def q_kb_flatten(spark, d):
    return KB.flatten_kb(fx.kb(spark, d))


@query("subjects_per_semester")
def q_subjects_per_semester(spark, d):
    s = KB.subjects_per_semester(fx.kb(spark, d))
    return s.select("semester", "n_subjects", F.array_join("subjects", ", ").alias("subjects"))


@query("kb_catalog")
def q_kb_catalog(spark, d):
    KB.register_catalog(spark, KB.flatten_kb(fx.kb(spark, d)), "kb_docs")
    return spark.sql(KB.CATALOG_SQL.format(view="kb_docs"))


# ====================================================================== dialog
from lectern.functions import dialog as DG  # noqa: E402
from lectern.operators import history as HI  # noqa: E402


def _requests_with_history(spark, d, n=None):
    p = DEFAULT
    return HI.previous_messages(fx.messages(spark, d), n or p.history_prompt, targets=fx.requests(spark, d))


def _rewritten(r, candidate=None):
    return DG.rewrite(F.col("query"), F.col("subject"), F.col("history"), candidate)


@query("history_last5")
def q_history_last5(spark, d):
    r = _requests_with_history(spark, d)
    txt = F.array_join(F.transform("history", lambda x: F.concat(DG.role_label(x["role"]), F.lit(": "), x["content"])), "\n")
    return r.select("conv_id", "turn", F.size("history").cast("long").alias("n_hist"), txt.alias("history_text"))


@query("history_last3")
def q_history_last3(spark, d):
    r = _requests_with_history(spark, d)
    return r.select("conv_id", "turn", HI.rewrite_context(F.col("history"), DEFAULT.history_rewrite).alias("context"))


@query("transcript")
def q_transcript(spark, d):
    r = _requests_with_history(spark, d)
    return r.select("conv_id", "turn", HI.history_section(F.col("history")).alias("section"))


@query("cache_key")
def q_cache_key(spark, d):
    r = _requests_with_history(spark, d)
    return r.select("conv_id", "turn", T.cache_key(_rewritten(r), F.col("semester"), F.col("subject"),
                                                   F.col("history")).alias("key"))


@query("query_generic")
def q_query_generic(spark, d):
    r = fx.requests(spark, d)
    g = DG.is_generic(F.col("query"), F.col("subject"))
    return r.select("conv_id", "turn", g.alias("is_generic"),
                    F.when(g, DG.generic_rewrite(F.col("subject"))).alias("rewritten"))


@query("query_prefix")
def q_query_prefix(spark, d):
    r = fx.requests(spark, d)
    return r.select("conv_id", "turn", DG.with_subject_prefix(F.col("query"), F.col("subject")).alias("enhanced"))


@query("query_clear")
def q_query_clear(spark, d):
    r = fx.requests(spark, d)
    return r.select("conv_id", "turn",
                    DG.is_clear(DG.with_subject_prefix(F.col("query"), F.col("subject"))).alias("is_clear"))


def _next_reply(spark, d):
    """The assistant message right after a message, by position."""
    m = HI.positions(fx.messages(spark, d))
    reply = m.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("position") - 1).alias("position"), F.col("text").alias("candidate"))
    return m.select("conv_id", "turn", "position").join(reply, ["conv_id", "position"]).drop("position")


@query("rewrite_validate")
def q_rewrite_validate(spark, d):
    r = _requests_with_history(spark, d).join(_next_reply(spark, d), ["conv_id", "turn"], "left")
    return r.select("conv_id", "turn", _rewritten(r, F.col("candidate")).alias("rewritten"))


@query("filter_note")
def q_filter_note(spark, d):
    r = fx.requests(spark, d)
    return r.select("conv_id", "turn", DG.filter_note(F.col("subject"), F.col("semester")).alias("note"))


# ====================================================================== cache
from lectern.operators import cache as CA  # noqa: E402

CACHE_SPLIT = "2024-01-15 00:00:00"


@query("cache_replay")
def q_cache_replay(spark, d):
    return CA.replay(fx.cache_requests(spark, d), DEFAULT.cache_ttl_seconds).select(
        "event_id", "hit", "stored_at_us")


@query("cache_lookup")
def q_cache_lookup(spark, d):
    ev = fx.cache_requests(spark, d)
    split = F.lit(CACHE_SPLIT).cast("timestamp")
    cache = (ev.where(F.col("ts") < split).groupBy("key").agg(F.max("ts").alias("stored_at"))
             .withColumn("expires_at", F.col("stored_at") + F.expr(f"INTERVAL {DEFAULT.cache_ttl_seconds} SECONDS"))
             .withColumn("response", F.lit("cached answer")))
    out = CA.lookup(ev.where(F.col("ts") >= split), cache)
    return out.select("event_id", "hit")


# ====================================================================== incremental ingest
from lectern.operators import incremental as INC  # noqa: E402


def _snapshot_files(spark, d, which):
    return INC.fingerprint(fx.snapshot(spark, d, which).where(P.is_document_path(F.col("path"))))


def _records(files, version):
    el = files.select("path", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return el.select(F.concat(F.col("path"), F.lit("#"), (F.col("pos") + 1).cast("string")).alias("record_id"),
                     "path", F.lit(version).cast("long").alias("version"), F.md5("line").alias("content_md5"))


@query("unchanged_antijoin")
def q_unchanged_antijoin(spark, d):
    a = _snapshot_files(spark, d, "A")
    b = _snapshot_files(spark, d, "B")
    return INC.changed_files(b, a.select("path", "md5")).select("doc_id", "path", "md5")


@query("upsert_latest")
def q_upsert_latest(spark, d):
    a = _snapshot_files(spark, d, "A")
    b = _snapshot_files(spark, d, "B")
    store = _records(a, 1)
    updates = _records(INC.changed_files(b, a.select("path", "md5")), 2)
    return INC.replace_files(store, updates).select("record_id", "version", "content_md5")


def _bucketed(spark, d):
    """Snapshot A written, then snapshot B's changed files put in their place."""
    a = _snapshot_files(spark, d, "A")
    b = _snapshot_files(spark, d, "B")
    updates = materialise(_records(INC.changed_files(b, a.select("path", "md5")), 2), "updates")
    store = BucketedStore(spark, scratch_path(spark, f"bucketed-{uuid.uuid4().hex}"), updates.schema, "path", 64)
    store.rebuild(_records(a, 1))
    store.replace_files(updates)
    return store


@query("bucketed_upsert")
def q_bucketed_upsert(spark, d):
    return _bucketed(spark, d).read().select("record_id", "version", "content_md5")


@query("store_count")
def q_store_count(spark, d):
    return _bucketed(spark, d).sizes().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_records"))


@query("rebuild_counts")
def q_rebuild_counts(spark, d):
    kb_docs = KB.flatten_kb(fx.kb(spark, d)).select(F.lit(1).alias("is_kb"))
    el = fx.file_elements(spark, d).where(P.is_document_path(F.col("path")))
    chunks = chunking.chunk_elements(el.select(F.col("path").alias("file"), F.col("element_no").alias("ord"), "text"))
    u = kb_docs.unionByName(chunks.select(F.lit(0).alias("is_kb")))
    return u.agg(F.sum("is_kb").cast("long").alias("n_kb_docs"),
                 F.sum(1 - F.col("is_kb")).cast("long").alias("n_file_chunks"),
                 F.count(F.lit(1)).alias("n_total")) \
        .withColumn("n_batches", INC.batch_counts(F.col("n_total"), DEFAULT.embed_batch))


# ====================================================================== RAG over document chunks
from lectern.operators import embed as EM  # noqa: E402

# Requests retrieve over hashed bag-of-words vectors of document chunks with
# the default cut-offs (threshold 0.60, isolation floor 0.55, gap 0.10, cap 3).
RAG = DEFAULT


def _chunk_store(spark, d):
    c = _chunks(spark, d)
    did = F.col("doc_id")
    return c.select(
        F.concat_ws("_", did.cast("string"), F.col("chunk_no").cast("string"),
                    F.coalesce(F.col("chunk_part"), F.lit(0)).cast("string")).alias("chunk_id"),
        "doc_id", "content",
        (did % 8 + 1).cast("int").alias("semester"),
        F.concat(F.lit("subject_"), (did % 10).cast("string")).alias("subject"),
        F.lit(0).alias("unit_number"), F.lit("").alias("unit_name"),
        F.coalesce(F.col("slide_number"), F.lit(0)).alias("slide_number"),
        F.concat(F.lit("doc_"), did.cast("string"), F.lit(".txt")).alias("source_filename"))


def _rag_requests(spark, d):
    r = _requests_with_history(spark, d)
    r = r.select("conv_id", "turn", "query", "semester", "subject", "history",
                 _rewritten(r).alias("rewritten"),
                 F.concat_ws(":", "conv_id", "turn").alias("query_id"))
    return EM.hashed_embedding(r, ["query_id"], "rewritten")


_STORE_META = ["doc_id", "content", "semester", "subject", "unit_number", "unit_name", "slide_number",
               "source_filename"]


def _rag_hits(spark, d, p: Params = RAG):
    # both sides are costly to derive and read more than once: chunk vectors, then texts of the hits
    store = materialise(EM.hashed_embedding(_chunk_store(spark, d), ["chunk_id"], "content"), "chunk-store")
    req = materialise(_rag_requests(spark, d), "requests")
    hits = knn_join(req, store, p.top_k, p, corpus_id="chunk_id", query_semester="semester",
                    query_subject="subject", min_score=p.threshold, carry=_STORE_META, normalize="after")
    return retrieval.precision_filter(retrieval.threshold(hits, p), p), req


def _rag_answers(spark, d):
    hits, req = _rag_hits(spark, d)
    return req.join(retrieval.answer_parts(hits), "query_id", "left")


@query("prompt")
def q_prompt(spark, d):
    a = _rag_answers(spark, d)
    pr = DG.build_prompt(F.lit(DG.DEFAULT_SYSTEM_PROMPT), F.col("query"), F.coalesce(F.col("context_text"), F.lit("")),
                         F.col("subject"), F.col("semester"), HI.history_section(F.col("history")))
    return a.select("conv_id", "turn", pr.alias("prompt"))


@query("response_record")
def q_response_record(spark, d):
    a = _rag_answers(spark, d)
    srcs = F.coalesce(F.col("sources"), F.array())
    return a.select(
        "conv_id", "turn", F.col("rewritten").alias("rewritten_query"),
        F.lit(False).alias("was_cached"), F.lit(False).alias("should_refuse"),
        F.size(srcs).cast("long").alias("n_sources"),
        F.array_join(F.transform(srcs, lambda x: F.concat(x["citation"], F.lit(" @ "),
                                                          F.format_number(x["similarity_score"], 4))), " || ")
        .alias("sources_text"))


_OFFSETS = (0, 3_600, 172_800)      # every request comes again after an hour and after two days


@query("answer_replay")
def q_answer_replay(spark, d):
    """L4 over a log in which every request comes three times, and once more (``:empty``) to an empty collection."""
    from lectern.plans import replay
    store = materialise(EM.hashed_embedding(_chunk_store(spark, d), ["chunk_id"], "content"), "chunk-store")
    requests = _requests_with_history(spark, d)

    def log(rows, *end):
        return rows.select(F.concat_ws(":", "conv_id", "turn", "off", *[F.lit(x) for x in end]).alias("request_id"),
                           F.timestamp_seconds(F.col("conv_id") * 600 + F.col("off")).alias("ts"),
                           "query", "semester", "subject", "history")

    full = log(requests.withColumn("off", F.explode(F.array(*[F.lit(x) for x in _OFFSETS]))))
    empty = log(requests.withColumn("off", F.lit(0)), "empty")
    embed = lambda x: EM.hashed_embedding(x, ["query_id"], "rewritten")
    got = [replay.answer_requests(r, s, embed, RAG, normalize="after") for r, s in ((full, store), (empty, store.limit(0)))]
    src = lambda x: F.concat_ws("~", *[x[c].cast("string") for c in (
        "slide_number", "subject", "unit_name", "unit_number", "semester", "source_filename", "citation")],
        F.format_number(x["similarity_score"], 4))
    return got[0].unionByName(got[1]).select(
        "request_id", "rewritten_query", "was_cached", "should_refuse", F.size("sources").cast("long").alias("n_sources"),
        F.array_join(F.transform("sources", src), " || ").alias("sources_text"))


@query("catalog_lists")
def q_catalog_lists(spark, d):
    """The distinct semesters with their subjects, in order, for a selection list."""
    from lectern.plans import catalog
    return catalog.lists(KB.flatten_kb(fx.kb(spark, d)))


@query("hash_embed")
def q_hash_embed(spark, d):
    return EM.hashed_counts(load(spark, d, "documents"), ["doc_id"], "text")


# ====================================================================== streaming (rows-only checks)
from lectern.streaming import cache_stream as STC  # noqa: E402
from lectern.streaming import common as STM  # noqa: E402
from lectern.streaming import history_stream as STH  # noqa: E402
from lectern.streaming import ingest_stream as STI  # noqa: E402


@query("stream_cache")
def q_stream_cache(spark, d):
    ev = STM.table_stream(spark, d, "events")
    req = ev.select("event_id", F.col("ts").cast("timestamp").alias("ts"),
                    F.concat_ws("|", F.col("user_id").cast("string"), F.col("event_type")).alias("key"))
    out = STC.cache_stream(req, DEFAULT.cache_ttl_seconds)
    return STM.run_to_parquet(out, spark, "stream_cache").select("event_id", "hit", "stored_at_us")


@query("stream_history")
def q_stream_history(spark, d):
    m = STM.table_stream(spark, d, "conversations")
    return STM.run_to_parquet(STH.history_stream(m, DEFAULT.history_prompt), spark, "stream_history")


_RECORD_SCHEMA = "record_id string, path string, version long, content_md5 string"


@query("stream_ingest")
def q_stream_ingest(spark, d):
    docs = STM.table_stream(spark, d, "documents")
    i = F.col("doc_id")
    # same path derivation as fixtures.file_paths, applied to the stream
    files = fx.file_paths_of(docs).where(P.is_document_path(F.col("path")))
    base = STM.run_dir(spark, "stream_ingest")
    return STI.run_ingest(files, base, _records, _RECORD_SCHEMA).select("record_id", "version", "content_md5")
