"""Inputs of the engine derived by Spark from the generated tables.

Each derivation is documented in FIXTURES.md and mirrored by a SQL CTE in
``lectern.oracle`` so that the DuckDB oracle reads the same rows. All of them
are narrow projections/explodes of whole tables, so their size grows with the
data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.sources.tables import load


def _s(c):
    return F.col(c).cast("string")


# ---------------------------------------------------------------- vectors
def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored chunk vectors: ``embeddings`` with chunk metadata derived from ids."""
    e = load(spark, sf_dir, "embeddings")
    v = F.col("vec_id")
    return e.select(
        v.alias("chunk_id"), "embedding", "label",
        F.concat(F.lit("subject_"), _s("label")).alias("subject"),
        (v % 8 + 1).cast("int").alias("semester"),
        (v % 5 + 1).cast("int").alias("unit_number"),
        F.when(v % 2 == 0, F.concat(F.lit("Unit "), (v % 5 + 1).cast("string"))).otherwise(F.lit(""))
        .alias("unit_name"),
        (v % 12).cast("int").alias("slide_number"),
        F.concat(F.lit("notes_"), _s("label"), F.lit(".pdf")).alias("source_filename"),
        F.concat(F.lit("https://example.org/notes/"), _s("label")).alias("source_url"),
        F.concat(F.lit("["), (v % 12).cast("string"), F.lit("]")).alias("slides_covered_json"),
        F.concat(F.lit("passage "), v.cast("string")).alias("content"),
    )


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored vector also asks a question (self excluded at match time),
    with per-query metadata filters on some of them."""
    e = load(spark, sf_dir, "embeddings")
    v = F.col("vec_id")
    return e.select(
        v.alias("query_id"), "embedding",
        F.when(v % 3 == 0, (v % 8 + 1)).otherwise(F.lit(0)).cast("int").alias("q_semester"),
        F.when(v % 4 == 1, F.concat(F.lit("subject_"), _s("label"))).alias("q_subject"),
    )


# ---------------------------------------------------------------- files / elements
def file_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One synthetic file path per document (variants by doc_id, see FIXTURES.md)."""
    return file_paths_of(load(spark, sf_dir, "documents"))


def file_paths_of(d: DataFrame) -> DataFrame:
    """``file_paths`` for any documents frame (batch or stream)."""
    i = F.col("doc_id")
    s = (i % 8 + 1).cast("string")
    u = (i % 5 + 1).cast("string")
    subj = F.concat(F.col("source"), F.lit("_"), F.col("lang"), F.lit("_notes"))
    sem_dir = F.concat(F.lit("data/semester_"), s, F.lit("/"), subj, F.lit("/"))
    v = i % 10
    path = (F.when(v <= 4, F.concat(sem_dir, F.lit("unit"), u, F.lit("_"), _s("doc_id"), F.lit(".pdf")))
            .when(v == 5, F.concat(sem_dir, F.lit("Module-"), u, F.lit("_"), _s("doc_id"), F.lit(".PPTX")))
            .when(v == 6, F.concat(F.lit("data/"), s, F.lit("/"), subj, F.lit("/ch"), u, F.lit("_"),
                                   _s("doc_id"), F.lit(".pptx")))
            .when(v == 7, F.concat(sem_dir, F.lit("part_"), _s("doc_id"), F.lit("/lecture_notes.ppt")))
            .when(v == 8, F.concat(sem_dir, F.lit("DSAI_Syllabus.pdf")))
            .otherwise(F.concat(sem_dir, F.lit("summary_"), _s("doc_id"), F.lit(".docx"))))
    return d.select("doc_id", path.alias("path"), "text")


def unit_prefix(doc_id):
    """Content-unit phrase prefixed to a document's first element (raw text has none)."""
    v = doc_id % 6
    return (F.when(v == 0, F.concat(F.lit("Unit "), (doc_id % 8 + 1).cast("string"), F.lit(": ")))
            .when(v == 1, F.lit("UNIT IV "))
            .when(v == 2, F.concat(F.lit("Module "), (doc_id % 3 + 1).cast("string"), F.lit(" ")))
            .when(v == 3, F.lit("unit ix "))
            .when(v == 4, F.lit("each unit in "))
            .otherwise(F.lit("")))


def file_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's text cut into ordered elements (line = element)."""
    f = file_paths(spark, sf_dir)
    txt = F.concat(unit_prefix(F.col("doc_id")), F.col("text"))
    return (f.select("doc_id", "path", F.posexplode(F.split(txt, "\n")).alias("pos", "text"))
            .select("doc_id", "path", (F.col("pos") + 1).cast("int").alias("element_no"), "text"))


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as (file = doc_id, ordered line elements) for the chunker."""
    d = load(spark, sf_dir, "documents")
    return (d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
            .select(F.col("doc_id").cast("string").alias("file"), "doc_id",
                    (F.col("pos") + 1).cast("long").alias("ord"), "text"))


# ---------------------------------------------------------------- knowledge base
def kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested KB over every document: a subject per (source, hundred of doc_id), whose units map
    ``lang#doc_id`` -> text; a subject holds at most a hundred units however large the table is."""
    d = load(spark, sf_dir, "documents")
    part = F.floor(F.col("doc_id") / 100)
    num = F.substring("source", 4, 10).cast("int")
    units = d.groupBy("source", part.alias("part")).agg(F.map_from_entries(F.collect_list(
        F.struct(F.concat_ws("#", "lang", _s("doc_id")), "text"))).alias("units"))
    return units.select(F.concat(F.lit("Course "), F.col("source"), F.lit(" part "), F.col("part").cast("string")).alias("subject"),
                        (num % 7 + 1).cast("int").alias("semester"),
                        F.when(num % 3 == 0, F.lit("Python")).alias("language"),
                        "units")


# ---------------------------------------------------------------- pages / links
def subject_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as subject pages: page html plus synthetic drive, viewer, iframe,
    subject and script links built from page_id (raw pages have none)."""
    pg = load(spark, sf_dir, "pages")
    p = F.col("page_id")
    ps = _s("page_id")
    sem = (p % 8 + 1).cast("string")
    u = (p % 5 + 1).cast("string")
    name1 = (F.when(p % 4 == 0, F.concat(F.lit("Unit "), u, F.lit(" notes")))
             .when(p % 4 == 1, F.concat(F.lit("Lecture slides "), ps))
             .when(p % 4 == 2, F.lit("PYQ CT paper"))
             .otherwise(F.lit("Syllabus copy")))
    name3 = F.when(p % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("Module folder "), ps))
    subj_txt = F.when(p % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("Data Structures "), (p % 10).cast("string")))
    extra = F.concat(
        F.lit('<div class="res"><a href="https://drive.google.com/file/d/P'), ps,
        F.lit('/view" data-file="unit'), u, F.lit("_"), ps, F.lit('.pdf">'), name1, F.lit("</a>"),
        F.lit('<a href="https://drive.google.com/file/d/Q'), ps,
        F.lit('/view?usp=sharing" data-file="unit'), ((p + 8) % 5 + 1).cast("string"), F.lit("_"),
        (p + 8).cast("string"), F.lit('.pdf">Exam paper '), ps, F.lit("</a>"),
        F.lit('<a href="/folder-viewer?url=https%3A%2F%2Fdrive.google.com%2Fdrive%2Ffolders%2FF'), ps,
        F.lit('&amp;title=x">'), name3, F.lit("</a>"),
        F.lit('<a href="/file-viewer?title=none">Viewer '), ps, F.lit("</a>"),
        F.lit('<iframe src="https://drive.google.com/open?id=I'), ps, F.lit('" width="640"></iframe>'),
        F.lit('<a href="/semesters/'), sem, F.lit("/subjects/Data%20Structures%20"), (p % 10).cast("string"),
        F.lit('">'), subj_txt, F.lit("</a></div>"),
        F.lit('<script>window.__D={"f":["https://drive.google.com/file/d/S'), ps,
        F.lit('/view","https://drive.google.com/file/d/P'), ps,
        F.lit('/view","https://drive.google.com/file/d/S'), ps, F.lit('/view"]}</script>'))
    drive = "https://drive.google.com/file/d/"
    loose = F.concat(   # the other forms of attributes, comments, open anchors and character references
        F.lit(f"<div><a class='x' href='{drive}R"), ps, F.lit("/view'>Single &eacute;t&#233; "), ps,
        F.lit(f"</a><A HREF={drive}T"), ps, F.lit("/view>Unquoted <b>chapter</b> "), ps,
        F.lit(f'</A><a title="a > b" href="{drive}U'), ps, F.lit('/view">Greater &gt; less</a>'),
        F.lit(f'<!-- <a href="{drive}C'), ps, F.lit('/view">gone</a> -->'),
        F.lit(f'<ul><li><a href="{drive}V'), ps, F.lit(f'/view">First open<li><a href="{drive}W'), ps,
        F.lit(f'/view">Second open</ul>tail<a href = "{drive}X'), ps, F.lit('/view">Left <!-- note --> notes</div>'),
        F.lit(f"<script>var s=\"<a href='{drive}Y"), ps, F.lit("/view'>\";</script>"))
    return pg.select(
        "page_id", "url",
        F.concat(F.lit("subject_"), (p % 10).cast("string")).alias("subject"),
        (p % 8 + 1).cast("int").alias("semester"),
        F.concat(F.col("html"), extra, loose).alias("html"))


# ---------------------------------------------------------------- dialog
def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` with gaps between the turns of two conversations in three."""
    return with_gaps(load(spark, sf_dir, "conversations"))


def with_gaps(conversations: DataFrame) -> DataFrame:
    return conversations.withColumn("turn", F.col("turn") * (F.col("conv_id") % 3 + 1))


def request_prefix(conv_id, turn):
    v = (conv_id + turn) % 7
    return (F.when(v == 1, F.lit("Explain "))
            .when(v == 2, F.lit("Tell me about this subject: "))
            .when(v == 3, F.lit("What is the syllabus overview? "))
            .when(v == 4, F.lit("subject_3 "))
            .when(v == 5, F.lit("How does "))
            .when(v == 6, F.lit("Define unit "))
            .otherwise(F.lit("")))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user message is a request; semester/subject selections by conv_id."""
    m = messages(spark, sf_dir)
    c = F.col("conv_id")
    return m.where(F.col("role") == "user").select(
        "conv_id", "turn",
        F.concat(request_prefix(c, F.col("turn")), F.col("text")).alias("query"),
        F.when(c % 4 == 0, F.lit(None)).otherwise(c % 8 + 1).cast("int").alias("semester"),
        F.when(c % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("subject_"), (c % 10).cast("string")))
        .alias("subject"))


# ---------------------------------------------------------------- cache
def cache_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a request log: key = (user_id, event_type), event time = ts."""
    ev = load(spark, sf_dir, "events")
    return ev.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.concat_ws("|", F.col("user_id").cast("string"), F.col("event_type")).alias("key"))


# ---------------------------------------------------------------- snapshots
def snapshot(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """Two ingest snapshots of the file tree: A lacks doc_id % 7 == 0; B has every
    document, with changed text for doc_id % 10 == 0."""
    f = file_paths(spark, sf_dir)
    if which == "A":
        return f.where(F.col("doc_id") % 7 != 0)
    return f.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat(F.col("text"), F.lit("\nrevised")))
                        .otherwise(F.col("text")))
