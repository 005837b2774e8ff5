"""ingestion = KB documents U chunked file elements -> embedded store rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import chunking, embed, enrich, incremental, kb
from lectern.params import DEFAULT, Params

STORE_META = ["semester", "subject", "unit_number", "unit_name", "slide_number", "source_filename",
              "source_url", "source_type"]


def file_chunks(files: DataFrame, resources: DataFrame | None = None, params: Params = DEFAULT) -> DataFrame:
    """Tag ``files(path, text)`` once per file (P1-P3, J1), cut them into
    elements (S4, P4-P7) and chunk per file (W1)."""
    tagged = enrich.explode_elements(enrich.enrich_files(files, resources), F.col("text"))
    meta = ["semester", "subject", "unit_number", "source_filename", "source_url"]
    ch = chunking.chunk_elements(tagged.select(F.col("path").alias("file"), F.col("element_no").alias("ord"),
                                               F.col("element_text").alias("text"), *meta),
                                 meta_cols=meta, params=params)
    return ch.select(
        F.concat_ws("_", F.col("file"), F.col("slide_number").cast("string"), F.col("chunk_no").cast("string"),
                    F.coalesce(F.col("chunk_part"), F.lit(0)).cast("string")).alias("chunk_id"),  # P23
        F.col("file").alias("path"), "content", "n_tokens", "chunk_part", "total_parts", "slides_covered",
        *meta, "slide_number", F.lit("").alias("unit_name"), F.lit("file").alias("source_type"))


def kb_chunks(kb_table: DataFrame, texts: kb.KbTexts = kb.DEFAULT_TEXTS) -> DataFrame:
    d = kb.flatten_kb(kb_table, texts)
    return d.select(
        F.concat_ws("_", F.col("source_filename"), F.col("unit_name")).alias("chunk_id"),
        F.col("source_filename").alias("path"), "content", F.lit(None).cast("long").alias("n_tokens"),
        F.lit(None).cast("int").alias("chunk_part"), F.lit(None).cast("int").alias("total_parts"),
        F.array(F.lit(1)).alias("slides_covered"), "semester", "subject", F.lit(0).alias("unit_number"),
        "source_filename", F.lit("").alias("source_url"), "slide_number", "unit_name",
        F.col("source_type"))


def ingest(files: DataFrame, kb_table: DataFrame | None = None, resources: DataFrame | None = None,
           params: Params = DEFAULT) -> DataFrame:
    """KB documents U chunked files (``files(path, text)``), embedded with the
    default hashed embedder (U2)."""
    rows = file_chunks(files, resources, params)
    if kb_table is not None:
        rows = kb_chunks(kb_table).unionByName(rows, allowMissingColumns=True)  # U-union 1
    return embed.hashed_embedding(rows, ["chunk_id"], "content", params.embed_dim)


def counts(store_rows: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """A10: KB documents, file chunks, total and embedding batches."""
    is_kb = (F.col("source_type") == "syllabus_kb").cast("long")
    return (store_rows.agg(F.sum(is_kb).alias("n_kb_docs"), F.sum(1 - is_kb).alias("n_file_chunks"),
                           F.count(F.lit(1)).alias("n_total"))
            .withColumn("n_batches", incremental.batch_counts(F.col("n_total"), params.embed_batch)))
