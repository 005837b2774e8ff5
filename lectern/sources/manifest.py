"""Nested manifest JSON (one object per file, as the writer produces)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESOURCE = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("resource_type", T.StringType()),
    T.StructField("semester", T.IntegerType()), T.StructField("subject", T.StringType()),
    T.StructField("drive_url", T.StringType()), T.StructField("drive_id", T.StringType()),
    T.StructField("drive_type", T.StringType()), T.StructField("local_path", T.StringType()),
    T.StructField("downloaded", T.BooleanType()), T.StructField("md5_hash", T.StringType()),
    T.StructField("source_page_url", T.StringType())])
SUBJECT = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("semester", T.IntegerType()),
    T.StructField("url", T.StringType()), T.StructField("resources", T.ArrayType(RESOURCE))])
MANIFEST = T.StructType([
    T.StructField("scraped_at", T.StringType()), T.StructField("total_semesters_scraped", T.IntegerType()),
    T.StructField("total_subjects", T.IntegerType()), T.StructField("total_resources", T.IntegerType()),
    T.StructField("total_downloaded", T.IntegerType()), T.StructField("subjects", T.ArrayType(SUBJECT))])


def write_manifest(subjects: DataFrame, totals: DataFrame, path: str, scraped_at: str,
                   order: str = "page_id") -> None:
    """Write a manifest as two JSON folders: ``subjects`` (JSON lines, one
    subject per line with its nested resources and its manifest position
    ``subject_index``) and ``totals`` (one line with ``scraped_at`` and the
    A2 counts). No step gathers the whole manifest into one row or task."""
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in SUBJECT.fields]
    subjects.select(F.col(order).cast("long").alias("subject_index"), *cols) \
        .write.mode("overwrite").json(f"{path}/subjects")
    totals.select(F.lit(scraped_at).alias("scraped_at"), *[F.col(c).cast("int").alias(c) for c in totals.columns]) \
        .write.mode("overwrite").json(f"{path}/totals")


SUBJECT_LINE = T.StructType([T.StructField("subject_index", T.LongType())] + SUBJECT.fields)
TOTALS = T.StructType([f for f in MANIFEST.fields if f.name != "subjects"])


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """``(totals, subjects)`` of a manifest; ``None`` when it does not exist."""
    if not _exists(spark, f"{path}/subjects"):
        return None
    return (spark.read.schema(TOTALS).json(f"{path}/totals"),
            spark.read.schema(SUBJECT_LINE).json(f"{path}/subjects"))


def read_manifest_document(spark: SparkSession, path: str) -> DataFrame | None:
    """A single nested manifest document (as other tools write it), multi-line JSON allowed."""
    if not _exists(spark, path):
        return None
    return spark.read.schema(MANIFEST).option("multiLine", "true").json(path)


def manifest_resources(subjects: DataFrame) -> DataFrame:
    """Flatten subject lines to resource rows with their manifest order ``ord``."""
    r = subjects.select("subject_index", F.posexplode("resources").alias("ri", "r"))
    return r.select(F.struct("subject_index", "ri").alias("ord"), "r.*")


def document_resources(manifest: DataFrame) -> DataFrame:
    """Flatten a single nested manifest document the same way."""
    s = manifest.select(F.posexplode("subjects").alias("subject_index", "s"))
    return manifest_resources(s.select("subject_index", "s.resources"))
