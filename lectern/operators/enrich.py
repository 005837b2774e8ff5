"""Element enrichment and metadata flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import paths as P
from lectern.functions.text import basename


def path_metadata(files: DataFrame, path: str = "path") -> DataFrame:
    """P1-P3 (+P5): semester, subject, file name and file-name unit of each path."""
    p = F.col(path)
    return files.withColumns({
        "semester": P.semester_from_path(p),
        "subject": P.subject_from_path(p),
        "source_filename": basename(p),
        "unit_from_name": P.unit_from_filename(basename(p)),
    })


def manifest_urls(resources: DataFrame) -> DataFrame:
    """J1 build side: (semester, file name) -> source page URL of the FIRST
    matching resource in manifest order. One row per key, so the join cannot
    multiply elements; Catalyst/AQE choose broadcast only if it is small."""
    r = resources.where(F.coalesce(F.col("local_path"), F.lit("")) != "")
    return (r.groupBy(F.col("semester").alias("m_semester"), basename(F.col("local_path")).alias("m_file"))
            .agg(F.min_by("source_page_url", "ord").alias("manifest_url")))


def enrich_files(files: DataFrame, resources: DataFrame | None = None, path: str = "path") -> DataFrame:
    """P1-P3 + J1 once per FILE (not per element): path metadata and the
    manifest source URL ('' when absent)."""
    f = path_metadata(files, path)
    if resources is None:
        return f.withColumn("source_url", F.lit(""))
    m = manifest_urls(resources)
    j = f.join(m, (f["semester"] == m["m_semester"]) & (f["source_filename"] == m["m_file"]), "left")
    return (j.drop("m_semester", "m_file")
            .withColumn("source_url", F.coalesce(F.col("manifest_url"), F.lit(""))).drop("manifest_url"))


def explode_elements(files_meta: DataFrame, text) -> DataFrame:
    """S4 + P6 + P7 on enriched files: ordered line elements with the unit taken
    from the file name, else from the element's own text (P4)."""
    e = files_meta.select("*", F.posexplode(F.split(text, "\n")).alias("_pos", "element_text"))
    return (e.withColumn("element_no", (F.col("_pos") + 1).cast("int"))
            .withColumn("slide_number", F.col("element_no"))
            .withColumn("unit_number", F.when(F.col("unit_from_name") != 0, F.col("unit_from_name"))
                        .otherwise(P.unit_from_content(F.col("element_text"))))
            .drop("_pos"))


def int_list_text(a: Column) -> Column:
    """P8 for int lists: the JSON text a Python writer produces (``[1, 2]``)."""
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), ", "), F.lit("]"))


def flatten_scalar(c: Column) -> Column:
    """P8 for scalars: NULL -> '', everything else its string form."""
    return F.coalesce(c.cast("string"), F.lit(""))


def parse_int_list(c: Column) -> Column:
    """P20: JSON text -> array<int>, empty array when it does not parse."""
    return F.coalesce(F.from_json(c, "array<int>"), F.array().cast("array<int>"))
