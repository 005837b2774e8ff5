"""File discovery, fingerprints and element extraction."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.paths import is_document_path


def discover(spark: SparkSession, root: str, excluded: str = "dsai_syllabus.pdf") -> DataFrame:
    """Every document file under ``root`` (recursive), content not read.

    Extension filtering is done on ``lower(path)`` because ``pathGlobFilter`` is
    case-sensitive. Output ``path, length, modificationTime``.
    """
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
          .select("path", "length", "modificationTime"))
    return df.where(is_document_path(F.col("path"), excluded))


def fingerprints(spark: SparkSession, root: str) -> DataFrame:
    """``path, md5`` of every document file (reads the bytes once, in tasks)."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return df.where(is_document_path(F.col("path"))).select("path", F.md5("content").alias("md5"))


def text_elements(docs: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """S4 for text: ordered line elements ``path, element_no (1-based, P6), text``."""
    return (docs.select(path, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "text"))
            .select(path, (F.col("pos") + 1).cast("int").alias("element_no"), "text"))


Extractor = Callable[[str, bytes], list[str]]


def binary_elements(spark: SparkSession, root: str, extractor: Extractor,
                    single: Extractor | None = None) -> tuple[DataFrame, DataFrame]:
    """S4/U4 hook for binary formats: ``extractor(path, bytes) -> [element texts]``
    runs inside tasks via ``mapInPandas``. Unreadable files go to a quarantine
    frame (path, error) instead of stopping the job; an empty extraction is tried
    again with ``single`` (the whole file as one element), if given, and is an
    empty element list otherwise. Returns ``(elements, quarantine)``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root) \
        .where(is_document_path(F.col("path"))).select("path", "content")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"]):
                try:
                    found = extractor(p, bytes(content))
                    if not found and single is not None:
                        found = single(p, bytes(content))
                    for i, t in enumerate(found):
                        rows.append((p, i + 1, t, None))
                except Exception as e:  # noqa: BLE001 - quarantined
                    rows.append((p, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "element_no", "text", "error"])

    out = files.mapInPandas(run, "path string, element_no int, text string, error string")
    return (out.where(F.col("error").isNull()).drop("error"),
            out.where(F.col("error").isNotNull()).select("path", "error"))
