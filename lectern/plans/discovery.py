"""Discovery over crawled pages -> resources, manifest rows, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lectern.operators import links


def build_manifest(subject_pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``subject_pages(page_id, url, subject, semester, html)`` ->
    ``(resources, subjects (nested A3), totals (A2))``."""
    res = links.manifest_order(links.download_plan(links.all_resources(subject_pages)))
    return res, links.manifest_subjects(subject_pages, res), links.manifest_totals(subject_pages, res)
