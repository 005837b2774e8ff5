"""Sources/sinks and composite plans on small local inputs."""

import os
import tempfile

from pyspark.sql import functions as F

from lectern.plans import discovery, ingest, replay, retrieve
from lectern.sources import fixtures as fx
from lectern.sources import manifest, store
from lectern.sources.files import discover, fingerprints, text_elements
from tests.conftest import SF_SMALL


def test_binary_discovery_case_and_exclusion(spark):
    root = tempfile.mkdtemp(prefix="lectern-files-")
    for rel in ["semester_1/a/u1.PDF", "semester_1/a/x.pptx", "semester_2/b/dsai_syllabus.pdf", "c/notes.txt"]:
        p = os.path.join(root, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "wb") as f:
            f.write(rel.encode())
    got = sorted(r["path"].split(root)[1] for r in discover(spark, root).collect())
    assert got == ["/semester_1/a/u1.PDF", "/semester_1/a/x.pptx"]
    assert fingerprints(spark, root).count() == 2


def test_manifest_roundtrip_and_versions(spark):
    pages = fx.subject_pages(spark, SF_SMALL)
    res, subjects, totals = discovery.build_manifest(pages)
    base = tempfile.mkdtemp(prefix="lectern-manifest-")
    manifest.write_manifest(subjects, totals, base + "/m", "2026-01-01T00:00:00")
    t, subj = manifest.read_manifest(spark, base + "/m")
    tr = t.first()
    assert t.count() == 1 and tr["scraped_at"] == "2026-01-01T00:00:00"
    assert tr["total_resources"] == res.count() and subj.count() == pages.count()
    flat = manifest.manifest_resources(subj)
    assert flat.count() == res.count()
    got = [r["drive_id"] for r in flat.orderBy("ord").collect()]
    assert got == [r["drive_id"] for r in res.orderBy("ord").collect()]   # manifest order kept
    assert manifest.read_manifest(spark, base + "/missing") is None
    v1 = store.write_version(flat, base + "/store")
    v2 = store.rebuild(flat.limit(3), base + "/store")
    assert (v1, v2) == (1, 2) and store.read_latest(spark, base + "/store", flat.schema).count() == 3


def test_ingest_retrieve_replay(spark):
    files = fx.file_paths(spark, SF_SMALL).where("doc_id < 20")
    assert text_elements(files).count() > 20
    rows = ingest.ingest(files.select("path", "text"), fx.kb(spark, SF_SMALL))
    c = ingest.counts(rows).first()
    assert c["n_kb_docs"] > 0 and c["n_file_chunks"] > 0 and c["n_batches"] == -(-c["n_total"] // 32)
    q = rows.limit(5).select(F.monotonically_increasing_id().alias("query_id"), "embedding")
    hits, results = retrieve.retrieve(q, rows, normalize="after")
    assert results.count() == 5 and hits.where("rank = 1").count() == 5  # each finds itself
    req = spark.createDataFrame([(1, 0, "q", 1, "S"), (2, 10, "q", 1, "S"), (3, 90000, "q", 1, "S")],
                                "request_id long, t long, rewritten string, semester int, subject string") \
        .select("request_id", F.timestamp_seconds("t").alias("ts"), "rewritten", "semester", "subject",
                F.array().cast("array<struct<role:string,content:string>>").alias("history"))
    hits_by_id = {r["request_id"]: r["hit"] for r in replay.replay_requests(req).collect()}
    assert hits_by_id == {1: False, 2: True, 3: False}
