"""Link discovery over HTML pages and the manifest.

Pages go once through the tokenizer of ``functions.html``, in Arrow batches (a narrow map); everything after
the links' raw attributes is column expressions. A link's text is that of the text nodes inside it, each
stripped, joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import links as L
from lectern.functions.html import page_items
from lectern.functions.text import safe_name

DRIVE_HOST = r"drive\.google\.com"
SCRIPT_URL = r"https?://drive\.google\.com/[^\s\"'<>]+"


def _items(pages: DataFrame, keep: list[str], kinds: str = "afs") -> DataFrame:
    """One row per anchor (``a``), iframe (``f``) and URL in a script (``s``) of every page:
    ``page_id, *keep, kind, pos (1-based within the kind), link, text, data_file``."""
    rows = pages.where(F.col("html").isNotNull()).select("page_id", *keep, "html")
    found = [T.StructField("kind", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("link", T.StringType()),
             T.StructField("text", T.StringType()), T.StructField("data_file", T.StringType())]
    schema = T.StructType([*rows.select("page_id", *keep).schema.fields, *found])
    url = re.compile(SCRIPT_URL)

    def items(page: str) -> Iterator[tuple]:
        in_scripts = 0
        for item in page_items(page):
            if item[0] not in kinds:
                continue
            if item[0] != "s":
                yield item
                continue
            for m in url.finditer(item[2]):
                in_scripts += 1
                yield "s", in_scripts, m[0], None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], []
            for i, page in enumerate(b.column("html")):
                for item in items(page.as_py()):
                    at.append(i)
                    out.append(item)
                if len(out) > 20_000 or (out and i + 1 == b.num_rows):
                    take = pa.array(at, pa.int32())
                    cols = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()))]
                    yield pa.RecordBatch.from_arrays([b.column(c).take(take) for c in ("page_id", *keep)] + cols, names=schema.names)
                    at, out = [], []

    return rows.mapInArrow(run, schema)


def anchors(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every ``<a>`` of every page: ``page_id, *keep, pos (1-based), href, text, data_file``."""
    return _items(pages, list(keep), "a").select("page_id", *keep, "pos", F.col("link").alias("href"), "text", "data_file")


def _candidate(strategy: int, name, rtype, url, data_file):
    d = L.drive_id(url)
    return F.struct(F.lit(strategy).alias("strategy"), name.alias("name"), rtype.alias("resource_type"),
                    url.alias("drive_url"), d["drive_id"].alias("drive_id"), d["drive_type"].alias("drive_type"),
                    data_file.alias("data_file"))


def _resources(pages: DataFrame) -> DataFrame:
    """P15 strategies 1-4 as candidate rows (before J5)."""
    keep = [c for c in ("subject", "semester", "url") if c in pages.columns]
    it = _items(pages, keep)
    link, data_file, none = F.col("link"), F.col("data_file"), F.lit(None).cast("string")
    is_a, is_f, is_s = F.col("kind") == "a", F.col("kind") == "f", F.col("kind") == "s"
    name = F.coalesce(F.nullif(F.col("text"), F.lit("")), F.lit("Resource"))
    found = L.drive_id(link)
    c1 = F.when(is_a & link.rlike(DRIVE_HOST), _candidate(1, name, L.resource_class(name), link, data_file))
    c2 = F.when(is_a & L.is_viewer_link(link), _candidate(2, name, L.resource_class(name), L.viewer_target(link), data_file))
    c3 = F.when(is_f & link.contains("drive.google.com"),
                _candidate(3, F.concat(F.lit("Embedded "), F.coalesce(found["drive_type"], F.lit("resource"))), F.lit("other"),
                           link, none))
    c4 = F.when(is_s & found["drive_id"].isNotNull(),
                _candidate(4, F.concat(F.lit("Script-embedded "), F.coalesce(found["drive_type"], F.lit("resource"))),
                           F.lit("other"), link, none))
    cands = F.filter(F.array(c1, c2, c3, c4), lambda x: x.isNotNull())
    return (it.select("page_id", *keep, "pos", F.explode(cands).alias("r"))
            .select("page_id", *keep, "r.strategy", "pos", "r.name", "r.resource_type", "r.drive_url",
                    "r.drive_id", "r.drive_type", "r.data_file"))


def page_resources(pages: DataFrame) -> DataFrame:
    """P15 strategies 1-3: drive anchors, viewer anchors, drive iframes (bag union)."""
    return _resources(pages).where(F.col("strategy") < 4)


def all_resources(pages: DataFrame) -> DataFrame:
    """U2 + J5: strategies 1-3 (bag) then script URLs whose drive id is new to the
    page (first occurrence kept), with the page's subject. One window over
    ``(page_id, drive_id)`` replaces the anti-join, so pages are read once."""
    r = _resources(pages)
    w_id = Window.partitionBy("page_id", "drive_id")
    w_s4 = Window.partitionBy("page_id", "drive_id", F.col("strategy") == 4).orderBy("pos")
    r = (r.withColumn("_seen", F.max(F.when(F.col("strategy") < 4, 1).otherwise(0)).over(w_id))
         .withColumn("_first", F.row_number().over(w_s4)))
    keep = (F.col("strategy") < 4) | ((F.col("_seen") == 0) & (F.col("_first") == 1))
    return r.where(keep).drop("_seen", "_first").withColumnRenamed("url", "source_page_url")


def subject_links(pages: DataFrame, base_url: str) -> DataFrame:
    """Anchors to ``/semesters/{n}/subjects/...`` of the page's semester.
    Name = anchor text, else the URL-decoded tail; the looser fallback rule
    applies only to pages where the primary rule found nothing (one window per
    page instead of an anti-join, so pages are read once)."""
    a = anchors(pages, keep=("semester",)).where(F.col("href").isNotNull())
    marker = F.concat(F.lit("/semesters/"), F.col("semester").cast("string"), F.lit("/subjects/"))
    after = F.get(F.split(F.col("href"), "/subjects/"), 1)
    tail = F.regexp_replace(F.coalesce(F.try_url_decode(after), after), r"^/+|/+$", "")
    pname = F.coalesce(F.nullif(F.col("text"), F.lit("")), tail)
    primary = F.col("href").contains(marker) & (F.coalesce(pname, F.lit("")) != "")
    sem_dir = F.concat(F.lit("/semesters/"), F.col("semester").cast("string"), F.lit("/"))
    fallback = F.col("href").contains(sem_dir) & F.col("href").contains("/subjects/") & (F.col("text") != "")
    a = a.withColumn("_p", primary).withColumn(
        "_page_has_p", F.max(F.col("_p").cast("int")).over(Window.partitionBy("page_id")))
    return (a.where(F.col("_p") | ((F.col("_page_has_p") == 0) & fallback))
            .select("page_id", "pos", F.when(F.col("_p"), pname).otherwise(F.col("text")).alias("name"),
                    L.absolutize(F.col("href"), base_url).alias("url"), "semester"))


def download_plan(resources: DataFrame) -> DataFrame:
    """F5 + simulated acquisition: resources with a drive id get a local path
    (``data/semester_n/<safe subject>/<file>``; folders keep the directory) and
    a content fingerprint; others are skipped."""
    has_id = F.col("drive_id").isNotNull()
    tdir = F.concat(F.lit("data/semester_"), F.col("semester").cast("string"), F.lit("/"), safe_name(F.col("subject")))
    fname = F.coalesce(F.col("data_file"), F.nullif(safe_name(F.col("name")), F.lit("")), F.col("drive_id"))
    local = (F.when(~has_id, F.lit(None))
             .when(F.col("drive_type") == "folder", tdir)
             .otherwise(F.concat(tdir, F.lit("/"), fname)))
    md5 = F.when(has_id & (F.col("drive_type") != "folder"), F.md5(F.col("drive_id")))
    return resources.select("*", local.alias("local_path"), has_id.alias("downloaded"), md5.alias("md5_hash"))


def manifest_order(res: DataFrame) -> DataFrame:
    """Resource order of the manifest: subjects in page order, resources in discovery order."""
    return res.withColumn("ord", F.struct("page_id", "strategy", "pos"))


def manifest_totals(pages: DataFrame, res: DataFrame) -> DataFrame:
    """A2: semesters, subjects, resources and downloads, as one aggregate over
    the union of subject and resource rows (no join needed)."""
    u = (pages.select(F.lit(1).alias("is_subject"), "semester", F.lit(False).alias("downloaded"))
         .unionByName(res.select(F.lit(0).alias("is_subject"), F.lit(None).cast("int").alias("semester"),
                                 "downloaded")))
    return u.agg(
        F.countDistinct(F.when(F.col("is_subject") == 1, F.col("semester"))).alias("total_semesters_scraped"),
        F.sum("is_subject").cast("long").alias("total_subjects"),
        F.sum(1 - F.col("is_subject")).cast("long").alias("total_resources"),
        F.count(F.when(F.col("downloaded"), 1)).alias("total_downloaded"))


def manifest_subjects(pages: DataFrame, res: DataFrame) -> DataFrame:
    """A3: nested manifest rows: one subject with its ordered resources."""
    rs = manifest_order(res)
    nested = rs.groupBy("page_id").agg(
        F.sort_array(F.collect_list(F.struct("ord", "name", "resource_type", "semester", "subject", "drive_url",
                                             "drive_id", "drive_type", "local_path", "downloaded", "md5_hash",
                                             "source_page_url"))).alias("_r"))
    return (pages.select("page_id", F.col("subject").alias("name"), "semester", "url")
            .join(nested, "page_id", "left")
            .select("page_id", "name", "semester", "url",
                    F.transform("_r", lambda x: x.dropFields("ord")).alias("resources")))


def path_hash_map(res: DataFrame) -> DataFrame:
    """Local path -> md5 for downloaded resources (both non-empty; last wins)."""
    rs = manifest_order(res).where((F.coalesce("local_path", F.lit("")) != "") & (F.coalesce("md5_hash", F.lit("")) != ""))
    return rs.groupBy("local_path").agg(F.max_by("md5_hash", "ord").alias("md5_hash"))
