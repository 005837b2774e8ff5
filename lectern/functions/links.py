"""Link parsing and resource classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Drive URL patterns in the order they are tried.
DRIVE_FOLDER = r"/folders/([a-zA-Z0-9_-]+)"
DRIVE_FILE = r"/file/d/([a-zA-Z0-9_-]+)"
DRIVE_OPEN = r"[?&]id=([a-zA-Z0-9_-]+)"
VIEWER_MARKERS = ["folder-viewer", "file-viewer", "secure-viewer"]

# Resource classes by ordered substring tests.
CLASS_RULES = [
    ("unit_notes", ["unit", "notes", "module", "chapter"]),
    ("pyq", ["pyq", "previous", "question", "ct", "exam"]),
    ("syllabus", ["syllabus"]),
]


def drive_id(url: Column) -> Column:
    """``struct(drive_id, drive_type)``: folder, then file, then ``?id=``; else nulls."""
    def grab(p):
        return F.when(url.rlike(p), F.regexp_extract(url, p, 1))
    ident = F.coalesce(grab(DRIVE_FOLDER), grab(DRIVE_FILE), grab(DRIVE_OPEN))
    kind = (F.when(url.rlike(DRIVE_FOLDER), F.lit("folder"))
            .when(url.rlike(DRIVE_FILE) | url.rlike(DRIVE_OPEN), F.lit("file")))
    return F.struct(ident.alias("drive_id"), kind.alias("drive_type"))


def resource_class(name: Column) -> Column:
    """unit_notes -> pyq -> syllabus -> other, by substring of the lower-cased name."""
    low = F.lower(name)
    out = F.lit("other")
    for cls, kws in reversed(CLASS_RULES):
        hit = None
        for kw in kws:
            cond = low.contains(kw)
            hit = cond if hit is None else (hit | cond)
        out = F.when(hit, F.lit(cls)).otherwise(out)
    return out


def is_viewer_link(href: Column) -> Column:
    cond = None
    for m in VIEWER_MARKERS:
        c = href.contains(m)
        cond = c if cond is None else (cond | c)
    return cond


def _form_decode(c: Column) -> Column:
    """Query decoding: ``+`` is a blank; a percent sign without two hex digits stays, the rest is decoded."""
    return F.try_url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def _unquote(c: Column) -> Column:
    """Percent decoding only: ``+`` stays."""
    return _form_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def viewer_target(href: Column) -> Column:
    """The ``url`` query parameter of a viewer link, decoded (query decoding,
    then one more percent-decoding pass as the original does); NULL if absent."""
    raw = F.regexp_extract(href, r"[?&]url=([^&#]*)", 1)
    return F.when(raw != "", _unquote(_form_decode(raw)))


def absolutize(href: Column, base_url: str) -> Column:
    """URL join of ``href`` against a base ending in '/'."""
    origin = F.regexp_extract(F.lit(base_url), r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]*)", 1)
    return (F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
            .when(href.startswith("//"), F.concat(F.lit("https:"), href))
            .when(href.startswith("/"), F.concat(origin, href))
            .otherwise(F.concat(F.lit(base_url), href)))
