"""Metadata parsed out of file paths, file names and element text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import basename, strip, subject_display

# What names a semester in a path part.
_SEM = r"(?i)semester[_\s-]*(\d+)"
_BARE = r"^\d+$"


def _number(digits: Column) -> Column:
    """INT of a digit string; NULL (as if the pattern had not matched) beyond the type's range."""
    return digits.try_cast("int")


def _is_bare_under_data(parts: Column, part: Column, parent_idx: Column) -> Column:
    """A bare number whose parent (at ``parent_idx``, 0-based) contains 'data'."""
    parent = F.try_element_at(parts, parent_idx + 1)
    return part.rlike(_BARE) & (parent_idx >= 0) & F.lower(parent).contains("data")


def semester_from_path(path: Column) -> Column:
    """The LAST path part naming a semester, else 0.

    A part names a semester if it matches ``semester[_ -]*N`` (any case), or is
    a bare number whose parent contains 'data'. As in the original, the parent
    of a bare number is looked up at the FIRST occurrence of an equal part.
    """
    parts = F.split(path, "/")
    idx = F.sequence(F.lit(1), F.size(parts))

    def sem_at(i):
        part = F.try_element_at(parts, i)
        first = F.array_position(parts, part).cast("int")  # 1-based first equal part
        return (F.when(part.rlike(_SEM), _number(F.regexp_extract(part, _SEM, 1)))
                .when(_is_bare_under_data(parts, part, first - 2), _number(part)))

    found = F.filter(F.transform(idx, sem_at), lambda v: v.isNotNull())
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(0))


def subject_from_path(path: Column) -> Column:
    """Directory right after the first semester part that is followed by a
    directory (not by the file itself), formatted (P5); else 'unknown'."""
    parts = F.split(path, "/")
    n = F.size(parts)
    idx = F.sequence(F.lit(1), n)

    def subj_at(i):
        part = F.try_element_at(parts, i)
        is_sem = part.rlike(_SEM) | _is_bare_under_data(parts, part, i - 2)
        return F.when(is_sem & (i + 1 < n), F.try_element_at(parts, i + 1))

    found = F.filter(F.transform(idx, subj_at), lambda v: v.isNotNull())
    return F.when(F.size(found) > 0, subject_display(F.try_element_at(found, F.lit(1)))).otherwise(F.lit("unknown"))


# File-name unit patterns, tried in this order; first match wins.
UNIT_FILENAME_PATTERNS = [
    r"unit[_\s-]*(\d+)",
    r"module[_\s-]*(\d+)",
    r"ch(?:apter)?[_\s-]*(\d+)",
    r"u(\d+)[_\s-]",
]


def unit_from_filename(name: Column) -> Column:
    """Unit number from a file name by the first matching pattern, else 0."""
    low = F.lower(name)
    out = F.lit(None).cast("int")
    for pat in reversed(UNIT_FILENAME_PATTERNS):
        out = F.when(low.rlike(pat), _number(F.regexp_extract(low, pat, 1))).otherwise(out)
    return F.coalesce(out, F.lit(0))


# Content unit patterns (arabic, roman I-VIII, module) and the roman table.
UNIT_CONTENT_ARABIC = r"unit[:\s-]*(\d+)"
UNIT_CONTENT_ROMAN = r"unit[:\s-]*(i{1,4}v?|vi{0,3})"
UNIT_CONTENT_MODULE = r"module[:\s-]*(\d+)"
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8}


def unit_from_content(text: Column) -> Column:
    """Unit from element text: arabic unit, then roman unit, then module; else 0.

    A roman capture outside the table (e.g. 'iiii') falls through to the next
    pattern, like the original's failed int() conversion.
    """
    low = F.lower(strip(text))
    roman_map = F.create_map(*[x for k, v in ROMAN.items() for x in (F.lit(k), F.lit(v))])
    arabic = F.when(low.rlike(UNIT_CONTENT_ARABIC),
                    _number(F.regexp_extract(low, UNIT_CONTENT_ARABIC, 1)))
    roman = F.when(low.rlike(UNIT_CONTENT_ROMAN),
                   F.try_element_at(roman_map, F.regexp_extract(low, UNIT_CONTENT_ROMAN, 1)))
    module = F.when(low.rlike(UNIT_CONTENT_MODULE),
                    _number(F.regexp_extract(low, UNIT_CONTENT_MODULE, 1)))
    return F.coalesce(arabic, roman, module, F.lit(0))


def is_document_path(path: Column, excluded: str = "dsai_syllabus.pdf") -> Column:
    """Extension in {ppt, pptx, pdf} (any case) and not the excluded name."""
    low = F.lower(path)
    return low.rlike(r"\.(ppt|pptx|pdf)$") & (F.lower(basename(path)) != excluded)
