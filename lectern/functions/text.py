"""Scalar text functions: strip, word tokens, names, citations, hashes.

The default tokenizer is whitespace words (Unicode white space); a caller may pass
any ``Column -> Column<array<string>>`` instead (hook U1).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Tokenizer = Callable[[Column], Column]

# Unicode white space (with the four ASCII separators), as characters and as a regex class.
WS = (" \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
      "\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
WS_CLASS = r"\t-\r \x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(WS))


def non_blank(c: Column) -> Column:
    """the text has at least one token."""
    return c.rlike(f"[^{WS_CLASS}]")


def words(c: Column) -> Column:
    """Default tokenizer: maximal runs without white space. A split reads a text once; extraction by a pattern
    copies the whole text for each run that it finds."""
    return F.array_remove(F.split(F.translate(c, WS, " " * len(WS)), " "), "")


def token_count(c: Column, tokenizer: Tokenizer = words) -> Column:
    """Number of tokens of a text."""
    return F.size(tokenizer(c)).cast("long")


def detokenize(tokens: Column) -> Column:
    """Inverse of the word tokenizer: tokens joined by one space."""
    return F.array_join(tokens, " ")


def safe_name(c: Column) -> Column:
    """File-system safe name: drop all but word/space/hyphen, spaces -> _, lower."""
    kept = F.regexp_replace(strip(c), r"[^\p{L}\p{N}_\s-]", "")
    return F.lower(F.regexp_replace(kept, r"\s+", "_"))


def subject_display(c: Column) -> Column:
    """P5: directory name -> display name (``_``/``-`` to space, title case, strip).

    ``initcap`` capitalises after spaces only (Python's title() also after
    digits/apostrophes) -- documented deviation.
    """
    return F.trim(F.initcap(F.translate(c, "_-", "  ")))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def citation(subject: Column, semester: Column, unit_number: Column,
             slide_number: Column, source_filename: Column) -> Column:
    """Non-empty parts joined by `` | ``; a fixed fallback when all are empty."""
    parts = F.concat_ws(
        " | ",
        F.when(F.coalesce(subject, F.lit("")) != "", F.concat(F.lit("Subject: "), subject)),
        F.when(F.coalesce(semester, F.lit(0)) != 0, F.concat(F.lit("Semester: "), semester.cast("string"))),
        F.when(F.coalesce(unit_number, F.lit(0)) != 0, F.concat(F.lit("Unit: "), unit_number.cast("string"))),
        F.when(F.coalesce(slide_number, F.lit(0)) != 0, F.concat(F.lit("Slide: "), slide_number.cast("string"))),
        F.when(F.coalesce(source_filename, F.lit("")) != "", F.concat(F.lit("Source: "), source_filename)),
    )
    return F.when(parts == "", F.lit("No citation available")).otherwise(parts)


def match_percent(score: Column) -> Column:
    """Integer percent, truncated (``int(score * 100)``)."""
    return (score.cast("double") * 100).cast("long")


def cache_key(query: Column, semester: Column, subject: Column, history: Column) -> Column:
    """Sha-256 of ``query|semester|subject|history``.

    Missing/zero semester and missing/empty subject render as ''; history is
    the JSON text of the ordered ``array<struct<role,content>>`` ('' if empty).
    """
    sem = F.when(F.coalesce(semester, F.lit(0)) != 0, semester.cast("string")).otherwise(F.lit(""))
    subj = F.coalesce(subject, F.lit(""))
    hist = F.when(F.coalesce(F.size(history), F.lit(0)) > 0, F.to_json(history)).otherwise(F.lit(""))
    return F.sha2(F.concat_ws("|", query, sem, subj, hist), 256)
