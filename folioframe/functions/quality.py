"""Rules about one record (title, authors_str, publisher, pubdate, tags, formats, isbn)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import isbn
from .text import bound, strip

# Names that stand for no author, and patterns of titles that are file names or word-processor headings.
# An application that writes its own name as the author adds it through `unknown`.
UNKNOWN_AUTHORS = ("", "unknown", "unknown author", "administrator", "administrateur", "owner")
JUNK_TITLES = (r"(?i)^microsoft word\s*-", r"(?i)\bebok\b", r"(?i)\.(pdf|epub|mobi|azw3|djvu|rtf)$", r"(?i)^b0[0-9a-z]{8}\b")
NO_DATE = "0101-"
ISSUES = ("missing-isbn", "missing-publisher", "missing-pubdate", "bad-author", "junk-title", "missing-tags")


def record_isbn(c: Column) -> Column:
    return bound(isbn.clean(c), lambda s: F.when(isbn.is_10(s) | isbn.is_13(s), s).otherwise(F.lit("")))


def missing_pubdate(c: Column) -> Column:
    return (F.coalesce(c, F.lit("")) == "") | F.coalesce(c.startswith(NO_DATE), F.lit(False))


def missing_publisher(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit(""))) == ""


def bad_author(c: Column, unknown: tuple[str, ...] = UNKNOWN_AUTHORS) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit("")))).isin(*unknown)


def junk_title(c: Column) -> Column:

    def junk(t: Column) -> Column:
        out = t == ""
        for p in JUNK_TITLES:
            out = out | t.rlike(p)
        return out

    return bound(strip(F.coalesce(c, F.lit(""))), junk)


def has_tag(tags: Column, tag: str) -> Column:
    return F.exists(tags, lambda t: F.lower(t) == tag.strip().lower())


def suffixes(formats: Column) -> Column:
    """Distinct lower-case file suffixes, sorted."""
    each = F.transform(formats, lambda p: F.lower(F.regexp_extract(p, r"[^/.]\.([^./]+)$", 1)))
    return F.array_sort(F.array_distinct(F.filter(each, lambda s: s != "")))


def format_codes(formats: Column) -> Column:
    return F.transform(suffixes(formats), F.upper)


def pdf_paths(formats: Column) -> Column:
    return F.filter(formats, lambda p: F.lower(p).endswith(".pdf"))


def issues(isbn_col: Column | None = None) -> Column:
    """The record's issues, in the order of ISSUES; isbn_col: its record_isbn(), where that is at hand."""
    flags = ((record_isbn(F.col("isbn")) if isbn_col is None else isbn_col) == "", missing_publisher(F.col("publisher")), missing_pubdate(F.col("pubdate")), bad_author(F.col("authors_str")), junk_title(F.col("title")), F.size("tags") <= 0)
    return F.array_compact(F.array(*(F.when(f, F.lit(n)) for f, n in zip(flags, ISSUES, strict=True))))
