"""The data-quality audit: flags per record, rollups, work queues and the summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import isbn
from ..functions import quality as Q

SCANS = "id long, title string, authors string, path string, isbns array<string>, text_chars long, error string"


def audit_records(records: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """A row per record: id, title, authors, isbn ('' if not valid), publisher, pubdate, tags, formats, format_exts, issues, scan."""
    out = records.withColumn("__isbn", Q.record_isbn(F.col("isbn"))).select(
        "id", "title", F.col("authors_str").alias("authors"), F.col("__isbn").alias("isbn"), F.coalesce("publisher", F.lit("")).alias("publisher"),
        F.coalesce("pubdate", F.lit("")).alias("pubdate"), "tags", "formats", Q.suffixes(F.col("formats")).alias("format_exts"), Q.issues(F.col("__isbn")).alias("issues"),
    )
    if scans is None:
        return out.withColumn("scan", F.lit(None).cast(f"struct<{', '.join(x.replace(' ', ':', 1) for x in SCANS.split(', '))}>"))
    return out.join(scans.select(F.col("id"), F.struct(*scans.columns).alias("scan")), "id", "left")


def scan_targets(records: DataFrame, limit: int = 0) -> DataFrame:
    """Records without a valid ISBN that have a PDF, in the order of ids; the first `limit`, 0 for all."""
    out = records.where((Q.record_isbn(F.col("isbn")) == "") & (F.size(Q.pdf_paths(F.col("formats"))) > 0)).select("id", "title", F.col("authors_str").alias("authors"), Q.pdf_paths(F.col("formats"))[0].alias("path"))
    return out.orderBy("id").limit(limit) if limit else out


def scan_texts(targets: DataFrame, pages: DataFrame, each_end: int = 8) -> DataFrame:
    """SCANS of targets (id, title, authors, path) from page texts (path, page from 0, n_pages, text, error): the first and last pages alone.

    A path without pages has the error 'no text'; an error of any page is the scan's, its last line's first 240 characters.
    """
    near = pages.where((F.col("page") < each_end) | (F.col("page") >= F.col("n_pages") - each_end))
    joined = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))))
    text = near.groupBy("path").agg(joined.alias("text"), F.max("error").alias("error"))
    line = F.substring(F.element_at(F.split(F.regexp_replace("error", r"\s+$", ""), "\n"), -1), 1, 240)
    none = F.array().cast("array<string>")
    return targets.join(text, "path", "left").select("id", "title", "authors", "path", F.when(F.col("error").isNull() & F.col("text").isNotNull(), isbn.extract(F.col("text"))).otherwise(none).alias("isbns"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("text_chars"), F.when(F.col("error").isNotNull(), line).when(F.col("text").isNull(), F.lit("no text")).alias("error"))


def counts(audited: DataFrame, column: str, out: str) -> DataFrame:
    """How many records have each value of an array column; commonest first, then the one met at the smallest id."""
    rows = audited.select("id", F.explode(column).alias(out)).groupBy(out).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    return rows.orderBy(F.desc("n"), "first_id", out)


def fill_queue(audited: DataFrame) -> DataFrame:
    """Records whose ISBN can fill a missing publisher or date."""
    return audited.where((F.col("isbn") != "") & F.arrays_overlap("issues", F.array(F.lit("missing-publisher"), F.lit("missing-pubdate"))))


def extract_queue(audited: DataFrame) -> DataFrame:
    """Records without an ISBN that have a PDF."""
    return audited.where(F.array_contains("issues", "missing-isbn") & F.array_contains("format_exts", "pdf"))


def _has(issue: str) -> Column:
    return F.array_contains("issues", issue)


def summary(audited: DataFrame) -> DataFrame:
    """One row, one pass."""
    fill = (F.col("isbn") != "") & (_has("missing-publisher") | _has("missing-pubdate"))
    return audited.agg(
        F.count("*").alias("books"), F.count_if(F.col("isbn") != "").alias("records_with_isbn"), F.count_if(fill).alias("safe_existing_isbn_lookup_candidates"),
        F.count_if(_has("missing-isbn") & F.array_contains("format_exts", "pdf")).alias("pdf_isbn_extraction_candidates"), *(F.count_if(_has(i)).alias(i.replace("-", "_")) for i in Q.ISSUES),
    )


def scan_classes(scans: DataFrame, timeout: int = 20) -> DataFrame:
    """One row: how many scans found what."""
    n, bad = F.size("isbns"), F.coalesce(F.col("error") != "", F.lit(False))
    return scans.agg(
        F.count("*").alias("scanned_pdf_candidates"), F.count_if(n > 0).alias("scanned_pdfs_with_isbn"), F.count_if(n == 1).alias("single_isbn_scan_hits"), F.count_if(n > 1).alias("multi_isbn_scan_hits"),
        F.count_if((n <= 0) & ~bad).alias("no_isbn_no_error"), F.count_if(bad).alias("scan_errors"), F.count_if(F.col("error") == f"timeout after {timeout}s").alias("scan_timeouts"),
    )


@dataclass
class Report:
    """What an audit tells, each part a DataFrame."""

    records: DataFrame
    summary: DataFrame
    issue_counts: DataFrame
    format_counts: DataFrame
    safe_isbn_lookup: DataFrame
    extract_candidates: DataFrame
    scans: DataFrame
    duplicate_groups: DataFrame


def audit(records: DataFrame, duplicates: DataFrame, scans: DataFrame | None = None, timeout: int = 20, limit: int = 0, workers: int = 4) -> Report:
    """timeout, limit and workers are those of the scan, for its entries in the summary; without a scan they are 0."""
    spark = records.sparkSession
    done = audit_records(records, scans)
    asked = {"scan_timeout_seconds": timeout, "scan_limit": limit, "scan_workers": workers}
    asked = {k: F.lit(v if scans is not None else 0).cast("long") for k, v in asked.items()}
    scans = scans if scans is not None else spark.createDataFrame([], SCANS)
    one = summary(done).crossJoin(scan_classes(scans, timeout).withColumns(asked)).crossJoin(duplicates.agg(F.count_distinct("group_id").alias("duplicate_title_groups")))  # single rows
    return Report(done, one, counts(done, "issues", "issue"), counts(done, "format_exts", "ext"), fill_queue(done), extract_queue(done), scans, duplicates)
