"""Candidates for a look-up, and how well an external edition matches each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import closest, round3
from ..functions.text import author_keys, search_key, split_authors

THRESHOLD = 0.74
EDITION = "isbn string, title string, subtitle string, full_title string, authors array<string>, error string"


def candidates(fill: DataFrame, scans: DataFrame, include_multi: bool = False) -> DataFrame:
    """A row per record: the catalogue's own ISBN before one found in the file; several found ISBNs only if asked, then the first."""
    none = F.lit(None).cast("array<string>")
    own = fill.select("id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("authors", F.lit("")).alias("authors"), "isbn", F.lit("existing-isbn").alias("source"), "issues", none.alias("all_found_isbns"))
    n = F.size("isbns")
    found = scans.where(n >= 1 if include_multi else n == 1).select(
        "id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("authors", F.lit("")).alias("authors"), F.col("isbns")[0].alias("isbn"),
        F.when(n == 1, F.lit("pdf-scan-single-isbn")).otherwise(F.lit("pdf-scan-multi-isbn-first")).alias("source"), F.array(F.lit("missing-isbn")).alias("issues"), F.col("isbns").alias("all_found_isbns"),
    )
    return own.unionByName(found.dropDuplicates(["id"]).join(own.select("id"), "id", "left_anti"))


def first_candidates(rows: DataFrame, limit: int = 0) -> DataFrame:
    """The first `limit` candidates, 0 for all: the catalogue's own numbers before those from files, each by id."""
    return rows.orderBy(F.col("source") != "existing-isbn", "id").limit(limit) if limit else rows


def overlap(left, right, *, native: bool = False):
    """How many surname keys two arrays of names share."""
    return F.size(F.array_intersect(author_keys(left, native=native), author_keys(right, native=native)))


def judge(rows: DataFrame, editions: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """rows with title_similarity, author_overlap and status; an ISBN without an edition is a lookup-error, an edition without any title matches nothing.

    In no order: a sort of everything is for those who read the rows one after the other.
    """
    e = editions.dropDuplicates(["isbn"]).select("isbn", F.struct(*[c for c in editions.columns if c != "isbn"]).alias("edition"))
    df = rows.join(e, "isbn", "left")
    title, sub = F.coalesce(F.col("edition.title"), F.lit("")), F.coalesce(F.col("edition.subtitle"), F.lit(""))
    forms = [F.nullif(title, F.lit("")), F.nullif(F.col("edition.full_title"), F.lit("")), F.when(sub != "", F.concat(title, F.lit(": "), sub))]
    keys = [f"__f{i}" for i in range(len(forms))]
    df = df.withColumns({"__k": search_key(F.col("title"))} | {k: F.when(f.isNotNull(), search_key(f)) for k, f in zip(keys, forms, strict=True)})
    best = closest(F.col("__k"), *map(F.col, keys))
    names = split_authors(F.col("authors"))
    shared = overlap(names, F.coalesce("edition.authors", F.array().cast("array<string>")))
    bad = F.col("edition").isNull() | (F.coalesce("edition.error", F.lit("")) != "")
    df = df.withColumns({"__best": best, "__shared": shared})
    strong = (F.col("__best") >= threshold) & ((F.col("__shared") > 0) | (F.size(names) == 0))
    out = df.withColumn("title_similarity", F.when(~bad, round3(F.col("__best")))).withColumn("author_overlap", F.when(~bad, F.col("__shared")))
    out = out.withColumn("status", F.when(bad, F.lit("lookup-error")).when(strong, F.lit("strong-candidate")).otherwise(F.lit("review-title-author")))
    return out.drop("__k", "__best", "__shared", *keys)


def match(rows: DataFrame, editions: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """judge(), in the order of status and id."""
    return judge(rows, editions, threshold).orderBy("status", "id")


def status_counts(matched: DataFrame) -> DataFrame:
    return matched.groupBy("status").agg(F.count("*").alias("n"))
