"""Catalogue assembly: one nested record per book. Each 1:N side is summed before it is joined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quality as Q
from ..functions.text import ascii_lower, deep_link, strip
from ..sources.catalog_tables import Catalog


#: At most so many names are sent to every task; more are joined by a shuffle.
SENT = 1 << 17


def _names(link: DataFrame, names: DataFrame, key: str, sep: str, out: str) -> DataFrame:
    """A book's names in the order of their links, joined and split again (a name that holds the separator is split)."""
    rows = link.join(names.select(F.col("id").alias(key), F.col("name")), key)
    one = rows.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("n"))
    joined = F.array_join(F.transform("n", lambda x: x["name"]), sep)
    parts = F.filter(F.transform(F.split(joined, sep.strip()), strip), lambda x: x != "")
    return one.select("book", parts.alias(out))


def authors(c: Catalog) -> DataFrame:
    names = c["authors"].select("id", "name")
    few = names.limit(SENT + 1).count() <= SENT
    return _names(c["books_authors_link"], F.broadcast(names) if few else names, "author", " & ", "authors")


def tags(c: Catalog) -> DataFrame:
    return _names(c["books_tags_link"], c["tags"], "tag", ",", "tags")


#: The columns of a record that each linked side makes.
SIDES = {"authors": ("authors", "authors_str"), "tags": ("tags",), "isbns": ("isbn",), "publishers": ("publisher",), "files": ("formats", "sizes")}


def books(c: Catalog, link_prefix: str = "", only: tuple[str, ...] | None = None) -> DataFrame:
    """id, title, authors, tags, formats (paths), sizes, isbn, path, uuid, timestamp, pubdate, last_modified, publisher, authors_str, link.

    only: these columns alone; the sides that make none of them are not joined (an outer join stays in a plan even if nothing of it is read).
    """
    own = c["books"].select("id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("path", F.lit("")).alias("path"), "uuid", "timestamp", "pubdate", "last_modified")
    isbns = c["identifiers"].where(ascii_lower(F.col("type")) == "isbn").groupBy("book").agg(F.min_by("val", "id").alias("isbn"))
    publishers = c["books_publishers_link"].join(c["publishers"].select(F.col("id").alias("publisher"), F.col("name")), "publisher").groupBy("book").agg(F.min_by("name", "id").alias("publisher"))
    files = c["data"].select("book", "id", F.concat(F.col("name"), F.lit("."), F.lower("format")).alias("file"), F.coalesce("uncompressed_size", F.lit(0)).cast("long").alias("size"))
    files = files.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("id", "file", "size"))).alias("files"))
    out = own
    for name, side in {"authors": authors(c), "tags": tags(c), "isbns": isbns, "publishers": publishers, "files": files}.items():
        if only is None or set(only) & set(SIDES[name]):
            out = out.join(side.withColumnRenamed("book", "id"), "id", "left")
        else:
            out = out.withColumn({"isbns": "isbn", "publishers": "publisher"}.get(name, name), F.lit(None).cast(side.schema[1].dataType))
    empty = F.array().cast("array<string>")
    out = out.select(
        "id",
        "title",
        F.coalesce("authors", empty).alias("authors"),
        F.coalesce("tags", empty).alias("tags"),
        F.coalesce(F.transform("files", lambda f: F.concat_ws("/", F.lit(c.root) if c.root else F.lit(None).cast("string"), F.col("path"), f["file"])), empty).alias("formats"),
        F.coalesce(F.transform("files", lambda f: f["size"]), F.array().cast("array<bigint>")).alias("sizes"),
        "isbn",
        "path",
        "uuid",
        "timestamp",
        "pubdate",
        "last_modified",
        "publisher",
    )
    out = out.withColumn("authors_str", F.array_join("authors", " & ")).withColumn("link", deep_link(F.col("uuid"), link_prefix))
    return out if only is None else out.select(*only)


def book(c: Catalog, id: int) -> DataFrame:
    """One record; the id reaches every table's scan."""
    return books(Catalog({n: t.where(F.col("id" if n == "books" else "book") == id) if n == "books" or "book" in t.columns else t for n, t in c.tables.items()}, c.root))


def listing(records: DataFrame) -> DataFrame:
    """id, uuid, title, authors, formats (codes), in the order of title without case, then id."""
    return records.select("id", "uuid", "title", F.col("authors_str").alias("authors"), Q.format_codes(F.col("formats")).alias("formats")).orderBy(F.lower("title"), "id")


def tag_usage(c: Catalog, at_least: int = 1) -> DataFrame:
    """name and n, commonest first; names are one without regard to ASCII case; unused tags are absent."""
    used = c["books_tags_link"].groupBy(F.col("tag").alias("id")).agg(F.count("*").alias("n")).join(c["tags"], "id")
    return used.groupBy(ascii_lower(F.col("name")).alias("k")).agg(F.min("name").alias("name"), F.sum("n").alias("n")).where(F.col("n") >= at_least).select("name", "n").orderBy(F.desc("n"), "name")


def by_tag(records: DataFrame, tag: str) -> DataFrame:
    return records.where(Q.has_tag(F.col("tags"), tag))


def identifiers(c: Catalog) -> DataFrame:
    """(book, identifiers map)."""
    return c["identifiers"].groupBy("book").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "val")))).alias("identifiers"))
