"""One query per operator. Lists come out as joined strings and groups as rows, so that other engines' results compare."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import isbn as I
from ..functions import quality as Q
from ..functions import text as X
from ..functions.similarity import lcs
from ..operators import audit, catalog, dedup, integrity, match, outline, search, writeplan
from ..sources import shared
from ..sources.catalog_tables import Catalog, from_parquet
from ..streaming import keyed
from .adapter import catalog as open_catalog
from .adapter import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TITLED = ("id", "title", "authors_str")
AUDITED = (*TITLED, "tags", "formats", "isbn", "publisher", "pubdate")
NATIVE = {"native": True}  # the adapter's text is ASCII and precomposed Latin


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _books(spark, sf):
    return catalog.books(open_catalog(spark, sf), "folio://")


def _joined(c: str, sep: str = "|"):
    return F.array_join(c, sep).alias(c)


@query
def catalog_books(spark, sf):
    b = _books(spark, sf)
    return b.select("id", "title", _joined("authors"), "authors_str", _joined("tags"), _joined("formats"), F.array_join(F.transform("sizes", lambda x: x.cast("string")), "|").alias("sizes"), "isbn", "path", "uuid", "pubdate", "publisher", "link")


@query
def catalog_point_lookup(spark, sf):
    return catalog.book(open_catalog(spark, sf), 55).select("id", "title", "authors_str", _joined("formats"), "isbn", "publisher")


@query
def catalog_formats(spark, sf):
    return _books(spark, sf).select("id", _joined("formats").alias("paths"), F.array_join(Q.format_codes(F.col("formats")), "|").alias("codes"), F.array_join(Q.pdf_paths(F.col("formats")), "|").alias("pdfs"))


@query
def catalog_listing(spark, sf):
    return catalog.listing(_books(spark, sf)).select("id", "uuid", "title", "authors", _joined("formats"))


@query
def catalog_identifiers(spark, sf):
    return catalog.identifiers(open_catalog(spark, sf)).select("book", writeplan.join_identifiers(F.col("identifiers")).alias("identifiers"))


@query
def tags_usage(spark, sf):
    return catalog.tag_usage(open_catalog(spark, sf), 2)


@query
def books_by_tag(spark, sf):
    return catalog.by_tag(_books(spark, sf), " flag a").select("id", "title")


@query
def text_search_key_docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.search_key(F.col("text")).alias("search_key"))


@query
def text_group_key(spark, sf):
    b = open_catalog(spark, sf)["books"]
    return b.select("id", X.group_key(F.col("title")).alias("group_key"), X.search_key(F.col("title")).alias("search_key"))


@query
def text_surname_key(spark, sf):
    return open_catalog(spark, sf)["authors"].select("id", X.surname_key(F.col("name")).alias("surname_key"))


@query
def text_split_authors(spark, sf):
    b = _books(spark, sf).select("id", X.split_authors(F.concat(F.col("authors_str"), F.lit(" and Last One"))).alias("names"))
    return b.select("id", F.size("names").cast("long").alias("n"), _joined("names"), X.short_authors(F.col("names")).alias("short"))


@query
def text_html_entity_gate(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.has_entity(F.col("html")).alias("refused"))


@query
def isbn_clean(spark, sf):
    return open_catalog(spark, sf)["identifiers"].select("id", I.clean(F.col("val")).alias("cleaned"))


@query
def isbn_valid(spark, sf):
    return open_catalog(spark, sf)["identifiers"].select("id", I.valid(F.col("val")).alias("valid"))


@query
def isbn_to13(spark, sf):
    return open_catalog(spark, sf)["identifiers"].select("id", I.to_13(F.substring(I.clean(F.col("val")), 4, 10)).alias("isbn13"))


@query
def isbn_extract_text(spark, sf):
    return open_catalog(spark, sf)["sources"].select("id", F.array_join(I.extract(F.col("text")), "|").alias("isbns"))


@query
def dup_exempt_edges(spark, sf):
    return dedup.exempt_edges(open_catalog(spark, sf))


@query
def dup_title_groups(spark, sf):
    c = open_catalog(spark, sf)
    return dedup.title_groups(catalog.books(c, only=TITLED), dedup.exempt_edges(c), **NATIVE).select("group_id", "id")


@query
def dup_title_groups_raw(spark, sf):
    return dedup.title_groups(_books(spark, sf), **NATIVE).select("group_id", "id")


@query
def dup_size_groups(spark, sf):
    c = open_catalog(spark, sf)
    return dedup.size_groups(catalog.books(c, only=("id", "sizes")), dedup.exempt_edges(c))


@query
def dup_isbn_groups(spark, sf):
    return dedup.isbn_groups(_books(spark, sf))


@query
def dup_text_hash(spark, sf):
    return table(spark, sf, "documents").select(F.sha2("text", 256).alias("sha256")).groupBy("sha256").agg(F.count("*").alias("n")).where("n > 1")


def _staged(spark, sf):
    """Proposals: every book again, some with its number, size, contents or title changed; and what they are compared with."""
    c = open_catalog(spark, sf)
    c = Catalog(c.tables | {"data": shared.written(c["data"], "data")}, c.root)
    b = shared.written(catalog.books(c, only=("id", "title", "authors_str", "isbn", "sizes")), "records")
    k = F.col("id")
    staged = b.select(
        k.alias("proposal_id"), F.when(k % 40 == 0, F.concat(F.lit("Other "), F.col("title"))).otherwise(F.col("title")).alias("title"), F.col("authors_str").alias("authors"),
        F.when(k % 60 == 0, F.col("isbn")).otherwise(F.lit("")).alias("isbn"), F.when(k % 100 == 0, F.try_element_at("sizes", F.lit(1))).otherwise(F.lit(0)).alias("size"), F.concat(F.lit("h"), (k % 200).cast("string")).alias("sha256"),
    )
    files = c["data"].select("book", F.col("uncompressed_size").alias("size"), F.concat(F.lit("h"), (F.col("book") % 200).cast("string")).alias("sha256"))
    return staged, b, files, dedup.exempt_edges(c)


@query
def dup_signals_batch(spark, sf):
    return dedup.signals(*_staged(spark, sf), **NATIVE).select("proposal_id", "signal", "book_id", "suppressed")


@query
def dup_verdict_batch(spark, sf):
    return dedup.weigh(*_staged(spark, sf), **NATIVE)


def _audited(spark, sf):
    return audit.audit_records(_books(spark, sf))


@query
def audit_flags(spark, sf):
    return _audited(spark, sf).select("id", "isbn", "publisher", "pubdate", _joined("format_exts"), _joined("issues"))


@query
def audit_issue_counts(spark, sf):
    return audit.counts(_audited(spark, sf), "issues", "issue")


@query
def audit_format_counts(spark, sf):
    return audit.counts(_audited(spark, sf), "format_exts", "ext")


@query
def audit_summary(spark, sf):
    return audit.summary(_audited(spark, sf))


@query
def audit_report_summary(spark, sf):
    """The whole summary: records, scans and duplicate groups."""
    c = open_catalog(spark, sf)
    records = shared.written(catalog.books(c, only=AUDITED), "records")
    return audit.audit(records, dedup.title_groups(records.select(*TITLED), dedup.exempt_edges(c), **NATIVE), _scans(spark, sf)).summary


@query
def audit_fill_queue(spark, sf):
    return audit.fill_queue(_audited(spark, sf)).select("id", "isbn")


@query
def audit_extract_queue(spark, sf):
    return audit.extract_queue(_audited(spark, sf)).select("id")


def _scans(spark, sf):
    s = open_catalog(spark, sf)["sources"]
    bad = F.col("error").isNotNull()
    return s.select("id", "title", F.lit("").alias("authors"), F.lit("").alias("path"), F.when(~bad, I.extract(F.col("text"))).otherwise(F.array().cast("array<string>")).alias("isbns"), F.length("text").cast("long").alias("text_chars"), "error")


@query
def audit_scan_classes(spark, sf):
    return audit.scan_classes(_scans(spark, sf))


def _pages(spark, sf):
    """Page texts of the PDFs: up to seven pages, some of which have a number."""
    p = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("k"), (F.col("l_linenumber") - 1).alias("page")).distinct()
    b = open_catalog(spark, sf)["books"].select(F.col("id").alias("k"), F.concat(F.col("path"), F.lit("/file "), F.col("id").cast("string"), F.lit(".pdf")).alias("path"))
    text = F.when(F.col("page") == 0, F.lit("ISBN 0-471-83006-2")).when(F.col("page") == 3, F.lit("ISBN 9781119744825")).when(F.col("page") == 6, F.lit("isbn 0262035618")).otherwise(F.concat(F.lit("page "), F.col("page").cast("string")))
    return p.join(b, "k").select("path", "page", F.lit(7).alias("n_pages"), text.alias("text"), F.when((F.col("k") % 16 == 0) & (F.col("page") == 0), F.lit("Trace\nno PDF\n")).alias("error"))


def _text_scans(spark, sf):
    return audit.scan_texts(audit.scan_targets(_books(spark, sf)), _pages(spark, sf), each_end=2)


@query
def audit_scan_texts(spark, sf):
    return _text_scans(spark, sf).select("id", "path", _joined("isbns"), "text_chars", "error")


@query
def audit_scan_join(spark, sf):
    return audit.audit_records(_books(spark, sf), _scans(spark, sf)).select("id", "isbn", F.array_join("scan.isbns", "|").alias("found"), F.col("scan.error").alias("error"))


@query
def audit_scan_errors(spark, sf):
    return _scans(spark, sf).where("error is not null").select("id", "error").orderBy("id")


@query
def match_candidates(spark, sf):
    rows = match.candidates(audit.fill_queue(_audited(spark, sf)), _scans(spark, sf), include_multi=True)
    return rows.select("id", "title", "isbn", "source", _joined("issues"))


@query
def match_author_overlap(spark, sf):
    a = _books(spark, sf).select("id", X.split_authors(F.col("authors_str")).alias("names"))
    given = F.array(*map(F.lit, ("Ann Smith1", "A. O’Keefe2", "Lang3, S.", "...", "Jose\u0301 Ga\u0308rtner-Ruiz4")))
    return a.select("id", match.overlap(F.col("names"), given).cast("long").alias("shared"))


@query
def match_status(spark, sf):
    books = _books(spark, sf)
    rows = match.candidates(audit.fill_queue(audit.audit_records(books)), _scans(spark, sf))
    none, k = F.lit(None).cast("string"), F.col("id")
    editions = books.select("id", I.clean(F.col("isbn")).alias("isbn"), F.when(k % 4 != 0, F.col("title")).alias("title"), F.when(k % 2 == 0, F.lit("A Course")).alias("subtitle"), none.alias("full_title"), "authors", F.when(k % 50 == 3, F.lit("not found")).alias("error"))
    editions = dedup.first_per(editions.where("isbn <> ''"), ["isbn"], "id").drop("id")
    return match.judge(rows, editions).select("id", "status", "title_similarity", F.col("author_overlap").cast("long"))


@query
def sim_lcs_tokens(spark, sf):
    names = table(spark, sf, "part").select("p_name").distinct()
    return names.select("p_name", lcs(F.lit("smoll wdget"), F.col("p_name")).alias("lcs"))


def _found(spark, sf, q, **how):
    return search.search(_books(spark, sf), q, **how).select("score", "id", "title", "authors")


@query
def search_title(spark, sf):
    return _found(spark, sf, "smal wigdet", field="title")


@query
def search_authors(spark, sf):
    return _found(spark, sf, "gartner ruiz", field="authors", limit=20)


@query
def search_both(spark, sf):
    return _found(spark, sf, "Straße élan ring", limit=15)


@query
def search_margin_off(spark, sf):
    return _found(spark, sf, "blue ring", margin=1.0, limit=50)


@query
def fs_orphans(spark, sf):
    c = open_catalog(spark, sf)
    return integrity.orphan_dirs(c["manifest"], c["books"]).select("id", "path", _joined("files"))


@query
def fs_missing_formats(spark, sf):
    c = open_catalog(spark, sf)
    return integrity.missing_formats(catalog.books(c), c["manifest"])


@query
def fs_case_drift(spark, sf):
    c = open_catalog(spark, sf)
    return integrity.case_drift(c["books"], c["manifest"])


@query
def fs_resolve_paths(spark, sf):
    c = open_catalog(spark, sf)
    paths = c["manifest"].where(~F.col("is_dir")).select(F.crc32("path").alias("pos"), F.concat(F.lit("/lib/"), F.col("path")).alias("path"))
    return integrity.resolve(paths, c["books"], "/lib").select("path", "id", "title")


@query
def outline_sanitize(spark, sf):
    t = table(spark, sf, "conversations")
    level = F.when(F.col("role") == "user", F.lit(3)).otherwise(F.length("text") % 4)
    return outline.sanitize(t.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), level.alias("level"), F.when(F.col("turn") % 7 != 5, F.col("text")).alias("title"), F.col("turn").alias("page")))


@query
def ident_merge(spark, sf):
    i = catalog.identifiers(open_catalog(spark, sf))
    return i.select("book", writeplan.merge_identifiers(F.col("identifiers"), F.concat(F.lit("doi: 10/x , bad,isbn:1:"), F.col("book").cast("string"))).alias("identifiers"))


@query
def ident_remove(spark, sf):
    i = catalog.identifiers(open_catalog(spark, sf))
    return i.select("book", writeplan.remove_identifier(F.col("identifiers"), F.lit("doi")).alias("identifiers"))


@query
def writeplan_gate(spark, sf):
    staged, *against = _staged(spark, sf)
    k = F.col("proposal_id")
    proposals = staged.select(
        "proposal_id", F.when(k % 80 == 0, F.lit("/in/none")).otherwise(F.lit("/in/a.pdf")).alias("path"), (k % 140 != 0).alias("file_exists"), F.when(k % 180 == 0, F.lit("A &amp; B")).otherwise(F.col("title")).alias("title"),
        F.when(k % 220 == 0, F.lit("")).otherwise(F.col("authors")).alias("authors"), F.lit("").alias("tags"), (k % 260 == 0).alias("gui_open"), (k % 120 == 0).alias("force"),
    )
    return writeplan.plan_add(proposals, dedup.weigh(staged, *against, **NATIVE))


@query
def writeplan_formats(spark, sf):
    c = open_catalog(spark, sf)
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("proposal_id"), F.when(F.col("p_partkey") % 9 == 0, F.lit("x")).otherwise(F.lit("/in/x.PDF")).alias("path"), (F.col("p_partkey") % 8 != 0).alias("file_exists"), (F.col("p_partkey") * 2).alias("book_id"), (F.col("p_partkey") % 7 == 0).alias("gui_open"), (F.col("p_partkey") % 3 == 0).alias("force"))
    return writeplan.plan_format(p, c["books"], c["data"])


@query
def writeplan_metadata(spark, sf):
    c = open_catalog(spark, sf)
    k = F.col("id")
    key = F.when(k % 5 == 0, F.lit("Authors")).when(k % 5 == 1, F.lit("title")).when(k % 5 == 2, F.lit("identifiers")).otherwise(F.lit("publisher"))
    value = F.when(k % 7 == 0, F.lit("x &lt; y")).when(k % 5 == 2, F.concat(F.lit("doi: , zotero:"), k.cast("string"))).otherwise(F.lit("plain"))
    proposals = c["books"].select(k.alias("proposal_id"), k.alias("book_id"), F.create_map(key, value).alias("fields"), (k % 11 == 0).alias("gui_open"), (k % 2 == 0).alias("force"))
    return writeplan.plan_metadata(proposals, catalog.identifiers(c))


@query
def writeplan_removal(spark, sf):
    c = open_catalog(spark, sf)
    k = F.col("id")
    proposals = c["books"].select(k.alias("proposal_id"), k.alias("book_id"), F.when(k % 3 == 0, F.lit("doi")).otherwise(F.lit("isbn")).alias("id_type"), (k % 11 == 0).alias("gui_open"))
    return writeplan.plan_removal(proposals, catalog.identifiers(c))


@query
def writeplan_reported_ids(spark, sf):
    said = F.concat(F.lit("old ids: 1, then Added book ids: "), F.col("id").cast("string"), F.lit(", "), (F.col("id") + 7).cast("string"), F.lit(" x9"))
    return open_catalog(spark, sf)["books"].select("id", F.array_join(F.transform(X.reported_ids(said), lambda x: x.cast("string")), "|").alias("ids"))


@query
def fs_nearest_root(spark, sf):
    m = open_catalog(spark, sf)["manifest"]
    roots = m.where(F.col("is_dir") & ~F.contains("path", F.lit("/"))).select(F.concat(F.lit("/lib/"), F.col("path")).alias("root")).unionByName(spark.createDataFrame([("/lib",), ("/other",)], "root string"))
    return integrity.nearest_root(m.where(~F.col("is_dir")).select(F.concat(F.lit("/lib/"), F.col("path")).alias("path")), roots)


@query
def fs_resolve_discovered(spark, sf):
    c = open_catalog(spark, sf)
    roots = F.explode(F.array(F.lit("/lib"), F.lit("/lib/Shelf 7"))).alias("root")
    paths = c["manifest"].where(~F.col("is_dir")).select(F.crc32("path").alias("pos"), F.concat(F.lit("/lib/"), F.col("path")).alias("path"))
    return integrity.resolve_discovered(paths, c["books"].select("id", "title", roots)).drop("pos")


@query
def fs_orphans_excluded(spark, sf):
    c = open_catalog(spark, sf)
    return integrity.orphan_dirs(c["manifest"], c["books"], excluded=("Shelf 7", "Shelf 27")).select("id", "path", _joined("files"))


@query
def isbn_hyphenated(spark, sf):
    return open_catalog(spark, sf)["identifiers"].select("id", I.hyphenate(F.col("val")).alias("hyphenated"), I.clean(I.hyphenate(F.col("val"))).alias("cleaned"))


@query
def catalog_exempt_parquet(spark, sf):
    """The exemptions of a catalogue that is kept as Parquet files."""
    c, folder = open_catalog(spark, sf), shared.folder(spark, "catalogue")

    @inheritable_thread_target(spark)
    def write(name: str) -> None:
        c[name].write.parquet(f"{folder}/{name}.parquet")

    with ThreadPoolExecutor() as pool:  # no table waits for another one's last tasks
        list(pool.map(write, ("custom_column_2", "books_custom_column_2_link", "books", "custom_columns")))
    return dedup.exempt_edges(from_parquet(spark, folder))


@query
def stream_keyed(spark, sf):
    """The row-level keys on a stream of records that reads what is there and ends."""
    folder = shared.folder(spark, "stream")
    open_catalog(spark, sf)["books"].select("id", "title", F.concat(F.lit("Lang, S. & "), F.col("sort")).alias("authors"), F.concat(F.lit("ISBN 978111974482"), F.col("id") % 10).alias("isbn")).write.parquet(f"{folder}/in")
    arriving = spark.readStream.schema("id bigint, title string, authors string, isbn string").parquet(f"{folder}/in")
    done = keyed(arriving).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.schema("id bigint, search_key string, group_key string, surname_key string, isbn_clean string, isbn_valid boolean").parquet(f"{folder}/out")
