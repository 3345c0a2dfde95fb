"""Catalogue operators over small catalogues with known results."""

import sqlite3

import pytest

from folioframe.operators import audit, catalog, dedup, integrity, match, outline, writeplan
from folioframe.sources import catalog_tables, manifest, sqlite_ro
from folioframe.streaming import keyed

BOOKS = "id long, title string, authors_str string, sizes array<long>, isbn string"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lib") / "catalogue.db")
    db = sqlite3.connect(path)
    kind = {"bigint": "INTEGER", "string": "TEXT"}
    for name, schema in catalog_tables.SCHEMAS.items():
        db.execute(f"CREATE TABLE {name} ({', '.join(f'{c.split()[0]} {kind[c.split()[1]]}' for c in schema.split(', '))})")
    db.execute("CREATE TABLE custom_columns (id INTEGER, label TEXT)")
    db.execute("CREATE TABLE custom_column_2 (id INTEGER, value TEXT)")
    db.execute("CREATE TABLE books_custom_column_2_link (id INTEGER, book INTEGER, value INTEGER)")
    db.executemany("INSERT INTO books (id, title, path, uuid, pubdate) VALUES (?,?,?,?,?)", [(1, "Algebra", "Lang/Algebra (1)", "u1", "2001"), (2, None, "X/Y (2)", "", "0101-01-01"), (3, "The Algebra (2nd Edition)", "Lang/Algebra (3)", None, None)])
    db.executemany("INSERT INTO authors VALUES (?,?)", [(1, "Serge Lang"), (2, "Ann & Bob")])
    db.executemany("INSERT INTO books_authors_link VALUES (?,?,?)", [(9, 1, 2), (5, 1, 1), (6, 3, 1)])
    db.executemany("INSERT INTO tags VALUES (?,?)", [(1, "maths"), (2, "a,b"), (3, "never")])
    db.executemany("INSERT INTO books_tags_link VALUES (?,?,?)", [(1, 1, 1), (2, 1, 2), (3, 3, 1)])
    db.executemany("INSERT INTO publishers VALUES (?,?)", [(1, "Pub")])
    db.executemany("INSERT INTO books_publishers_link VALUES (?,?,?)", [(1, 1, 1)])
    db.executemany("INSERT INTO data VALUES (?,?,?,?,?)", [(1, 1, "PDF", 10, "f"), (2, 3, "EPUB", 10, "g"), (3, 1, "EPUB", None, "f"), (4, 99, "PDF", 10, "h")])
    db.executemany("INSERT INTO identifiers VALUES (?,?,?,?)", [(1, 1, "ISBN", "9781119744825"), (2, 1, "doi", "10/x"), (3, 3, "isbn", "978-1-119-74482-5")])
    db.execute("INSERT INTO custom_columns VALUES (2, 'dupok')")
    db.executemany("INSERT INTO custom_column_2 VALUES (?,?)", [(1, "3; see also, 1")])
    db.executemany("INSERT INTO books_custom_column_2_link VALUES (?,?,?)", [(1, 1, 1)])
    db.commit()
    db.close()
    return sqlite_ro.open_catalog(spark, path, root="/lib", partitions=2)


def test_sqlite_source(spark, small, tmp_path):
    assert small.probe() == {} and small.custom_column("dupok") == 2 and small.custom_column("no") is None
    assert [r.id for r in small["books"].where("id = 2").collect()] == [2] and small["books"].count() == 3
    with pytest.raises(catalog_tables.MissingCatalog):
        sqlite_ro.connect(str(tmp_path / "none.db"))
    half = catalog_tables.Catalog({"books": small["books"].drop("uuid")})
    assert half.probe()["books"] == ["uuid"] and half.probe()["tags"] == ["<table absent>"]
    with pytest.raises(catalog_tables.WrongSchema):
        half.checked()


def test_assembly(small):
    one, two, three = catalog.books(small, "link://").orderBy("id").collect()
    assert one.authors == ["Serge Lang", "Ann", "Bob"] and one.authors_str == "Serge Lang & Ann & Bob" and one.tags == ["maths", "a", "b"]
    assert one.formats == ["/lib/Lang/Algebra (1)/f.pdf", "/lib/Lang/Algebra (1)/f.epub"] and one.sizes == [10, 0] and one.isbn == "9781119744825" and one.link == "link://u1" and one.publisher == "Pub"
    assert two.title == "" and two.authors == [] and two.formats == [] and two.link is None and two.publisher is None
    assert three.tags == ["maths"]
    assert [r.id for r in catalog.book(small, 3).collect()] == [3] and catalog.book(small, 77).collect() == []
    assert [(r.name, r.n) for r in catalog.tag_usage(small).collect()] == [("maths", 2), ("a,b", 1)]
    assert {r.id for r in catalog.by_tag(catalog.books(small), " MATHS ").collect()} == {1, 3}


def test_exemptions(spark, small):
    assert [tuple(r) for r in dedup.exempt_edges(small).collect()] == [(1, 3)]
    assert dedup.exempt_edges(catalog_tables.Catalog({"books": small["books"]})).collect() == []
    said = spark.createDataFrame([(1, "954,995"), (2, "954; 995"), (995, "1"), (3, "3, x"), (4, None)], "book long, value string")
    assert {tuple(r) for r in dedup.edges_of(said).collect()} == {(1, 954), (1, 995), (2, 954), (2, 995)}


def _records(spark, rows):
    return spark.createDataFrame(rows, BOOKS)


def test_title_groups(spark):
    books = _records(spark, [(1, "Algebra", "Serge Lang", [], None), (2, "Algebra", "Michael Artin", [], None), (3, "X", "A B", [], None), (4, "The X", "A B", [], None), (5, "X, 2nd Edition", "A B", [], None), (6, "()", "A B", [], None), (7, "", "A B", [], None), (8, "Y", "", [], None), (9, "Y", "", [], None)])
    edge = lambda *p: spark.createDataFrame(list(p), "a long, b long")
    assert {tuple(r) for r in dedup.title_groups(books).select("group_id", "id").collect()} == {(3, 3), (3, 4), (3, 5), (8, 8), (8, 9)}
    assert {r.id for r in dedup.title_groups(books, edge((3, 4))).collect()} == {3, 4, 5, 8, 9}
    assert {r.id for r in dedup.title_groups(books, edge((3, 4), (3, 5), (4, 5))).collect()} == {8, 9}
    assert dedup.as_groups(dedup.title_groups(books), "title", "authors_str").first().members[0].id == 3


def test_size_and_isbn_groups(spark):
    books = _records(spark, [(954, "a", "x", [5, 5], "9781119744825"), (995, "b", "y", [5, 7], "978-1-119-74482-5"), (3, "c", "z", [0], "123456789012"), (4, "d", "w", [0, 9, 9], "123456789012")])
    assert {tuple(r) for r in dedup.size_groups(books).collect()} == {(954, 5, 954), (954, 5, 995)}
    assert dedup.size_groups(books, spark.createDataFrame([(954, 995)], "a long, b long")).collect() == []
    assert {r.id for r in dedup.isbn_groups(books).collect()} == {954, 995}


def test_verdicts(spark):
    books = spark.createDataFrame([(1, "Algebra", "Lang, S.", "9781119744825"), (2, "Other", "Q", None), (3, "Algebra", "Serge Lang", None), (4, "Algebra", "Lang", None)], "id long, title string, authors_str string, isbn string")
    files = spark.createDataFrame([(1, 10, "h1"), (2, 20, "h2"), (3, 30, "h3")], "book long, size long, sha256 string")
    staged = spark.createDataFrame([(1, "New", "N", "", 20, "h2"), (2, "New", "N", "978-1-119-74482-5", 0, ""), (3, "Algebra", "S. Lang", "", 0, ""), (4, "New", "N", "", 0, ""), (5, "New", "N", "", 20, "zz"), (6, "()", "Lang", "", 0, "")], "proposal_id long, title string, authors string, isbn string, size long, sha256 string")
    none = spark.createDataFrame([], dedup.EDGES)
    found = dedup.signals(staged, books, files, none)
    assert {r.proposal_id: (r.verdict, r.n_signals) for r in dedup.verdicts(staged, found).collect()} == {1: ("block", 1), 2: ("block", 1), 3: ("warn", 2), 4: ("ok", 0), 5: ("warn", 1), 6: ("ok", 0)}
    both = dedup.signals(staged, books, files, spark.createDataFrame([(1, 3)], dedup.EDGES))
    assert {r.proposal_id: r.verdict for r in dedup.verdicts(staged, both).collect()}[3] == "ok"
    other = dedup.signals(staged, books, files, spark.createDataFrame([(1, 9), (3, 9)], dedup.EDGES))
    assert {r.proposal_id: r.verdict for r in dedup.verdicts(staged, other).collect()}[3] == "warn"


def test_audit(spark, small):
    records = catalog.books(small)
    targets = audit.scan_targets(records)
    assert targets.collect() == []
    pages = spark.createDataFrame([("p", 0, 3, "ISBN 9781119744825", None), ("p", 1, 3, "ISBN 0471830062", None), ("q", 0, 1, None, "Trace\nBad file\n")], "path string, page int, n_pages int, text string, error string")
    asked = spark.createDataFrame([(2, "t", "a", "p"), (3, "t", "a", "q"), (4, "t", "a", "r")], "id long, title string, authors string, path string")
    scans = {r.id: r for r in audit.scan_texts(asked, pages, each_end=1).collect()}
    assert scans[2].isbns == ["9781119744825"] and scans[3].error == "Bad file" and scans[4].error == "no text"
    report = audit.audit(records, dedup.title_groups(records), audit.scan_texts(asked, pages))
    rows = {r.id: r.issues for r in report.records.collect()}
    assert rows == {1: [], 2: ["missing-isbn", "missing-publisher", "missing-pubdate", "bad-author", "junk-title", "missing-tags"], 3: ["missing-publisher", "missing-pubdate"]}
    one = report.summary.first()
    assert (one.books, one.records_with_isbn, one.safe_existing_isbn_lookup_candidates, one.scanned_pdf_candidates, one.scan_errors, one.duplicate_title_groups) == (3, 2, 1, 3, 2, 1)
    assert [r.id for r in report.safe_isbn_lookup.collect()] == [3]
    assert report.issue_counts.first().issue == "missing-publisher" or report.issue_counts.first().n == 2


def test_match(spark):
    fill = spark.createDataFrame([(1, "Pólya", "G. Polya", "1", ["x"])], "id long, title string, authors string, isbn string, issues array<string>")
    scans = spark.createDataFrame([(1, "t", "a", ["9"]), (2, "Statistical Rethinking", "", ["2"]), (3, "t", "a", ["3", "4"]), (5, "Wrong", "A B", ["5"]), (6, "Title", "A B", ["6"]), (7, "No edition", "", ["7"])], "id long, title string, authors string, isbns array<string>")
    rows = match.candidates(fill, scans)
    assert {(r.id, r.source) for r in rows.collect()} == {(1, "existing-isbn"), (2, "pdf-scan-single-isbn"), (5, "pdf-scan-single-isbn"), (6, "pdf-scan-single-isbn"), (7, "pdf-scan-single-isbn")}
    assert {r.isbn for r in match.candidates(fill, scans, include_multi=True).where("id = 3").collect()} == {"3"}
    editions = spark.createDataFrame([("1", "Polya", None, None, ["George Pólya"], None), ("2", "Statistical Rethinking", "A Bayesian Course", "Statistical Rethinking: A Bayesian Course", ["R. McElreath"], None), ("5", "Entirely different words", None, None, ["A B"], None), ("6", "Title", None, None, ["C D"], None)], match.EDITION)
    done = match.match(rows, editions)
    assert [(r.id, r.status) for r in done.collect()] == [(7, "lookup-error"), (5, "review-title-author"), (6, "review-title-author"), (1, "strong-candidate"), (2, "strong-candidate")]
    assert {r.status: r.n for r in match.status_counts(done).collect()} == {"lookup-error": 1, "review-title-author": 2, "strong-candidate": 2}


def test_integrity(spark, tmp_path):
    for d in ("A/Known (1)", "A/Gone (7)", "trash/Old (8)", "A/No suffix", "JOHN MONTAGUE/Book (2)"):
        (tmp_path / d).mkdir(parents=True)
    (tmp_path / "A/Gone (7)/x.PDF").write_bytes(b"x")
    (tmp_path / "A/Gone (7)/cover.jpg").write_bytes(b"x")
    (tmp_path / "A/Known (1)/k.pdf").write_bytes(b"abc")
    m = manifest.scan(spark, str(tmp_path))
    books = spark.createDataFrame([(1, "Known", "A/Known (1)"), (2, "Book", "John Montague/Book (2)"), (3, "None", "Nobody/None (3)")], "id long, title string, path string")
    assert [(r.id, r.files) for r in integrity.orphan_dirs(m, books, excluded=("trash",)).collect()] == [(7, ["x.PDF"])]
    records = spark.createDataFrame([(1, "Known", ["A/Known (1)/k.pdf", "A/Known (1)/k.epub"])], "id long, title string, formats array<string>")
    assert [r.missing for r in integrity.missing_formats(records, m).collect()] == ["A/Known (1)/k.epub"]
    assert [tuple(r) for r in integrity.case_drift(books, m).collect()] == [(2, "Book", "John Montague", "JOHN MONTAGUE", ".")]
    paths = spark.createDataFrame([(0, "/lib/A/Known (1)/k.pdf"), (1, "/else/A/Known (1)/k.pdf"), (2, "/lib/A/Known (1) x/k.pdf"), (3, "/lib/x")], "pos int, path string")
    assert [r.id for r in integrity.resolve(paths, books, "/lib").collect()] == [1, None, None, None]
    roots = spark.createDataFrame([("/lib",), ("/lib/A",)], "root string")
    assert {r.pos: r.root for r in integrity.nearest_root(paths, roots).collect()} == {0: "/lib/A", 1: None, 2: "/lib/A", 3: "/lib"}
    assert [r.length for r in manifest.hashes(spark, [str(tmp_path / "A/Known (1)/k.pdf")]).collect()] == [3]


def test_outline(spark):
    def levels(*given):
        rows = [(1, i, lv, f" t{i}\n x ", i) for i, lv in enumerate(given)] + [(1, 90, 1, "  ", 3), (1, 91, 1, "t", None)]
        return [r.level for r in outline.sanitize(spark.createDataFrame(rows, "doc_id int, pos int, level int, title string, page int")).orderBy("pos").collect()]

    assert levels(3) == [1] and levels(1, 3) == [1, 2] and levels(1, 2, 3, 1) == [1, 2, 3, 1] and levels(2, 2, 5, 0, 4) == [1, 2, 3, 1, 2]
    rows = spark.createDataFrame([(1, 0, 1, "a\t b", 0), (1, 1, 1, "c", 9999)], "doc_id int, pos int, level int, title string, page int")
    pages = spark.createDataFrame([(1, 10)], "doc_id int, n_pages int")
    assert [(r.title, r.page) for r in outline.sanitize(rows, pages).orderBy("pos").collect()] == [("a b", 1), ("c", 10)]
    assert outline.has_outline(rows).first().has_outline


def test_identifiers_and_gates(spark, small):
    ids = catalog.identifiers(small)
    p = spark.createDataFrame([(1, 1, {"identifiers": "isbn:1, bad,zotero: z:9 "}, False, False), (2, 1, {"Title": "t"}, False, False), (3, 1, {"title": "t"}, False, True), (4, 1, {"AUTHORS": "a", "title": "x &amp; y"}, False, True), (5, 1, {"authors": "a"}, False, True), (6, 1, {"x": "y"}, True, False), (7, 55, {"identifiers": "a:b"}, False, False)], "proposal_id int, book_id long, fields map<string,string>, gui_open boolean, force boolean")
    got = {r.proposal_id: (r.reason, r.identifiers) for r in writeplan.plan_metadata(p, ids).collect()}
    assert got == {1: (None, "ISBN:9781119744825,doi:10/x,isbn:1,zotero:z:9"), 2: ("title-needs-force", None), 3: (None, None), 4: ("html-entity", None), 5: ("authors-never", None), 6: ("gui-open", None), 7: (None, "a:b")}
    r = spark.createDataFrame([(1, 1, "doi", False), (2, 1, "none", False), (3, 9, "doi", False), (4, 1, "doi", True)], "proposal_id int, book_id long, id_type string, gui_open boolean")
    assert {x.proposal_id: (x.reason, x.identifiers) for x in writeplan.plan_removal(r, ids).collect()} == {1: (None, "ISBN:9781119744825"), 2: ("identifier-absent", "ISBN:9781119744825,doi:10/x"), 3: ("identifier-absent", ""), 4: ("gui-open", "ISBN:9781119744825")}


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("The Élan (2nd Edition)", "Lang, S.", "ISBN 9781119744825")], "title string, authors string, isbn string")
    rows.write.parquet(str(tmp_path / "in"))
    q = keyed(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("keyed").outputMode("append").start()
    try:
        q.processAllAvailable()
        assert [tuple(r)[3:] for r in spark.sql("select * from keyed").collect()] == [("the elan 2nd edition", "elan", "lang", "9781119744825", True)]
    finally:
        q.stop()


def test_oversized_reads_stay_lazy(spark, small):
    plan = dedup.size_groups(catalog.books(small))._jdf.queryExecution().toString()
    assert "content" not in plan


def test_every_book_has_all_its_suppliers_as_authors(spark, sf_dir):
    from folioframe.plans import adapter

    pairs = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_suppkey").distinct().collect()
    links = adapter.catalog(spark, sf_dir)["books_authors_link"].select("book", "author").collect()
    assert sorted(map(tuple, links)) == sorted(map(tuple, pairs))


def test_parquet_catalogue_has_its_custom_columns(spark, tmp_path, sf_dir):
    from folioframe.plans import adapter
    from folioframe.sources import catalog_tables

    made = adapter.catalog(spark, sf_dir)
    for name in (*catalog_tables.SCHEMAS, "custom_columns", "custom_column_2", "books_custom_column_2_link"):
        made[name].write.parquet(f"{tmp_path}/{name}.parquet")
    read = catalog_tables.from_parquet(spark, str(tmp_path))
    edges = sorted(map(tuple, dedup.exempt_edges(read).collect()))
    assert edges and edges == sorted(map(tuple, dedup.exempt_edges(made).collect()))
    groups = lambda c: sorted((r.group_id, r.id) for r in dedup.title_groups(catalog.books(c), dedup.exempt_edges(c)).collect())
    assert groups(read) == groups(made)


def test_files_are_listed_and_hashed_in_tasks(spark, tmp_path):
    import hashlib
    import os

    (tmp_path / "a/.hidden/deep er").mkdir(parents=True)
    (tmp_path / "b [x]").mkdir()
    (tmp_path / "a/f{1}.pdf").write_bytes(b"x" * (manifest.CHUNK * 2 + 5))
    (tmp_path / "a/.hidden/deep er/empty").write_bytes(b"")
    os.symlink(tmp_path, tmp_path / "b [x]/loop")
    rows = {r.path: (r.is_dir, r.length) for r in manifest.scan(spark, str(tmp_path)).collect()}
    assert rows.keys() == {"a", "b [x]", "a/.hidden", "a/f{1}.pdf", "a/.hidden/deep er", "a/.hidden/deep er/empty", "b [x]/loop"}
    assert rows["a"] == (True, 0) and rows["a/f{1}.pdf"] == (False, manifest.CHUNK * 2 + 5) and not rows["b [x]/loop"][0]
    assert {r.path for r in manifest.scan(spark, str(tmp_path), depth=1).collect()} == {"a", "b [x]"}
    with pytest.raises(FileNotFoundError):
        manifest.scan(spark, str(tmp_path / "none"))
    paths = [str(tmp_path / "a/f{1}.pdf"), str(tmp_path / "a/.hidden/deep er/empty")]
    assert sorted((r.length, r.sha256) for r in manifest.hashes(spark, paths).collect()) == sorted((os.path.getsize(p), hashlib.sha256(open(p, "rb").read()).hexdigest()) for p in paths)
    asked = spark.createDataFrame([(paths[0],), (str(tmp_path / "no"),), (None,)], "path string")
    got = {r.path: (r.sha256 is None, r.error is None) for r in manifest.file_hashes(asked).collect()}
    assert got == {paths[0]: (False, True), str(tmp_path / "no"): (True, False), None: (True, False)}
    with pytest.raises(Exception, match="No such file"):
        manifest.hashes(spark, [str(tmp_path / "no")]).collect()


def test_first_candidates_are_in_order(spark):
    rows = spark.createDataFrame([(9, "existing-isbn"), (1, "pdf-scan-single-isbn"), (4, "existing-isbn"), (2, "pdf-scan-single-isbn")], "id long, source string")
    assert [r.id for r in match.first_candidates(rows, 3).collect()] == [4, 9, 1] and match.first_candidates(rows).count() == 4


def test_judged_as_difflib_says(spark):
    """Status, similarity and overlap of every candidate, against plain Python."""
    import difflib
    import random

    from folioframe.functions.text import fold_text

    rng = random.Random(9)
    word = lambda: rng.choice(["Élan", "ring", "blue", "Theory", "of", "sets", "Straße", "II"])
    say = lambda n: " ".join(word() for _ in range(n))
    people = ["Ann Lee", "Lang, Serge", "José Gärtner", "Jose\u0301 Ga\u0308rtner", "O’Keefe", "..."]
    rows = [(i, say(rng.randint(0, 5)), " & ".join(rng.sample(people, rng.randint(0, 2))), str(i % 35)) for i in range(120)]
    editions = [(str(i), rng.choice([None, "", say(3)]), rng.choice([None, "", say(2)]), rng.choice([None, say(4)]), rng.sample(people, rng.randint(0, 3)), rng.choice([None, None, None, "", "gone"])) for i in range(30)]
    key = lambda t: " ".join("".join(c if c.isalnum() and c.isascii() else " " for c in fold_text(t).lower()).split())
    surname = {"Ann Lee": "lee", "Lang, Serge": "lang", "José Gärtner": "gartner", "Jose\u0301 Ga\u0308rtner": "gartner", "O’Keefe": "okeefe", "...": ""}
    expect = {}
    for i, title, authors, number in rows:
        e = next((x for x in editions if x[0] == number), None)
        if e is None or e[5]:
            expect[i] = ("lookup-error", None, None)
            continue
        forms = [key(f) for f in (e[1], e[3], f"{e[1] or ''}: {e[2]}" if e[2] else None) if f]
        best = max([difflib.SequenceMatcher(None, key(title), f).ratio() for f in forms], default=0.0)
        names = [n for n in authors.split(" & ") if n]
        shared = len({surname[n] for n in names} & {surname[n] for n in e[4]} - {""})
        expect[i] = ("strong-candidate" if best >= match.THRESHOLD and (shared or not names) else "review-title-author", round(best, 3), shared)
    given = spark.createDataFrame(rows, "id long, title string, authors string, isbn string")
    got = match.match(given, spark.createDataFrame(editions, match.EDITION)).collect()
    assert {r.id: (r.status, r.title_similarity, r.author_overlap) for r in got} == expect
    assert [(r.status, r.id) for r in got] == sorted((r.status, r.id) for r in got)
    assert len({s for s, *_ in expect.values()}) == 3


def test_paths_are_never_broadcast(spark, monkeypatch):
    from pyspark.sql import functions as F

    paths = spark.range(300).select(F.concat(F.lit("/lib/S"), F.col("id") % 3, F.lit("/f"), "id").alias("path"))
    roots = spark.range(100_000).select(F.concat(F.lit("/lib"), F.when(F.col("id") % 2 == 0, F.lit("")).otherwise("/S1")).alias("root"))
    for sent in (integrity.SENT, 1):  # two roots: the second is one too many
        monkeypatch.setattr(integrity, "SENT", sent)
        got = integrity.nearest_root(paths, roots)
        assert "BuildLeft" not in got._jdf.queryExecution().toString()
        assert {r.path: r.root for r in got.collect()} == {f"/lib/S{i % 3}/f{i}": "/lib/S1" if i % 3 == 1 else "/lib" for i in range(300)}


@pytest.mark.parametrize("name", ["custom_column_2", "books_custom_column_2_link"])
def test_near_books_are_joined_by_near_keys(spark, tmp_path, sf_dir, name):
    """The exemption tables hold what their SQL says, and no join of theirs pairs all the books of a brand."""
    import duckdb

    from folioframe.plans import adapter

    rows = [(k, "ring" if k % 3 else "wheel", f"Brand#{k % 2}") for k in (-230, -150, -101, -100, -99, -1, 0, 1, 2, 64, 99, 100, 101, 130, 198, 199, 200, 201, 1000, 1099, 1100, 5000)]
    spark.createDataFrame([*rows, (None, "x", "Brand#1")], "p_partkey long, p_name string, p_brand string").selectExpr("*", "'T' AS p_type", "1 AS p_size", "1.0 AS p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    for t in ("supplier", "lineitem"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    made = adapter.catalog(spark, str(tmp_path))[name]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert sorted(map(tuple, made.collect())) == sorted(db.execute(adapter.TABLES[name]).fetchall())
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert all("p_name" in join or "hundred" in join for join in plan.splitlines() if "Join" in join)


def _batch(spark, seed=4):
    """Staged rows with large groups in common with the records, and edges among these."""
    import random

    rng = random.Random(seed)
    books = [(i, rng.choice(["Algebra", "Sets", "()", "The Ring"]), rng.choice(["Lang, S.", "A Bee", ""]), rng.choice([None, "9781119744825", "0471830062"])) for i in range(90)]
    files = [(rng.randrange(100), rng.choice([0, 5, 5, 7, None]), rng.choice(["x", "y", None])) for _ in range(150)]
    staged = [(i, rng.choice(["Algebra", "Ring", "()", "New"]), rng.choice(["S. Lang", "Bee", None]), rng.choice(["", None, "978-1-119-74482-5"]), rng.choice([0, 5, 7, 9, None]), rng.choice(["x", "z", None])) for i in range(120)]
    pairs = {tuple(sorted(rng.sample(range(90), 2))) for _ in range(400)}
    return (
        spark.createDataFrame(staged, "proposal_id long, title string, authors string, isbn string, size long, sha256 string"),
        spark.createDataFrame(books, "id long, title string, authors_str string, isbn string"),
        spark.createDataFrame(files, "book long, size long, sha256 string"),
        spark.createDataFrame(sorted(pairs), dedup.EDGES),
    )


def test_weighed_as_the_signals_say(spark):
    for seed in (4, 5):
        given = _batch(spark, seed)
        expect = sorted(map(tuple, dedup.verdicts(given[0], dedup.signals(*given)).collect()))
        assert sorted(map(tuple, dedup.weigh(*given).collect())) == expect and len({v for _, v, _ in expect}) == 3


@pytest.mark.parametrize("part", [1024, 3])
def test_signals_leave_the_joins_as_they_are(spark, monkeypatch, part):
    """Every signal, against plain Python; above the joins that make the pairs nothing is summed or shuffled."""
    from folioframe.functions.text import fold_text

    monkeypatch.setattr(dedup, "SLICE", part, raising=False)
    given = _batch(spark)
    staged, books, files, edges = (g.collect() for g in given)
    key = lambda t, a: (fold_text(t).lower().replace("the ", "").replace("()", ""), (a or "").split(",")[0].split(" ")[-1].lower())
    number = lambda n: (n or "").replace("-", "")
    have, near = {f.book for f in files}, {(e.a, e.b) for e in edges} | {(e.b, e.a) for e in edges}
    expect = set()
    for p in staged:
        same = [b.id for b in books if b.id in have and key(p.title, p.authors)[0] and key(p.title, p.authors) == key(b.title, (b.authors_str or "").replace("Lang, S.", "Lang"))]
        expect |= {(p.proposal_id, "title+author", b, any((b, o) in near for o in same)) for b in same}
        expect |= {(p.proposal_id, "isbn", b.id, False) for b in books if number(p.isbn) and number(p.isbn) == number(b.isbn)}
        for b in {f.book for f in files if p.size and f.size == p.size}:
            expect.add((p.proposal_id, "sha256" if any(f.book == b and f.size == p.size and f.sha256 and f.sha256 == p.sha256 for f in files) else "size", b, False))
    found = dedup.signals(*given)
    got = [(r.proposal_id, r.signal, r.book_id, r.suppressed) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == expect
    union = found._jdf.queryExecution().optimizedPlan()
    for i in range(union.children().size()):
        plan = union.children().apply(i)
        while plan.getClass().getSimpleName() == "Project":
            plan = plan.children().apply(0)
        assert plan.getClass().getSimpleName() == "Join"


def test_records_join_only_the_sides_that_are_read(small):
    full = catalog.books(small)
    for only in (("id", "title", "authors_str"), ("id", "sizes"), ("id", "isbn", "tags")):
        made = catalog.books(small, only=only)
        assert made.columns == list(only) and sorted(map(str, made.collect())) == sorted(map(str, full.select(*only).collect()))
    assert catalog.books(small, only=("id", "sizes"))._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


@pytest.mark.parametrize("name", ["custom_column_2", "books_custom_column_2_link"])
def test_exemptions_are_told_apart_by_their_ids(spark, tmp_path, sf_dir, name):
    """Books that are there twice, with two brands or with ids that meet those of the other kind; texts are made of ids already told apart."""
    import duckdb

    from folioframe.plans import adapter

    rows = [(k, "ring" if k % 3 else "wheel", f"Brand#{b}") for k in (0, 1, 2, 64, 65, 99, 100, 128, 192, 193, 1000000, 1000001, 1000064, 1000065, 1000128) for b in {k % 2, k % 3}]
    spark.createDataFrame([*rows, *rows[::2]], "p_partkey long, p_name string, p_brand string").selectExpr("*", "'T' AS p_type", "1 AS p_size", "1.0 AS p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    for t in ("supplier", "lineitem"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    made = adapter.catalog(spark, str(tmp_path))[name]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert sorted(map(tuple, made.collect())) == sorted(db.execute(adapter.TABLES[name]).fetchall())
    by = [x.split("Aggregate [")[1].split("]")[0] for x in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [" in x]
    assert by and not any("value" in x for x in by)


def test_exempt_ids_are_parted_without_lambdas(spark):
    """Any white space goes; signs, fractions, other digits and numbers beyond a long are no ids."""
    said = [(1, "\u00a02\u2003;\t3\n,\u0085 4 "), (1, "+5;-6;7.0;\u0668;9 9;1\n1;;99999999999999999999;0x10;\x1f11"), (20, "007; 20,\u300021"), (30, "")]
    edges = dedup.edges_of(spark.createDataFrame(said, "book long, value string"))
    assert sorted(map(tuple, edges.collect())) == [(1, 2), (1, 3), (1, 4), (7, 20), (20, 21)]
    assert "lambda" not in edges._jdf.queryExecution().optimizedPlan().toString()


def test_tables_of_a_parquet_catalogue_are_written_side_by_side(spark, sf_dir, monkeypatch):
    import threading

    from pyspark.sql.readwriter import DataFrameWriter

    from folioframe.plans import queries

    write, meet = DataFrameWriter.parquet, threading.Barrier(4, timeout=60)
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: meet.wait() >= 0 and write(self, path))
    assert queries.QUERIES["catalog_exempt_parquet"](spark, sf_dir).count() > 0
