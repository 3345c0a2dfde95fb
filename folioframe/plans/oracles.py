"""DuckDB SQL for the queries, from the same catalogue tables."""

from __future__ import annotations

from .adapter import with_tables

FOLD = "replace(strip_accents({}), 'ß', 'ss')"
ISBN_CTE = "cleaned AS (SELECT id, book, CASE WHEN regexp_matches(s, '^([0-9]{9}[0-9X]|[0-9]{13})$') THEN s ELSE '' END AS c FROM (SELECT id, book, regexp_replace(regexp_replace(regexp_replace(trim(val), '^\\s*isbn(-1[03])?\\s*[-: ]*', '', 'i'), '[^0-9Xx]', '', 'g'), 'x$', 'X') AS s FROM identifiers))"
_D = "cast(substr(c, {i}, 1) as int)"
_S13 = " + ".join(f"{1 if i % 2 else 3} * try_cast(substr(c, {i}, 1) as int)" for i in range(1, 14))
_S10 = " + ".join(f"{11 - i} * CASE substr(c, {i}, 1) WHEN 'X' THEN 10 ELSE try_cast(substr(c, {i}, 1) as int) END" for i in range(1, 11))
VALID = f"coalesce((length(c) = 13 AND regexp_matches(c, '^97[89]') AND ({_S13}) % 10 = 0) OR (length(c) = 10 AND ({_S10}) % 11 = 0), false)"

NAMES_CTE = """
names AS (SELECT book, list(a.name ORDER BY l.id, a.name) AS names FROM books_authors_link l JOIN authors a ON a.id = l.author GROUP BY book),
tagged AS (SELECT book, list(t.name ORDER BY l.id, t.name) AS tags FROM books_tags_link l JOIN tags t ON t.id = l.tag GROUP BY book),
files AS (SELECT d.book, list(concat(b.path, '/', d.name, '.', lower(d.format)) ORDER BY d.id) AS formats, list(coalesce(uncompressed_size, 0) ORDER BY d.id) AS sizes FROM data d JOIN books b ON b.id = d.book GROUP BY d.book),
pubs AS (SELECT book, p.name AS publisher FROM books_publishers_link l JOIN publishers p ON p.id = l.publisher),
isbns AS (SELECT book, val AS isbn FROM identifiers WHERE lower(type) = 'isbn'),
rec AS (SELECT b.id, b.title, b.path, b.uuid, b.pubdate, coalesce(array_to_string(n.names, ' & '), '') AS authors_str,
        coalesce(array_to_string(list_filter(list_transform(string_split(array_to_string(n.names, ' & '), '&'), lambda x: trim(x)), lambda x: x <> ''), '|'), '') AS authors,
        coalesce(array_to_string(t.tags, '|'), '') AS tags, coalesce(f.formats, []) AS formats, coalesce(f.sizes, []) AS sizes, i.isbn, p.publisher
        FROM books b LEFT JOIN names n ON n.book = b.id LEFT JOIN tagged t ON t.book = b.id LEFT JOIN files f ON f.book = b.id LEFT JOIN pubs p ON p.book = b.id LEFT JOIN isbns i ON i.book = b.id)"""
REC_TABLES = ("books", "authors", "books_authors_link", "tags", "books_tags_link", "publishers", "books_publishers_link", "data", "identifiers")


def _rec(sql: str, *more: str, ctes: str = "") -> str:
    return with_tables(NAMES_CTE + ctes + " " + sql, *REC_TABLES, *more)


CODES = "list_sort(list_distinct(list_transform(formats, lambda x: upper(regexp_extract(x, '\\.([^./]+)$', 1)))))"
EXTS = "list_sort(list_distinct(list_transform(formats, lambda x: lower(regexp_extract(x, '\\.([^./]+)$', 1)))))"
SEARCH_KEY = "trim(regexp_replace(lower(" + FOLD + "), '[^a-z0-9]+', ' ', 'g'))"


def group_key(c: str) -> str:
    s = f"lower({FOLD.format(c)})"
    for p in (r"\(.*?\)|\[.*?\]", r"(\d+(st|nd|rd|th)|first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth)\s+edition\b", r"\b(edition|ed|revised|rev|si)\b", r"\b(the|a|an)\b"):
        s = f"regexp_replace({s}, '{p}', ' ', 'g')"
    return f"trim(regexp_replace({s}, '[^a-z0-9]+', ' ', 'g'))"


def surname(c: str) -> str:
    first = f"trim(split_part({c}, '&', 1))"
    first = f"CASE WHEN contains({first}, ',') THEN split_part({first}, ',', 1) ELSE {first} END"
    s = f"regexp_replace(lower({FOLD.format(f'regexp_replace({first}, {chr(39)}[{chr(39)}{chr(39)}’]{chr(39)}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)})')}), '[^a-z0-9\\s-]+', ' ', 'g')"
    words = f"list_filter(list_transform(regexp_split_to_array({s}, '\\s+'), lambda w: trim(w, '-')), lambda w: w <> '')"
    return f"coalesce(list_filter({words}, lambda w: length(w) > 1 AND w NOT IN ('jr', 'sr', 'ii', 'iii', 'iv', 'phd', 'md', 'esq'))[-1], {words}[-1], '')"


EDGES_CTE = """
said AS (SELECT l.book, trim(p) AS p FROM books_custom_column_2_link l JOIN custom_column_2 v ON v.id = l.value, unnest(string_split(replace(v.value, ';', ','), ',')) AS u(p)),
edges AS (SELECT DISTINCT least(book, o) AS a, greatest(book, o) AS b FROM (SELECT book, try_cast(p as bigint) AS o FROM said WHERE regexp_matches(p, '^[0-9]+$')) WHERE o <> book)"""
EDGE_TABLES = ("custom_column_2", "books_custom_column_2_link")
FLAGS_CTE = f""",
{ISBN_CTE},
flagged AS (SELECT r.id, r.title, CASE WHEN {VALID} THEN c ELSE '' END AS isbn, coalesce(publisher, '') AS publisher, coalesce(pubdate, '') AS pubdate, {EXTS} AS exts, authors_str, tags
            FROM rec r LEFT JOIN cleaned k ON k.book = r.id AND k.id = r.id * 2),
told AS (SELECT *, list_filter([CASE WHEN isbn = '' THEN 'missing-isbn' END, CASE WHEN trim(publisher) = '' THEN 'missing-publisher' END, CASE WHEN pubdate = '' OR starts_with(pubdate, '0101-') THEN 'missing-pubdate' END,
         CASE WHEN lower(trim(authors_str)) IN ('', 'unknown', 'unknown author', 'administrator', 'administrateur', 'owner') THEN 'bad-author' END,
         CASE WHEN trim(title) = '' OR regexp_matches(title, '^microsoft word\\s*-|\\bebok\\b|\\.(pdf|epub|mobi|azw3|djvu|rtf)$|^b0[0-9a-z]{{8}}\\b', 'i') THEN 'junk-title' END, CASE WHEN tags = '' THEN 'missing-tags' END], lambda x: x IS NOT NULL) AS issues FROM flagged)"""
FOUND_CTE = """,
found AS (SELECT id, title, error, CASE WHEN error IS NOT NULL THEN [] WHEN id % 5 = 0 THEN ['9780262035613', '0262035618'] WHEN id % 5 = 1 THEN ['0471830062'] WHEN id % 5 = 4 THEN ['9781119744825'] ELSE [] END AS isbns FROM sources)"""
GROUPS = """
keyed AS (SELECT id, {key} AS k FROM rec),
sized AS (SELECT k, count(*) AS n, min(id) AS group_id FROM keyed WHERE k[1] <> '' GROUP BY k HAVING count(*) > 1),
open_pairs AS (SELECT DISTINCT x.k FROM keyed x JOIN keyed y ON x.k = y.k AND x.id < y.id LEFT JOIN edges e ON e.a = x.id AND e.b = y.id WHERE e.a IS NULL)"""
TITLE_KEY = f"[{group_key('title')}, {surname('authors_str')}]"
NO_EDGES = "edges AS (SELECT cast(NULL as bigint) AS a, cast(NULL as bigint) AS b WHERE false)"
STAGED_CTE = f""",
staged AS (SELECT id AS proposal_id, CASE WHEN id % 40 = 0 THEN concat('Other ', title) ELSE title END AS title, authors_str AS authors, CASE WHEN id % 60 = 0 THEN isbn ELSE '' END AS isbn,
           CASE WHEN id % 100 = 0 THEN sizes[1] ELSE 0 END AS size, concat('h', id % 200) AS sha FROM rec),
{ISBN_CTE}, byisbn AS (SELECT DISTINCT s.proposal_id, 'isbn' AS signal, r.id AS book_id, false AS suppressed FROM staged s JOIN cleaned a ON a.id = s.proposal_id * 2 AND s.isbn <> '' AND a.c <> '' JOIN cleaned b ON b.c = a.c AND b.id % 2 = 0 JOIN rec r ON r.id = b.book),
bysize AS (SELECT s.proposal_id, CASE WHEN max(CASE WHEN s.sha = concat('h', d.book % 200) THEN 1 ELSE 0 END) = 1 THEN 'sha256' ELSE 'size' END AS signal, d.book AS book_id, false AS suppressed FROM staged s JOIN data d ON s.size > 0 AND d.uncompressed_size = s.size GROUP BY s.proposal_id, d.book),
keyed AS (SELECT id, [{group_key("title")}, {surname("authors_str")}] AS k FROM rec WHERE id IN (SELECT book FROM data)),
bytitle0 AS (SELECT s.proposal_id, k.id AS book_id FROM (SELECT proposal_id, [{group_key("title")}, {surname("authors")}] AS k FROM staged) s JOIN keyed k ON k.k = s.k AND s.k[1] <> ''),
bytitle AS (SELECT x.proposal_id, 'title+author' AS signal, x.book_id, EXISTS (SELECT 1 FROM bytitle0 y JOIN edges e ON (e.a = x.book_id AND e.b = y.book_id) OR (e.b = x.book_id AND e.a = y.book_id) WHERE y.proposal_id = x.proposal_id) AS suppressed FROM bytitle0 x),
signals AS (SELECT * FROM byisbn UNION ALL SELECT * FROM bysize UNION ALL SELECT * FROM bytitle),
verdicts AS (SELECT s.proposal_id, CASE WHEN bool_or(signal IN ('isbn', 'sha256')) THEN 'block' WHEN bool_or(signal NOT IN ('isbn', 'sha256') AND NOT suppressed) THEN 'warn' ELSE 'ok' END AS verdict, count(signal) AS n_signals FROM staged s LEFT JOIN signals g ON g.proposal_id = s.proposal_id GROUP BY s.proposal_id)"""


def _staged(sql: str) -> str:
    return with_tables(NAMES_CTE + ", " + EDGES_CTE + STAGED_CTE + " " + sql, *REC_TABLES, *EDGE_TABLES)


SCANNED_CTE = """,
targets AS (SELECT r.id, list_filter(r.formats, lambda x: lower(x) LIKE '%.pdf')[1] AS path FROM rec r JOIN told t ON t.id = r.id WHERE t.isbn = '' AND list_contains(t.exts, 'pdf')),
scanned AS (SELECT concat(b.path, '/file ', b.id, '.pdf') AS path, (CASE WHEN bool_or(l.page = 0) THEN 1 ELSE 0 END) + (CASE WHEN bool_or(l.page = 6) THEN 2 ELSE 0 END) AS bits,
            sum(CASE l.page WHEN 0 THEN 18 WHEN 6 THEN 15 ELSE 6 END) + count(*) - 1 AS chars, CASE WHEN b.id % 16 = 0 AND bool_or(l.page = 0) THEN 'no PDF' END AS error
            FROM books b JOIN (SELECT DISTINCT l_partkey AS k, l_linenumber - 1 AS page FROM lineitem) l ON l.k = b.id WHERE l.page < 2 OR l.page >= 5 GROUP BY b.id, b.path)"""


def _masked_0(x: str) -> str:
    """Hyphens of a number of group 0 after 978, from the eight digits after the group."""
    size = f"CASE WHEN {x} < '20' THEN 2 WHEN {x} < '70' THEN 3 WHEN {x} < '85' THEN 4 WHEN {x} < '90' THEN 5 WHEN {x} < '95' THEN 6 ELSE 7 END"
    return f"concat('978-0-', substr({x}, 1, {size}), '-', substr({x}, {size} + 1), '-', substr(c, 13, 1))"


#: Query (normalised), forms, margin and limit of each search.
SEARCHES = {"title": ("smal wigdet", "title", 0.15, 10), "authors": ("gartner ruiz", "authors", 0.15, 20), "both": ("strasse elan ring", "both", 0.15, 15), "margin_off": ("blue ring", "both", 1.0, 50)}


def _search(q: str, field: str, margin: float, limit: int) -> str:
    """Longest common subsequences bit by bit: a query's characters are the bits of a number, a candidate's are folded over it."""

    def similar(query: str, m: str, c: str) -> str:
        full = f"((1::BIGINT << {m}) - 1)"
        places = f"list_sum(list_transform(range({m}), lambda i: CASE WHEN substr({query}, i + 1, 1) = ch THEN 1::BIGINT << i ELSE 0 END))::BIGINT"
        row = f"list_reduce(list_transform(string_split({c}, ''), lambda ch: {places}), lambda row, x: ((row + (row & x)) | (row - (row & x))) & {full}, {full})"
        return f"(1 - (cast({m} + length({c}) as double) - 2 * ({m} - bit_count({row}))) / ({m} + length({c})))"

    words = q.split()
    key = {f: SEARCH_KEY.format(f) for f in ("title", "authors_str")}
    forms = {"title": [key["title"]], "authors": [key["authors_str"]], "both": [key["title"], key["authors_str"], f"concat_ws(' ', {key['title']}, {key['authors_str']})"]}[field]
    total = " + ".join(f"coalesce(max(CASE WHEN q = '{w}' THEN s END), 0)" for w in dict.fromkeys(words))
    return _rec(f"""SELECT score, id, title, authors_str AS authors FROM kept WHERE score >= (SELECT max(score) FROM kept) - {margin} ORDER BY score DESC, id LIMIT {limit}""", ctes=f""",
form AS (SELECT id, unnest([{", ".join(forms)}]) AS c FROM rec),
text AS (SELECT DISTINCT c FROM form WHERE c <> ''),
word AS (SELECT DISTINCT w FROM text, unnest(string_split(c, ' ')) AS u(w) WHERE w <> ''),
near AS (SELECT w, q, {similar("q", "length(q)", "w")} AS s FROM word, (SELECT unnest({words!r}) AS q)),
by_word AS (SELECT c, ({total}) / {len(words)} AS s FROM (SELECT DISTINCT c, w FROM text, unnest(string_split(c, ' ')) AS u(w)) t JOIN near n ON n.w = t.w GROUP BY c),
raw AS (SELECT t.c, CASE WHEN contains(t.c, '{q}') THEN 1.0 WHEN 2.0 * least(length(t.c), {len(q)}) / (length(t.c) + {len(q)}) <= coalesce(s, 0) THEN s ELSE greatest(coalesce(s, 0), {similar(f"'{q}'", str(len(q)), "t.c")}) END AS s FROM text t LEFT JOIN by_word b ON b.c = t.c),
kept AS (SELECT * FROM (SELECT r.id, r.title, r.authors_str, round(max(coalesce(w.s, 0)), 3) AS score, max(coalesce(w.s, 0)) AS raw FROM rec r JOIN form f ON f.id = r.id LEFT JOIN raw w ON w.c = f.c GROUP BY r.id, r.title, r.authors_str) WHERE raw >= 0.55)""")


def oracles() -> dict[str, str]:
    out = {
        "catalog_books": _rec("SELECT id, title, authors, authors_str, tags, array_to_string(formats, '|') AS formats, array_to_string(sizes, '|') AS sizes, isbn, path, uuid, pubdate, publisher, CASE WHEN length(uuid) > 0 THEN concat('folio://', uuid) END AS link FROM rec"),
        "catalog_point_lookup": _rec("SELECT id, title, authors_str, array_to_string(formats, '|') AS formats, isbn, publisher FROM rec WHERE id = 55"),
        "catalog_formats": _rec(f"SELECT id, array_to_string(formats, '|') AS paths, array_to_string({CODES}, '|') AS codes, array_to_string(list_filter(formats, lambda x: lower(x) LIKE '%.pdf'), '|') AS pdfs FROM rec"),
        "catalog_listing": _rec(f"SELECT id, uuid, title, authors_str AS authors, array_to_string({CODES}, '|') AS formats FROM rec ORDER BY lower(title), id"),
        "catalog_identifiers": with_tables("x AS (SELECT 1) SELECT book, string_agg(concat(type, ':', val), ',' ORDER BY type) AS identifiers FROM identifiers GROUP BY book", "identifiers"),
        "tags_usage": with_tables("x AS (SELECT 1) SELECT min(name) AS name, count(*) AS n FROM books_tags_link l JOIN tags t ON t.id = l.tag GROUP BY lower(name) HAVING count(*) >= 2", "tags", "books_tags_link"),
        "books_by_tag": with_tables("x AS (SELECT 1) SELECT DISTINCT b.id, b.title FROM books b JOIN books_tags_link l ON l.book = b.id JOIN tags t ON t.id = l.tag WHERE lower(t.name) = 'flag a'", "books", "tags", "books_tags_link"),
        "text_search_key_docs": f"SELECT doc_id, {SEARCH_KEY.format('text')} AS search_key FROM documents",
        "text_group_key": with_tables(f"x AS (SELECT 1) SELECT id, {group_key('title')} AS group_key, {SEARCH_KEY.format('title')} AS search_key FROM books", "books"),
        "text_surname_key": with_tables(f"x AS (SELECT 1) SELECT id, {surname('name')} AS surname_key FROM authors", "authors"),
        "text_split_authors": _rec("SELECT id, len(names) AS n, array_to_string(names, '|') AS names, CASE WHEN len(names) <= 3 THEN array_to_string(names, ' & ') ELSE concat(array_to_string(names[1:3], ' & '), ' & +', len(names) - 3) END AS short FROM (SELECT id, list_filter(list_transform(regexp_split_to_array(concat(authors_str, ' and Last One'), '\\s*&\\s*|\\s+and\\s+'), lambda x: trim(x)), lambda x: x <> '') AS names FROM rec)"),
        "text_html_entity_gate": "SELECT page_id, regexp_matches(html, '&(amp|lt|gt|quot|#39|apos|nbsp);') AS refused FROM pages",
        "isbn_clean": with_tables(f"{ISBN_CTE} SELECT id, c AS cleaned FROM cleaned", "identifiers"),
        "isbn_valid": with_tables(f"{ISBN_CTE} SELECT id, {VALID} AS valid FROM cleaned", "identifiers"),
        "isbn_to13": with_tables(f"{ISBN_CTE}, tens AS (SELECT id, CASE WHEN regexp_matches(s, '^([0-9]{{9}}[0-9X]|[0-9]{{13}})$') THEN s ELSE '' END AS c FROM (SELECT id, substr(c, 4, 10) AS s FROM cleaned)) SELECT id, CASE WHEN length(c) = 10 AND ({_S10}) % 11 = 0 THEN concat('978', substr(c, 1, 9), (10 - (38 + " + " + ".join(f"{3 if i % 2 else 1} * try_cast(substr(c, {i}, 1) as int)" for i in range(1, 10)) + ") % 10) % 10) ELSE c END AS isbn13 FROM tens", "identifiers"),
        "isbn_extract_text": with_tables("x AS (SELECT 1) SELECT id, CASE id % 5 WHEN 0 THEN '9780262035613|0262035618' WHEN 1 THEN '0471830062' WHEN 4 THEN '9781119744825' ELSE '' END AS isbns FROM sources", "sources"),
        "dup_exempt_edges": with_tables(EDGES_CTE + " SELECT a, b FROM edges", *EDGE_TABLES),
        "dup_title_groups": with_tables(NAMES_CTE + ", " + EDGES_CTE + ", " + GROUPS.format(key=TITLE_KEY) + " SELECT group_id, id FROM keyed JOIN sized USING (k) WHERE k IN (SELECT k FROM open_pairs)", *REC_TABLES, *EDGE_TABLES),
        "dup_title_groups_raw": with_tables(NAMES_CTE + ", " + NO_EDGES + ", " + GROUPS.format(key=TITLE_KEY) + " SELECT group_id, id FROM keyed JOIN sized USING (k)", *REC_TABLES),
        "dup_size_groups": with_tables(EDGES_CTE + ", m AS (SELECT DISTINCT book AS id, uncompressed_size AS size FROM data WHERE uncompressed_size > 0 AND book IN (SELECT id FROM books)), g AS (SELECT size, min(id) AS group_id FROM m GROUP BY size HAVING count(*) > 1), o AS (SELECT DISTINCT x.size FROM m x JOIN m y ON x.size = y.size AND x.id < y.id LEFT JOIN edges e ON e.a = x.id AND e.b = y.id WHERE e.a IS NULL) SELECT group_id, size, id FROM m JOIN g USING (size) WHERE size IN (SELECT size FROM o)", "books", "data", *EDGE_TABLES),
        "dup_isbn_groups": with_tables(f"{ISBN_CTE}, g AS (SELECT c, min(book) AS group_id FROM cleaned WHERE c <> '' AND id % 2 = 0 GROUP BY c HAVING count(*) > 1) SELECT group_id, c AS isbn, book AS id FROM cleaned JOIN g USING (c) WHERE id % 2 = 0", "identifiers"),
        "dup_text_hash": "SELECT sha256(text) AS sha256, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
        "dup_signals_batch": _staged("SELECT * FROM signals"),
        "dup_verdict_batch": _staged("SELECT * FROM verdicts"),
        "audit_flags": _rec("SELECT id, isbn, publisher, pubdate, array_to_string(exts, '|') AS format_exts, array_to_string(issues, '|') AS issues FROM told", ctes=FLAGS_CTE),
        "audit_issue_counts": _rec("SELECT issue, count(*) AS n, min(id) AS first_id FROM (SELECT id, unnest(issues) AS issue FROM told) GROUP BY issue", ctes=FLAGS_CTE),
        "audit_format_counts": _rec("SELECT ext, count(*) AS n, min(id) AS first_id FROM (SELECT id, unnest(exts) AS ext FROM told) GROUP BY ext", ctes=FLAGS_CTE),
        "audit_summary": _rec("SELECT count(*) AS books, count_if(isbn <> '') AS records_with_isbn, count_if(isbn <> '' AND (list_contains(issues, 'missing-publisher') OR list_contains(issues, 'missing-pubdate'))) AS safe_existing_isbn_lookup_candidates, count_if(list_contains(issues, 'missing-isbn') AND list_contains(exts, 'pdf')) AS pdf_isbn_extraction_candidates, " + ", ".join(f"count_if(list_contains(issues, '{i}')) AS {i.replace('-', '_')}" for i in ("missing-isbn", "missing-publisher", "missing-pubdate", "bad-author", "junk-title", "missing-tags")) + " FROM told", ctes=FLAGS_CTE),
        "audit_fill_queue": _rec("SELECT id, isbn FROM told WHERE isbn <> '' AND list_has_any(issues, ['missing-publisher', 'missing-pubdate'])", ctes=FLAGS_CTE),
        "audit_extract_queue": _rec("SELECT id FROM told WHERE list_contains(issues, 'missing-isbn') AND list_contains(exts, 'pdf')", ctes=FLAGS_CTE),
        "audit_scan_classes": with_tables("x AS (SELECT 1)" + FOUND_CTE + " SELECT count(*) AS scanned_pdf_candidates, count_if(len(isbns) > 0) AS scanned_pdfs_with_isbn, count_if(len(isbns) = 1) AS single_isbn_scan_hits, count_if(len(isbns) > 1) AS multi_isbn_scan_hits, count_if(len(isbns) = 0 AND error IS NULL) AS no_isbn_no_error, count_if(error IS NOT NULL) AS scan_errors, count_if(error = 'timeout after 20s') AS scan_timeouts FROM found", "sources"),
        "match_candidates": _rec(", own AS (SELECT id, title, isbn, 'existing-isbn' AS source, array_to_string(issues, '|') AS issues FROM told WHERE isbn <> '' AND list_has_any(issues, ['missing-publisher', 'missing-pubdate'])) SELECT * FROM own UNION ALL SELECT id, title, isbns[1], CASE WHEN len(isbns) = 1 THEN 'pdf-scan-single-isbn' ELSE 'pdf-scan-multi-isbn-first' END, 'missing-isbn' FROM found WHERE len(isbns) >= 1 AND id NOT IN (SELECT id FROM own)", "sources", ctes=FLAGS_CTE + FOUND_CTE),
        "match_author_overlap": _rec("SELECT r.id, count(DISTINCT k) FILTER (WHERE k IN ('smith1', 'okeefe2', 'lang3', 'gartner-ruiz4')) AS shared FROM rec r LEFT JOIN (SELECT l.book, " + surname("a.name") + " AS k FROM books_authors_link l JOIN authors a ON a.id = l.author) s ON s.book = r.id GROUP BY r.id"),
        "fs_orphans": with_tables("d AS (SELECT path, try_cast(regexp_extract(path, '\\((\\d+)\\)$', 1) as bigint) AS id FROM manifest WHERE is_dir AND len(string_split(path, '/')) = 2) SELECT d.id, d.path, coalesce((SELECT string_agg(split_part(m.path, '/', 3), '|' ORDER BY m.path) FROM manifest m WHERE NOT m.is_dir AND starts_with(m.path, concat(d.path, '/'))), '') AS files FROM d WHERE d.id IS NOT NULL AND d.id NOT IN (SELECT id FROM books)", "manifest", "books"),
        "fs_missing_formats": _rec("SELECT id, title, f AS missing FROM rec, unnest(formats) AS u(f) WHERE f NOT IN (SELECT path FROM manifest WHERE NOT is_dir)", "manifest"),
        "fs_case_drift": with_tables("x AS (SELECT 1) SELECT id, title, split_part(path, '/', 2) AS expected, upper(regexp_extract(split_part(path, '/', 2), '^(.*) \\(', 1)) || ' (' || id || ')' AS on_disk, split_part(path, '/', 1) AS parent FROM books WHERE id % 37 = 0", "books"),
        "fs_resolve_paths": with_tables("p AS (SELECT concat('/lib/', path) AS path, try_cast(regexp_extract(split_part(path, '/', 2), '\\((\\d+)\\)$', 1) as bigint) AS k FROM manifest WHERE NOT is_dir) SELECT p.path, b.id, b.title FROM p LEFT JOIN books b ON b.id = p.k", "manifest", "books"),
        "outline_sanitize": "WITH RECURSIVE e AS (SELECT conv_id AS doc_id, turn AS pos, CASE WHEN role = 'user' THEN 3 ELSE length(text) % 4 END AS l, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS title, turn AS page FROM conversations WHERE turn % 7 <> 5), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM e WHERE title <> ''), w AS (SELECT doc_id, pos, cast(1 as bigint) AS level, title, page, r FROM k WHERE r = 1 UNION ALL SELECT k.doc_id, k.pos, cast(least(greatest(1, k.l), w.level + 1) as bigint), k.title, k.page, k.r FROM w JOIN k ON k.doc_id = w.doc_id AND k.r = w.r + 1) SELECT doc_id, pos, level, title, cast(greatest(1, page) as bigint) AS page FROM w",
        "ident_merge": with_tables("x AS (SELECT 1) SELECT book, string_agg(concat(type, ':', val), ',' ORDER BY type) AS identifiers FROM (SELECT book, type, val FROM identifiers WHERE type NOT IN ('doi', 'isbn') UNION ALL SELECT DISTINCT book, 'doi', '10/x' FROM identifiers UNION ALL SELECT DISTINCT book, 'isbn', concat('1:', book) FROM identifiers) GROUP BY book", "identifiers"),
        "ident_remove": with_tables("x AS (SELECT 1) SELECT book, coalesce(string_agg(concat(type, ':', val), ',' ORDER BY type) FILTER (WHERE type <> 'doi'), '') AS identifiers FROM identifiers GROUP BY book", "identifiers"),
        "writeplan_gate": _staged("SELECT proposal_id, reason IS NULL AS allowed, reason, verdict FROM (SELECT s.proposal_id, verdict, CASE WHEN s.proposal_id % 140 = 0 THEN 'file-missing' WHEN s.proposal_id % 80 = 0 THEN 'no-extension' WHEN (s.proposal_id % 180 <> 0 AND title = '') OR s.proposal_id % 220 = 0 OR authors = '' THEN 'title-and-authors-required' WHEN s.proposal_id % 180 = 0 THEN 'html-entity' WHEN s.proposal_id % 260 = 0 THEN 'gui-open' WHEN verdict = 'block' AND s.proposal_id % 120 <> 0 THEN 'duplicate' END AS reason FROM staged s JOIN verdicts v ON v.proposal_id = s.proposal_id)"),
        "writeplan_formats": with_tables("p AS (SELECT p_partkey AS k, p_partkey * 2 AS b, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE 'PDF' END AS ext FROM part) SELECT k AS proposal_id, reason IS NULL AS allowed, reason, ext FROM (SELECT k, ext, CASE WHEN k % 8 = 0 THEN 'file-missing' WHEN ext = '' THEN 'no-extension' WHEN b NOT IN (SELECT id FROM books) THEN 'unknown-book' WHEN k % 3 <> 0 AND EXISTS (SELECT 1 FROM data d WHERE d.book = p.b AND upper(d.format) = ext) THEN 'format-present' WHEN k % 7 = 0 THEN 'gui-open' END AS reason FROM p)", "books", "data"),
        "sim_lcs_tokens": "WITH RECURSIVE q AS (SELECT 'smoll wdget' AS q), n AS (SELECT DISTINCT p_name FROM part), w AS (SELECT p_name, 0 AS i, list_transform(range(0, 12), lambda x: 0) AS row FROM n UNION ALL SELECT p_name, i + 1, (SELECT list(v ORDER BY j) FROM (SELECT j, max(c) OVER (ORDER BY j) AS v FROM (SELECT j, CASE WHEN j > 0 AND substr((SELECT q FROM q), j::int, 1) = substr(p_name, i + 1, 1) THEN row[j] + 1 ELSE row[j + 1] END AS c FROM range(0, 12) AS t(j)))) FROM w WHERE i < length(p_name)) SELECT p_name, cast(row[12] as bigint) AS lcs FROM w WHERE i = length(p_name)",
    }
    out |= {f"search_{name}": _search(*how) for name, how in SEARCHES.items()}
    out |= {
        "audit_scan_texts": _rec("SELECT t.id, t.path, coalesce(CASE WHEN s.error IS NULL THEN CASE WHEN bits = 3 THEN '0262035618|0471830062' WHEN bits = 1 THEN '0471830062' WHEN bits = 2 THEN '0262035618' ELSE '' END END, '') AS isbns, coalesce(s.chars, 0) AS text_chars, CASE WHEN s.path IS NULL THEN 'no text' ELSE s.error END AS error FROM targets t LEFT JOIN scanned s ON s.path = t.path", ctes=FLAGS_CTE + SCANNED_CTE),
        "audit_scan_join": _rec("SELECT r.id, r.isbn, array_to_string(f.isbns, '|') AS found, f.error FROM told r LEFT JOIN found f ON f.id = r.id", "sources", ctes=FLAGS_CTE + FOUND_CTE),
        "audit_scan_errors": with_tables("x AS (SELECT 1) SELECT id, error FROM sources WHERE error IS NOT NULL ORDER BY id", "sources"),
        "writeplan_metadata": with_tables("""x AS (SELECT 1), p AS (SELECT id, CASE id % 5 WHEN 0 THEN 'authors' WHEN 1 THEN 'title' WHEN 2 THEN 'identifiers' ELSE 'publisher' END AS k FROM books),
            kept AS (SELECT book, type, val FROM identifiers WHERE type NOT IN ('zotero', 'doi') UNION ALL SELECT id, unnest(['zotero', 'doi']), unnest([concat('', id), '']) FROM p),
            merged AS (SELECT book, string_agg(concat(type, ':', val), ',' ORDER BY type) AS identifiers FROM kept GROUP BY book),
            same AS (SELECT book, string_agg(concat(type, ':', val), ',' ORDER BY type) AS identifiers FROM identifiers GROUP BY book)
            SELECT id AS proposal_id, reason IS NULL AS allowed, reason, CASE WHEN k = 'identifiers' THEN coalesce(CASE WHEN id % 7 = 0 THEN s.identifiers ELSE m.identifiers END, '') END AS identifiers
            FROM (SELECT *, CASE WHEN id % 11 = 0 THEN 'gui-open' WHEN id % 7 = 0 THEN 'html-entity' WHEN k = 'authors' THEN 'authors-never' WHEN k = 'title' AND id % 2 <> 0 THEN 'title-needs-force' END AS reason FROM p) q
            LEFT JOIN merged m ON m.book = q.id LEFT JOIN same s ON s.book = q.id""", "books", "identifiers"),
        "writeplan_removal": with_tables("""x AS (SELECT 1), p AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'doi' ELSE 'isbn' END AS t FROM books)
            SELECT id AS proposal_id, reason IS NULL AS allowed, reason, coalesce((SELECT string_agg(concat(type, ':', val), ',' ORDER BY type) FROM identifiers i WHERE i.book = q.id AND type <> t), '') AS identifiers
            FROM (SELECT *, CASE WHEN id % 11 = 0 THEN 'gui-open' WHEN NOT EXISTS (SELECT 1 FROM identifiers i WHERE i.book = p.id AND type = t) THEN 'identifier-absent' END AS reason FROM p) q""", "books", "identifiers"),
        "writeplan_reported_ids": with_tables("x AS (SELECT 1) SELECT id, concat(id, '|', id + 7) AS ids FROM books", "books"),
        "fs_nearest_root": with_tables("x AS (SELECT 1) SELECT concat('/lib/', path) AS path, concat('/lib/', split_part(path, '/', 1)) AS root FROM manifest WHERE NOT is_dir", "manifest"),
        "fs_resolve_discovered": with_tables("x AS (SELECT 1), p AS (SELECT concat('/lib/', path) AS path, CASE WHEN starts_with(path, 'Shelf 7/') THEN '/lib/Shelf 7' ELSE '/lib' END AS root, try_cast(regexp_extract(split_part(path, '/', 2), '\\((\\d+)\\)$', 1) as bigint) AS k FROM manifest WHERE NOT is_dir) SELECT p.path, p.root, b.id, b.title FROM p LEFT JOIN books b ON b.id = p.k", "manifest", "books"),
        "isbn_hyphenated": with_tables(f"{ISBN_CTE} SELECT id, CASE WHEN length(c) = 13 AND starts_with(c, '9780') THEN {_masked_0('substr(c, 5, 8)')} ELSE c END AS hyphenated, c AS cleaned FROM cleaned", "identifiers"),
        "catalog_exempt_parquet": out["dup_exempt_edges"],
        "stream_keyed": with_tables(f"x AS (SELECT 1) SELECT id, {SEARCH_KEY.format('title')} AS search_key, {group_key('title')} AS group_key, 'lang' AS surname_key, concat('978111974482', id % 10) AS isbn_clean, id % 10 = 5 AS isbn_valid FROM books", "books"),
    }
    out["audit_report_summary"] = f"SELECT * FROM ({out['audit_summary']}), ({out['audit_scan_classes']}), (SELECT count(DISTINCT group_id) AS duplicate_title_groups FROM ({out['dup_title_groups']})), (SELECT cast(20 AS bigint) AS scan_timeout_seconds, cast(0 AS bigint) AS scan_limit, cast(4 AS bigint) AS scan_workers)"
    out["fs_orphans_excluded"] = out["fs_orphans"].replace("WHERE d.id IS NOT NULL", "WHERE NOT regexp_matches(d.path, '^Shelf 2?7/') AND d.id IS NOT NULL")
    out["match_candidates"] = out["match_candidates"].replace(" , own", ", own")
    return out
