"""A catalogue made of the benchmark's star schema. These statements run alike in Spark and in DuckDB, so that both sides
of a comparison start from the same rows; what is compared is the operators, which are written apart for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.catalog_tables import Catalog

_STEM = "concat('978', lpad(concat('', k), 9, '0'))"
_CHECK = "(10 - (" + " + ".join(f"{3 if i % 2 == 0 else 1} * cast(substr({_STEM}, {i}, 1) as int)" for i in range(1, 13)) + ") % 10) % 10"

TABLES = {
    "books": """
        SELECT p_partkey AS id,
               CASE WHEN p_partkey % 11 = 0 THEN concat('Microsoft Word - ', p_name)
                    WHEN p_partkey % 5 = 0 THEN concat('The ', p_name, ' (2nd Edition)')
                    WHEN p_partkey % 7 = 0 THEN concat(p_name, ', Third Edition')
                    WHEN p_partkey % 23 = 0 THEN concat('Élan ', p_name, ' – Straße')
                    ELSE p_name END AS title,
               concat('', p_partkey) AS sort, '2024-01-01' AS timestamp,
               CASE WHEN p_partkey % 13 = 0 THEN '0101-01-01T00:00:00+00:00' WHEN p_partkey % 19 = 0 THEN NULL ELSE concat('', 1990 + p_partkey % 30, '-01-01') END AS pubdate,
               concat('Shelf ', p_partkey % 50, '/', p_name, ' (', p_partkey, ')') AS path,
               CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE md5(concat('', p_partkey)) END AS uuid, '2024-01-02' AS last_modified
        FROM part""",
    "authors": """
        SELECT s_suppkey AS id,
               CASE s_suppkey % 5 WHEN 0 THEN concat('José Gärtner-Ruiz', s_suppkey % 7) WHEN 1 THEN concat('O''Keefe', s_suppkey % 9, ', Ann')
                    WHEN 2 THEN concat('Serge Lang', s_suppkey % 6, ' Jr.') WHEN 3 THEN 'Unknown' ELSE concat('Ann B. Smith', s_suppkey % 8) END AS name
        FROM supplier""",
    "books_authors_link": "SELECT DISTINCT l_suppkey AS id, l_partkey AS book, l_suppkey AS author FROM lineitem",
    "tags": "SELECT DISTINCT 100 + length(p_type) * 10 + ascii(p_type) % 10 AS id, p_type AS name FROM part UNION SELECT DISTINCT ascii(l_returnflag) AS id, concat('Flag ', l_returnflag) AS name FROM lineitem",
    "books_tags_link": """
        SELECT 1000 AS id, p_partkey AS book, 100 + length(p_type) * 10 + ascii(p_type) % 10 AS tag FROM part WHERE p_partkey % 9 <> 0
        UNION SELECT DISTINCT ascii(l_returnflag) AS id, l_partkey AS book, ascii(l_returnflag) AS tag FROM lineitem WHERE l_partkey % 9 <> 0""",
    "publishers": "SELECT DISTINCT cast(substr(p_brand, 7) as bigint) AS id, p_brand AS name FROM part",
    "books_publishers_link": "SELECT p_partkey AS id, p_partkey AS book, cast(substr(p_brand, 7) as bigint) AS publisher FROM part WHERE p_partkey % 6 <> 0",
    "data": """
        SELECT min(ascii(l_linestatus)) AS id, l_partkey AS book, CASE l_linestatus WHEN 'O' THEN 'PDF' ELSE 'EPUB' END AS format,
               CASE WHEN l_partkey % 17 = 0 THEN 0 ELSE cast(sum(l_quantity) as bigint) END AS uncompressed_size, concat('file ', l_partkey) AS name
        FROM lineitem GROUP BY l_partkey, l_linestatus""",
    "identifiers": f"""
        SELECT p_partkey * 2 AS id, p_partkey AS book, CASE WHEN p_partkey % 3 = 0 THEN 'ISBN' ELSE 'isbn' END AS type,
               CASE WHEN p_partkey % 4 = 0 THEN concat('ISBN-13: ', substr(v, 1, 3), '-', substr(v, 4, 5), '-', substr(v, 9)) WHEN p_partkey % 31 = 0 THEN substr(v, 1, 12) ELSE v END AS val
        FROM (SELECT p_partkey, concat({_STEM}, CASE WHEN p_partkey % 5 = 1 THEN ({_CHECK} + 1) % 10 ELSE {_CHECK} END) AS v
              FROM (SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 AND p_partkey > 0 THEN p_partkey - 1 ELSE p_partkey END AS k FROM part) keyed) made
        WHERE p_partkey % 12 <> 5
        UNION ALL SELECT p_partkey * 2 + 1 AS id, p_partkey AS book, 'doi' AS type, concat('10.', p_partkey) AS val FROM part WHERE p_partkey % 2 = 0""",
    "custom_columns": "SELECT cast(2 as bigint) AS id, 'dupok' AS label",
    "custom_column_2": """
        SELECT a.p_partkey AS id, CASE WHEN a.p_partkey % 2 = 0 THEN concat('', b.p_partkey, ', ', a.p_partkey) ELSE concat('', b.p_partkey, '; see also; ', b.p_partkey) END AS value
        FROM part a JOIN part b ON a.p_name = b.p_name AND b.p_partkey = a.p_partkey + 64 * (1 + a.p_partkey % 3)
        UNION SELECT 1000000 + a.p_partkey AS id, concat(b.p_partkey, '; ', b.p_partkey + 1) AS value
        FROM part a JOIN part b ON a.p_brand = b.p_brand AND b.p_partkey > a.p_partkey AND b.p_partkey < a.p_partkey + 100""",
    "books_custom_column_2_link": """
        SELECT a.p_partkey AS id, a.p_partkey AS book, a.p_partkey AS value FROM part a JOIN part b ON a.p_name = b.p_name AND b.p_partkey = a.p_partkey + 64 * (1 + a.p_partkey % 3)
        UNION SELECT DISTINCT 1000000 + a.p_partkey AS id, a.p_partkey AS book, 1000000 + a.p_partkey AS value
        FROM part a JOIN part b ON a.p_brand = b.p_brand AND b.p_partkey > a.p_partkey AND b.p_partkey < a.p_partkey + 100""",
    "manifest": """
        SELECT concat('Shelf ', p_partkey % 50, '/', p_name, ' (', CASE WHEN p_partkey % 40 = 7 THEN p_partkey + 10000000 ELSE p_partkey END, ')') AS path, true AS is_dir FROM part WHERE p_partkey % 37 <> 0
        UNION SELECT concat('Shelf ', p_partkey % 50) AS path, true AS is_dir FROM part
        UNION SELECT concat('Shelf ', p_partkey % 50, '/', upper(p_name), ' (', p_partkey, ')') AS path, true AS is_dir FROM part WHERE p_partkey % 37 = 0
        UNION SELECT concat('Shelf ', p_partkey % 50, '/', p_name, ' (', CASE WHEN p_partkey % 40 = 7 THEN p_partkey + 10000000 ELSE p_partkey END, ')/file ', p_partkey, '.pdf') AS path, false AS is_dir FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 37 <> 0
        UNION SELECT concat('Shelf ', p_partkey % 50, '/', p_name, ' (', p_partkey, ')/file ', p_partkey, '.epub') AS path, false AS is_dir FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 37 <> 0 AND p_partkey % 40 <> 7""",
    "sources": """
        SELECT p_partkey AS id, p_name AS title, concat('Text of ', p_name, '. ', CASE p_partkey % 5 WHEN 0 THEN 'ISBN-10 0262035618 and ISBN-13 978-0-262-03561-3'
               WHEN 1 THEN 'isbn: 0-471-83006-2' WHEN 2 THEN 'ISBN 1234567890123' WHEN 3 THEN 'no number' ELSE 'ISBN 9781119744825; ISBN 9781119744825, call 0262035618' END) AS text,
               CASE WHEN p_partkey % 16 = 0 THEN 'timeout after 20s' WHEN p_partkey % 17 = 0 THEN 'broken' END AS error
        FROM part""",
}
#: Books of one brand whose ids are less than 100 apart, as Spark can join them by keys alone: an id's hundred is its
#: neighbour's or the one before it. Numbers come before names among a join's keys: Spark sorts by the first of them fastest,
#: and names have many ties.
_NEAR = """(SELECT p_partkey, p_brand, explode(array(p_partkey - pmod(p_partkey, 100), p_partkey - pmod(p_partkey, 100) + 100)) AS hundred FROM part) a
        {join} (SELECT p_partkey, p_brand, p_partkey - pmod(p_partkey, 100) AS hundred FROM part) b
        ON a.hundred = b.hundred AND a.p_brand = b.p_brand AND b.p_partkey > a.p_partkey AND b.p_partkey < a.p_partkey + 100"""
_NAMED = "part a {join} part b ON b.p_partkey = a.p_partkey + 64 * (1 + a.p_partkey % 3) AND a.p_name = b.p_name"
#: What Spark is told in other words, for the same rows; the statements stay as they are. Values and links are told apart by
#: the ids that they are made of, and made after that. Of a UNION's two sides no row is on both: a value is "x, y" or
#: "x; see also; x" on the one and "x; x + 1" on the other, a link's id is its book's on the one alone. The links of authors
#: are dealt out by book before they are told apart, which serves the sums by book after them too.
_RETOLD = {
    "custom_column_2": f"""
        SELECT k AS id, CASE WHEN k % 2 = 0 THEN concat('', other, ', ', k) ELSE concat('', other, '; see also; ', other) END AS value
        FROM (SELECT DISTINCT a.p_partkey AS k, b.p_partkey AS other FROM {_NAMED.format(join="JOIN")}) named
        UNION ALL SELECT 1000000 + k AS id, concat(other, '; ', other + 1) AS value
        FROM (SELECT DISTINCT a.p_partkey AS k, b.p_partkey AS other FROM {_NEAR.format(join="JOIN")}) near""",
    "books_custom_column_2_link": f"""
        SELECT k AS id, k AS book, k AS value FROM (SELECT DISTINCT a.p_partkey AS k FROM {_NAMED.format(join="LEFT SEMI JOIN")}) named
        UNION ALL SELECT 1000000 + k AS id, k AS book, 1000000 + k AS value FROM (SELECT DISTINCT a.p_partkey AS k FROM {_NEAR.format(join="LEFT SEMI JOIN")}) near""",
    "books_authors_link": "SELECT DISTINCT l_suppkey AS id, l_partkey AS book, l_suppkey AS author FROM (SELECT /*+ REPARTITION(l_partkey) */ l_partkey, l_suppkey FROM lineitem)",
}
#: What each catalogue table is made of.
BASE = ("part", "supplier", "lineitem")


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The catalogue's tables as DataFrames."""
    views = {t: f"folioframe_{t}_{abs(hash(sf_dir))}" for t in BASE}
    for t, name in views.items():
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(name)
    out = {}
    for name, text in (TABLES | _RETOLD).items():
        for t, view in views.items():
            for word in (f"FROM {t}", f"JOIN {t}"):
                text = text.replace(f"{word} ", f"{word[:5]}{view} ").replace(f"{word})", f"{word[:5]}{view})").replace(f"{word}\n", f"{word[:5]}{view}\n")
                text = text.removesuffix(word) + f"{word[:5]}{view}" if text.endswith(word) else text
        out[name] = spark.sql(text)
    return Catalog(out, "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_tables(sql: str, *names: str) -> str:
    """DuckDB SQL that starts from the same catalogue tables."""
    return "WITH " + ", ".join(f"{n} AS ({TABLES[n]})" for n in names) + ", " + sql
