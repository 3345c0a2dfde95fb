"""Every catalogue query against its SQL in DuckDB, at the smallest size; the searches against plain Python."""

import time

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from folioframe.functions.similarity import score_text
from folioframe.operators import catalog
from folioframe.plans import adapter, oracles, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _rows(frame):
    def plain(v):
        if v is None or v is pd.NA or v != v:
            return None
        return int(v) if isinstance(v, float) and v == int(v) else v

    return sorted(str(tuple(map(plain, r))) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(oracles.oracles()))
def test_query(spark, sf_dir, duck, name):
    got, expect = queries.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(oracles.oracles()[name]).df()
    assert sorted(got.columns) == sorted(expect.columns)
    assert _rows(got) == _rows(expect)


@pytest.mark.parametrize(("name", "query", "field", "margin", "limit"), [("search_title", "smal wigdet", "title", 0.15, 10), ("search_authors", "gartner ruiz", "authors", 0.15, 20), ("search_both", "strasse elan ring", "both", 0.15, 15), ("search_margin_off", "blue ring", "both", 1.0, 50)])
def test_searches(spark, sf_dir, name, query, field, margin, limit):
    from folioframe.functions.text import search_key

    books = catalog.books(adapter.catalog(spark, sf_dir))
    rows = books.select("id", search_key(books["title"]).alias("t"), search_key(books["authors_str"]).alias("a")).collect()
    best = {"title": lambda r: score_text(query, r.t), "authors": lambda r: score_text(query, r.a), "both": lambda r: max(score_text(query, x) for x in (r.t, r.a, f"{r.t} {r.a}"))}[field]
    found = sorted((-round(s, 3), r.id) for r in rows if (s := best(r)) >= 0.55)
    expect = [(-s, i) for s, i in found if -s >= -found[0][0] - margin][:limit] if found else []
    assert [(r.score, r.id) for r in queries.QUERIES[name](spark, sf_dir).collect()] == expect


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_llm():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "folioframe"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_author_links_are_dealt_out_once(spark, sf_dir, monkeypatch):
    made = catalog.authors(adapter.catalog(spark, sf_dir))
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    few = {r.book: r.authors for r in made.collect()}
    monkeypatch.setattr(catalog, "SENT", 3)  # more names than are sent
    assert few == {r.book: r.authors for r in catalog.authors(adapter.catalog(spark, sf_dir)).collect()}


def test_files_are_summed_once(spark, sf_dir, monkeypatch):
    written, plans = queries.shared.written, []
    monkeypatch.setattr(queries.shared, "written", lambda df, name: plans.append(_plan(df)) or written(df, name))
    queries.QUERIES["writeplan_gate"](spark, sf_dir)
    assert sum("Aggregate" in line and "l_linestatus" in line for p in plans for line in p.splitlines()) == 1


def test_summary_makes_records_once(spark, sf_dir):
    assert "l_suppkey" not in _plan(queries.QUERIES["audit_report_summary"](spark, sf_dir))


def test_written_tables_leave_no_shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles

    def shuffled():
        found = files()
        return {n for n in (found.apply(i).getName() for i in range(found.size())) if n.startswith("shuffle_")}

    before = shuffled()
    kept = queries.shared.written(spark.range(20_000).repartition(7, "id"), "numbers")
    for _ in range(50):
        if not (left := shuffled() - before):
            break
        time.sleep(0.2)
    assert not left and kept.count() == 20_000


def test_matches_by_title_are_made_before_the_signals(spark, sf_dir):
    staged, *against = queries._staged(spark, sf_dir)
    assert "Join" not in _plan(queries.dedup._titled(*against, True))
