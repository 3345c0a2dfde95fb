"""The command line and the reports, over a Parquet catalogue."""

import json

import pytest

from folioframe import cli
from folioframe.operators import match
from folioframe.sources import catalog_tables, reports


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("parquet")
    rows = {
        "books": [(1, "Zebra", None, None, "2001", "A/Zebra (1)", "u1", None), (2, "apple", None, None, None, "B/apple (2)", None, None), (3, "Apple!", None, None, "2003", "B/Apple! (3)", None, None)],
        "authors": [(1, "Ann Lee")], "books_authors_link": [(1, 2, 1), (2, 3, 1)], "tags": [], "books_tags_link": [], "publishers": [], "books_publishers_link": [],
        "data": [(1, 1, "PDF", 5, "z")], "identifiers": [(1, 1, "isbn", "9781119744825")],
    }
    for name, schema in catalog_tables.SCHEMAS.items():
        spark.createDataFrame(rows[name], schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_commands(spark, library, tmp_path, capsys):
    assert cli.main(["books", "--library", library, "--json"], spark) == 0
    assert [r["id"] for r in json.loads(capsys.readouterr().out)] == [2, 3, 1]
    assert cli.main(["resolve", "--library", library, "--root", "/l", "--json", "/l/A/Zebra (1)/z.pdf", "/no"], spark) == 0
    assert [r["id"] for r in json.loads(capsys.readouterr().out)] == [1, None]
    assert cli.main(["audit", "--library", library, "--out-dir", str(tmp_path), "--json"], spark) == 0
    done = json.loads(capsys.readouterr().out)
    assert done["books"] == 3 and done["duplicate_title_groups"] == 1 and done["issue_counts"]["missing-publisher"] == 3
    body = json.load(open(done["json"]))
    assert [r["id"] for r in body["safe_existing_isbn_lookup"]] == [1] and [m["id"] for m in body["duplicate_title_groups"][0]] == [2, 3]
    assert "## Duplicate titles" in open(done["markdown"]).read()
    spark.createDataFrame([("9781119744825", "Zebra", None, None, ["X | Y"], None)], match.EDITION).write.parquet(str(tmp_path / "editions"))
    assert cli.main(["metadata-candidates", done["json"], "--editions", str(tmp_path / "editions"), "--out-dir", str(tmp_path)], spark) == 0
    done = json.loads(capsys.readouterr().out)
    assert done["input_candidates"] == 1 and done["strong-candidate"] == 1
    assert r"X \| Y" in open(done["markdown"]).read()


def test_exit_codes(spark, library, tmp_path, capsys):
    assert cli.main(["books", "--library", str(tmp_path / "none")], spark) == 2
    spark.createDataFrame([(1,)], "id long").write.parquet(str(tmp_path / "half/books.parquet"))
    assert cli.main(["books", "--library", str(tmp_path / "half")], spark) == 1


def test_caps_tell_what_is_left_out(spark):
    rows = spark.range(10).selectExpr("id")
    assert reports._listed(rows, 4, lambda r: str(r.id), True)[-1] == "- ... 6 more"
    assert len(reports._listed(rows, 4, lambda r: str(r.id), False)) == 4
    assert reports._listed(rows.where("false"), 4, str, True, "- None.") == ["- None."]


def test_scan_options_and_places_of_common_ones(spark, library, tmp_path, capsys):
    pages = [("A/Zebra (1)/z.pdf", 0, 1, "ISBN 0471830062", None)]
    spark.createDataFrame(pages, "path string, page int, n_pages int, text string, error string").write.parquet(str(tmp_path / "pages"))
    assert cli.main(["--json", "--library", library, "books"], spark) == 0
    assert len(json.loads(capsys.readouterr().out)) == 3
    how = ["audit", "--library", library, "--out-dir", str(tmp_path), "--json"]
    assert cli.main(how, spark) == 0
    done = json.loads(capsys.readouterr().out)
    assert (done["scan_timeout_seconds"], done["scan_limit"], done["scan_workers"], done["scanned_pdf_candidates"]) == (0, 0, 0, 0)
    assert cli.main([*how, "--scan-missing-isbns", "--pages", str(tmp_path / "pages"), "--pages-each-end", "1", "--limit-scan", "5", "--scan-timeout", "7"], spark) == 0
    done = json.loads(capsys.readouterr().out)
    assert (done["scan_timeout_seconds"], done["scan_limit"], done["scan_workers"], done["scanned_pdf_candidates"]) == (7, 5, 4, 0)
    with pytest.raises(SystemExit):
        cli.main([*how, "--scan-missing-isbns"], spark)
    with pytest.raises(SystemExit):
        cli.main(["books"], spark)
