"""Command line: books, resolve, audit, metadata-candidates. Exit codes: 0 done, 1 wrong schema, 2 no catalogue."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import audit, catalog, dedup, integrity, match
from .sources import catalog_tables, reports, sqlite_ro


def _open(spark: SparkSession, place: str) -> catalog_tables.Catalog:
    """A SQLite file, or a folder of Parquet tables."""
    if os.path.isfile(place):
        found = sqlite_ro.open_catalog(spark, place)
    else:
        found = catalog_tables.from_parquet(spark, place)
    return found.checked()


def _print(df: DataFrame, as_json: bool) -> None:
    rows = [r.asDict(recursive=True) for r in df.toLocalIterator()]
    if as_json:
        print(json.dumps(rows, ensure_ascii=False))
    else:
        for r in rows:
            print("\t".join("" if v is None else ", ".join(v) if isinstance(v, list) else str(v) for v in r.values()))


#: What is read of the JSON that `audit` writes.
REPORT = "safe_existing_isbn_lookup array<struct<id: bigint, title: string, authors: string, isbn: string, issues: array<string>>>, isbn_scan array<struct<id: bigint, title: string, authors: string, isbns: array<string>>>"


def _table(spark: SparkSession, place: str) -> DataFrame:
    return spark.read.json(place) if place.endswith(".json") else spark.read.parquet(place)


def _parser() -> argparse.ArgumentParser:
    """--library and --json may stand before or after the command, so neither has a default that could undo the other's."""
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--library", default=argparse.SUPPRESS, help="a SQLite file or a folder of Parquet tables")
    common.add_argument("--json", action="store_true", default=argparse.SUPPRESS)
    parser = argparse.ArgumentParser(prog="folioframe", description=__doc__, parents=[common])
    sub = parser.add_subparsers(dest="command", required=True)
    p = {name: sub.add_parser(name, parents=[common]) for name in ("books", "resolve", "audit", "metadata-candidates")}
    p["resolve"].add_argument("--root", required=True)
    p["resolve"].add_argument("paths", nargs="+")
    for name in ("audit", "metadata-candidates"):
        p[name].add_argument("--out-dir", default="reports")
    p["audit"].add_argument("--scan-missing-isbns", action="store_true", help="look for numbers in the page texts of files whose record has none")
    p["audit"].add_argument("--pages", help="a Parquet or JSON table of page texts: path, page, n_pages, text, error")
    p["audit"].add_argument("--pages-each-end", type=int, default=8)
    p["audit"].add_argument("--limit-scan", type=int, default=0, help="scan the first N files; 0: all")
    p["audit"].add_argument("--scan-timeout", type=int, default=20, help="the seconds that whoever made the page texts gave a file")
    p["audit"].add_argument("--scan-workers", type=int, default=4)
    p["metadata-candidates"].add_argument("audit_json")
    p["metadata-candidates"].add_argument("--editions", required=True, help="a Parquet or JSON table of editions")
    p["metadata-candidates"].add_argument("--include-multi", action="store_true")
    p["metadata-candidates"].add_argument("--limit", type=int, default=0)
    return parser


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = _parser()
    args = parser.parse_args(argv)
    as_json = getattr(args, "json", False)
    if args.command != "metadata-candidates" and not hasattr(args, "library"):
        parser.error("--library is required")
    if args.command == "audit" and args.scan_missing_isbns and not args.pages:
        parser.error("--scan-missing-isbns needs --pages")
    spark = spark or SparkSession.builder.appName("folioframe").getOrCreate()
    try:
        if args.command == "books":
            _print(catalog.listing(catalog.books(_open(spark, args.library))), as_json)
        elif args.command == "resolve":
            rows = spark.createDataFrame(list(enumerate(args.paths)), "pos int, path string")
            _print(integrity.resolve(rows, _open(spark, args.library)["books"], args.root), as_json)
        elif args.command == "audit":
            c = _open(spark, args.library)
            records = catalog.books(c)
            scans = audit.scan_texts(audit.scan_targets(records, args.limit_scan), _table(spark, args.pages), args.pages_each_end) if args.scan_missing_isbns else None
            report = audit.audit(records, dedup.title_groups(records, dedup.exempt_edges(c)), scans, args.scan_timeout, args.limit_scan, args.scan_workers)
            done = reports.write_audit(report, args.out_dir)
            print(json.dumps(done, ensure_ascii=False, indent=None if as_json else 2))
        else:
            report = spark.read.schema(REPORT).option("multiLine", True).option("mode", "FAILFAST").json(args.audit_json)
            own, scans = (report.select(F.inline(x)) for x in ("safe_existing_isbn_lookup", "isbn_scan"))
            rows = match.first_candidates(match.candidates(own, scans, args.include_multi), args.limit)
            matched = match.match(rows, _table(spark, args.editions))
            as_file, as_text = reports.stamped(args.out_dir, "edition-candidates")
            counts = {r["status"]: r["n"] for r in match.status_counts(matched).collect()}
            body = {"summary": {"input_candidates": sum(counts.values()), **counts}, "candidates": [r.asDict(recursive=True) for r in matched.toLocalIterator()]}
            as_file.write_text(json.dumps(body, indent=2, ensure_ascii=False), encoding="utf-8")
            as_text.write_text(reports.candidates_markdown(matched), encoding="utf-8")
            print(json.dumps({"json": str(as_file), "markdown": str(as_text), **body["summary"]}, ensure_ascii=False))
    except catalog_tables.MissingCatalog as e:
        print(f"no catalogue: {e}", file=sys.stderr)
        return 2
    except catalog_tables.WrongSchema as e:
        print(f"wrong schema: {e}", file=sys.stderr)
        return 1
    except BrokenPipeError:
        return 0
    return 0


if __name__ == "__main__":
    sys.exit(main())
