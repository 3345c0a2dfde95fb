"""Reports for people (capped Markdown) and for programs (whole JSON), under names that are never used twice."""

from __future__ import annotations

import datetime
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import short_authors
from ..operators.audit import Report
from ..operators.dedup import as_groups

#: How many rows of each list a reader is shown; the JSON has them all.
CAPS = {"fill": 80, "found": 120, "errors": 80, "poor": 120, "groups": 60}


def stamped(folder: str, stem: str) -> tuple[Path, Path]:
    """(JSON's path, Markdown's path); the folder is made."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    now = datetime.datetime.now().astimezone().strftime("%Y%m%d-%H%M%S")
    return Path(folder, f"{stem}-{now}.json"), Path(folder, f"{stem}-{now}.md")


def write_json(df: DataFrame, path: str) -> None:
    """Every row, one JSON object a line, written by the executors; an existing path is an error."""
    df.write.mode("errorifexists").json(path)


def _listed(df: DataFrame, cap: int, line, told: bool, none: str | None = None) -> list[str]:
    """At most `cap` lines; `told`: and how many were left out."""
    rows = [line(r) for r in df.limit(cap).collect()]
    if not rows and none:
        return [none]
    if told and len(rows) == cap and (more := df.count() - cap) > 0:
        rows.append(f"- ... {more} more")
    return rows


def _record(r) -> str:
    return f"- `{r['id']}` {r['title'] or ''} — {r['authors'] or ''}"


def audit_summary(report: Report) -> dict:
    """The summary row and both counts, as one dictionary."""
    out = report.summary.first().asDict()
    out["issue_counts"] = {r.issue: r.n for r in report.issue_counts.collect()}
    out["format_counts"] = {r.ext: r.n for r in report.format_counts.collect()}
    return out


def audit_markdown(report: Report, title: str = "Metadata audit") -> str:
    """Lists are queues to work through: capped, and the fill, poor and group lists say how many are left out."""
    s = audit_summary(report)
    issues = lambda r: ", ".join(r["issues"])
    poor = report.records.where(F.arrays_overlap("issues", F.array(F.lit("bad-author"), F.lit("junk-title")))).orderBy("id")
    out = [f"# {title}", "", f"Generated: {datetime.datetime.now().astimezone().isoformat(timespec='seconds')}", "", "## Summary", ""]
    out += [f"- {k.replace('_', ' ')}: {v}" for k, v in s.items() if not isinstance(v, dict)]
    for name, key in (("Issue counts", "issue_counts"), ("Format counts", "format_counts")):
        out += ["", f"## {name}", "", *(f"- `{k}`: {v}" for k, v in s[key].items())]
    out += ["", "## Numbers that can fill a record", "", *_listed(report.safe_isbn_lookup.orderBy("id"), CAPS["fill"], lambda r: f"{_record(r)} — ISBN `{r['isbn']}`; issues: {issues(r)}", True)]
    found = report.scans.where(F.size("isbns") > 0).orderBy("id")
    out += ["", "## Numbers found in files", "", *_listed(found, CAPS["found"], lambda r: f"- `{r['id']}` {r['title']} — found {', '.join(r['isbns'])}", False, "- None in this scan.")]
    out += ["", "## Scan errors", "", *_listed(report.scans.where("error is not null").orderBy("id"), CAPS["errors"], lambda r: f"- `{r['id']}` {r['title']} — {r['error']}", False, "- None.")]
    out += ["", "## Poor titles and authors", "", *_listed(poor, CAPS["poor"], lambda r: f"{_record(r)} — issues: {issues(r)}", True)]
    groups = as_groups(report.duplicate_groups.withColumnRenamed("authors_str", "authors"), "title", "authors")
    out += ["", "## Duplicate titles", *_listed(groups, CAPS["groups"], lambda g: "\n" + "\n".join(_record(r) for r in g.members), True)]
    return "\n".join(out) + "\n"


def write_audit(report: Report, folder: str, stem: str = "metadata-audit") -> dict:
    """Both files; the summary with their paths. The JSON is the driver's: for a catalogue larger than it can hold, write_json() the parts."""
    as_json, as_text = stamped(folder, stem)
    lists = {"records": report.records, "safe_existing_isbn_lookup": report.safe_isbn_lookup, "pdf_isbn_extraction_candidates": report.extract_candidates, "isbn_scan": report.scans}
    body = {"summary": audit_summary(report)} | {k: [json.loads(r.j) for r in d.orderBy("id").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator()] for k, d in lists.items()}
    body["duplicate_title_groups"] = [[m.asDict() for m in g.members] for g in as_groups(report.duplicate_groups.withColumnRenamed("authors_str", "authors"), "title", "authors").toLocalIterator()]
    with open(as_json, "x", encoding="utf-8") as f:
        json.dump(body, f, indent=2, ensure_ascii=False)
    with open(as_text, "x", encoding="utf-8") as f:
        f.write(audit_markdown(report))
    return {"json": str(as_json), "markdown": str(as_text), **body["summary"]}


def candidates_markdown(matched: DataFrame, title: str = "Metadata candidates") -> str:
    """A table that shows both titles side by side; bars are escaped, line ends are spaces."""
    e = "edition"
    fields = {f.name for f in matched.schema[e].dataType.fields}
    text = lambda name: F.col(f"{e}.{name}") if name in fields else F.lit(None).cast("string")
    publishers = F.array_join(F.slice(F.col(f"{e}.publishers"), 1, 2), ", ") if "publishers" in fields else F.lit(None).cast("string")
    cells = [F.col("id").cast("string"), F.col("status"), F.col("source"), F.col("isbn"), F.col("title"), F.coalesce(F.nullif(text("full_title"), F.lit("")), text("title")), short_authors(F.coalesce(F.col(f"{e}.authors"), F.array().cast("array<string>"))), publishers, text("publish_date")]
    cells = [F.translate(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), "\n", " ") for c in cells]
    rows = matched.orderBy("status", "id").select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    counts = {r["status"]: r["n"] for r in matched.groupBy("status").agg(F.count("*").alias("n")).collect()}
    out = [f"# {title}", "", "## Summary", "", f"- Input candidates: {sum(counts.values())}", *(f"- {k}: {v}" for k, v in sorted(counts.items())), "", "## Candidates", ""]
    out += ["| ID | Status | Source | ISBN | Current title | Edition title | Edition authors | Publisher | Date |", "|---:|---|---|---|---|---|---|---|---|", *(r.line for r in rows.toLocalIterator())]
    return "\n".join(out) + "\n"
