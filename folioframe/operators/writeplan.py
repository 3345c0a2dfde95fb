"""Proposed changes against a chain of gates; nothing is changed here. The first gate that fails gives the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_entity, strip


def parse_identifiers(text: Column) -> Column:
    """'type:value,…' as a map; parts without a colon are skipped, the last of a type counts."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), strip), lambda p: F.contains(p, F.lit(":")))
    pairs = F.transform(parts, lambda p: F.struct(strip(F.substring_index(p, ":", 1)).alias("key"), strip(F.substring(p, F.instr(p, ":") + 1, F.length(p))).alias("value")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def join_identifiers(m: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")


def merge_identifiers(current: Column, text: Column) -> Column:
    """The record's identifiers with the given ones over them."""
    new = parse_identifiers(text)
    old = F.map_filter(current, lambda k, v: ~F.map_contains_key(new, k))
    return join_identifiers(F.map_concat(old, new))


def remove_identifier(current: Column, kind: Column) -> Column:
    return join_identifiers(F.map_filter(current, lambda k, v: k != kind))


def _first(gates: list[tuple[Column, str]]) -> Column:
    out = F.lit(None).cast("string")
    for fails, reason in reversed(gates):
        out = F.when(fails, F.lit(reason)).otherwise(out)
    return out


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def _suffix(c: str) -> Column:
    return F.regexp_extract(F.coalesce(F.col(c), F.lit("")), r"[^/.][^/]*\.([^./]+)$", 1)


def _told(df: DataFrame, gates: list[tuple[Column, str]], *columns) -> DataFrame:
    return df.withColumn("reason", _first(gates)).select("proposal_id", F.col("reason").isNull().alias("allowed"), "reason", *columns)


def plan_add(proposals: DataFrame, verdicts: DataFrame) -> DataFrame:
    """proposals: proposal_id, path, file_exists, title, authors, tags, gui_open, force; verdicts: proposal_id, verdict."""
    df = proposals.join(verdicts.hint("merge"), "proposal_id", "left")
    gates = [
        (~F.col("file_exists"), "file-missing"),
        (_suffix("path") == "", "no-extension"),
        (_blank("title") | _blank("authors"), "title-and-authors-required"),
        (has_entity(F.col("title")) | has_entity(F.col("authors")) | has_entity(F.col("tags")), "html-entity"),
        (F.col("gui_open"), "gui-open"),
        ((F.col("verdict") == "block") & ~F.col("force"), "duplicate"),
    ]
    return _told(df, gates, "verdict")


def plan_format(proposals: DataFrame, books: DataFrame, data: DataFrame) -> DataFrame:
    """proposals: proposal_id, path, file_exists, book_id, gui_open, force."""
    have = data.select(F.col("book").alias("book_id"), F.upper("format").alias("ext")).distinct().withColumn("present", F.lit(True))
    known = books.select(F.col("id").alias("book_id")).distinct().withColumn("known", F.lit(True))
    df = proposals.withColumn("ext", F.upper(_suffix("path"))).join(known, "book_id", "left").join(have, ["book_id", "ext"], "left")
    gates = [
        (~F.col("file_exists"), "file-missing"),
        (F.col("ext") == "", "no-extension"),
        (F.col("known").isNull(), "unknown-book"),
        (F.col("present").isNotNull() & ~F.col("force"), "format-present"),
        (F.col("gui_open"), "gui-open"),
    ]
    return _told(df, gates, "ext")


def plan_metadata(proposals: DataFrame, identifiers: DataFrame) -> DataFrame:
    """proposals: proposal_id, book_id, fields map<string,string>, gui_open, force; identifiers: book, identifiers map."""
    df = proposals.join(identifiers.select(F.col("book").alias("book_id"), "identifiers"), "book_id", "left")
    keys = F.transform(F.map_keys("fields"), F.lower)
    gates = [
        (F.col("gui_open"), "gui-open"),
        (F.exists(F.map_values("fields"), has_entity), "html-entity"),
        (F.array_contains(keys, "authors"), "authors-never"),
        (F.array_contains(keys, "title") & ~F.col("force"), "title-needs-force"),
    ]
    given = F.transform(F.filter(F.map_entries("fields"), lambda e: F.lower(e["key"]) == "identifiers"), lambda e: e["value"])
    current = F.coalesce("identifiers", F.create_map().cast("map<string,string>"))
    merged = F.when(F.size(given) > 0, merge_identifiers(current, F.try_element_at(given, F.lit(1))))
    return _told(df, gates, merged.alias("identifiers"))


def plan_removal(proposals: DataFrame, identifiers: DataFrame) -> DataFrame:
    """proposals: proposal_id, book_id, id_type, gui_open; identifiers: book, identifiers map."""
    df = proposals.join(identifiers.select(F.col("book").alias("book_id"), "identifiers"), "book_id", "left")
    current = F.coalesce("identifiers", F.create_map().cast("map<string,string>"))
    gates = [(F.col("gui_open"), "gui-open"), (~F.map_contains_key(current, F.col("id_type")), "identifier-absent")]
    return _told(df, gates, remove_identifier(current, F.col("id_type")).alias("identifiers"))
