"""Catalogue against files: both anti-joins, names that differ by case alone, and paths to records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import folder_id

# Suffixes of book files, and folders that are no part of the catalogue.
SUFFIXES = ("pdf", "epub", "mobi", "azw3", "djvu", "cbz", "cbr", "txt")
#: At most so many roots are sent to every task; more are joined by a shuffle.
SENT = 1 << 16


def orphan_dirs(manifest: DataFrame, books: DataFrame, excluded: tuple[str, ...] = (), suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """id, path, files of folders two deep whose '(id)' has no record; folders without that suffix are left alone."""
    parts = F.split("path", "/")
    dirs = manifest.where(F.col("is_dir") & (F.size(parts) == 2)).select("path", folder_id(F.col("path")).alias("id")).where("id is not null")
    if excluded:
        dirs = dirs.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, excluded))))
    gone = dirs.join(books.select("id"), "id", "left_anti")
    files = manifest.where(~F.col("is_dir") & (F.size(parts) == 3)).select(F.concat_ws("/", F.slice(parts, 1, 2)).alias("path"), parts[2].alias("file"))
    files = files.where(F.lower(F.regexp_extract("file", r"[^.]\.([^.]+)$", 1)).isin(*suffixes)).groupBy("path").agg(F.array_sort(F.collect_list("file")).alias("files"))
    return gone.join(files, "path", "left").select("id", "path", F.coalesce("files", F.array().cast("array<string>")).alias("files")).orderBy("path")


def missing_formats(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """id, title, missing: format rows whose file is not there (formats are relative to the manifest's root)."""
    wanted = records.select("id", "title", F.explode("formats").alias("missing"))
    return wanted.join(manifest.where(~F.col("is_dir")).select(F.col("path").alias("missing")), "missing", "left_anti").select("id", "title", "missing")


def case_drift(books: DataFrame, manifest: DataFrame) -> DataFrame:
    """id, title, expected, on_disk, parent: the first component of a record's path that is there in another case only."""
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    steps = books.select("id", "title", parts.alias("parts")).select("id", "title", "parts", F.posexplode("parts").alias("depth", "expected"))
    steps = steps.select("id", "title", "depth", "expected", F.when(F.col("depth") > 0, F.concat_ws("/", F.expr("slice(parts, 1, depth)"))).otherwise(F.lit("")).alias("parent"))
    at = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    there = manifest.select(at.alias("parent"), F.element_at(F.split("path", "/"), -1).alias("name"))
    exact = steps.join(there.select("parent", F.col("name").alias("expected")).distinct().withColumn("exact", F.lit(True)), ["parent", "expected"], "left")
    first = exact.where("exact is null").withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("depth"))).where("n = 1").drop("n", "exact")
    lower = there.groupBy("parent", F.lower("name").alias("k")).agg(F.min("name").alias("on_disk"))
    return first.withColumn("k", F.lower("expected")).join(lower, ["parent", "k"]).select("id", "title", "expected", "on_disk", F.when(F.col("parent") == "", F.lit(".")).otherwise(F.col("parent")).alias("parent"))


def resolve(paths: DataFrame, books: DataFrame, root: str) -> DataFrame:
    """pos, path, id, title in the order given: the record of the folder that holds a path below root; null without one."""
    folder = F.element_at(F.split("path", "/"), -2)
    inside = F.col("path").startswith(root.rstrip("/") + "/") & (F.size(F.split("path", "/")) > 1)
    keyed = paths.select("pos", "path", F.when(inside, folder_id(folder)).alias("__id"))
    return keyed.join(books.select(F.col("id").alias("__id"), "id", "title"), "__id", "left").select("pos", "path", "id", "title").orderBy("pos")


def nearest_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """path, root: the deepest of the given roots (column root) that is an ancestor of the path.

    Few roots go to the paths; paths are never broadcast, whatever size is guessed for them.
    """
    known = roots.select("root").distinct()
    few = known.limit(SENT + 1).count() <= SENT
    parts = F.split("path", "/")
    up = paths.select("path", parts.alias("p")).select("path", F.explode(F.expr("transform(sequence(1, size(p)), i -> concat_ws('/', slice(p, 1, i)))")).alias("root"))
    found = up.join(known.hint("broadcast" if few else "merge"), "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return paths.join(found.hint("merge"), "path", "left")


def resolve_discovered(paths: DataFrame, books: DataFrame) -> DataFrame:
    """pos, path, root, id, title: as resolve(), but in the catalogue whose root is the path's deepest ancestor; books: root, id, title.

    So any tree with a catalogue above the file counts, and nothing is outside of the library.
    """
    found = nearest_root(paths, books)
    keyed = found.select("pos", "path", "root", F.when(F.size(F.split("path", "/")) > 1, folder_id(F.element_at(F.split("path", "/"), -2))).alias("__id"))
    own = books.select(F.col("root").alias("__root"), F.col("id").alias("__of"), "id", "title")
    out = keyed.join(own, (F.col("root") == F.col("__root")) & (F.col("__id") == F.col("__of")), "left")
    return out.select("pos", "path", F.when(F.col("__id").isNotNull(), F.col("root")).alias("root"), "id", "title").orderBy("pos")
