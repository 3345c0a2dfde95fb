"""Near duplicates: SimHash fingerprints linked by covering locality-sensitive hashing.

With radius r, each bit of the fingerprint gets a non-zero vector of r + 1 bits, and there is a table for each of the
2^(r+1) - 1 non-zero vectors v: its key keeps the bits whose vector has an odd product with v. Up to r differing bits
span at most r dimensions, so some v is orthogonal to all of them and the pair has the same key in v's table. No pair
within the radius is missed, whichever bits differ.

Only distinct fingerprints are linked, so any number of documents with one fingerprint costs one row. A fingerprint that
shares a key with another is then compared exactly without forming pairs, for a key's group may be large: it goes to
every value within r / 2 bits of it, and fingerprints that meet at a value are within r bits of each other, as are all
that are within r bits met at some value (for even r). At most 65 fingerprints can meet at one value for r = 2.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _scratch
from . import tokenizing as T
from .components import components
from ._workers import map_batches

BITS = 64


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """A mask for each table; their guarantee is in the module's docstring."""
    n = (1 << (radius + 1)) - 1
    vector = [1 + i % n for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() % 2) for v in range(1, n + 1)]


def fingerprint(text: str | None, words: int, hash64) -> int:
    """A bit is set if it is in over half the hashes of the text's shingles, repeats included; no words: 0."""
    found = (text or "").encode().lower().split()  # bytes: A-Z alone are lowered, and \\x20 \\x09-\\x0D alone separate
    if not found:
        return 0
    if len(found) < words:
        n, shingles = 1, [b" ".join(found)]
    else:
        n, shingles = len(found) - words + 1, map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    hashes = np.fromiter((hash64(s, 42) for s in shingles), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, also: str | None = None) -> DataFrame:
    """doc_id and fp (and the string column `also`), one row per input row; the shuffle-free part."""
    kept = [also] if also else []
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *kept)

    def made(batches):
        from xxhash import xxh64_intdigest

        for batch in batches:
            texts = batch.column(1).to_pylist()
            values = np.array([fingerprint(t, words, xxh64_intdigest) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", *kept])

    return map_batches(narrow, made, "doc_id long, fp long" + "".join(f", {x} string" for x in kept))


def link(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): edges that connect all distinct fingerprints (column fp) within `radius` bits, each edge within it."""
    if radius % 2:
        raise ValueError("the radius has to be even")
    masks = covering_masks(radius)
    keys = F.array(*(F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for v, m in enumerate(masks)))
    tables = distinct.select("fp", F.explode(keys).alias("t")).select("fp", "t.v", "t.key")
    shared = tables.groupBy("v", "key").agg(F.count("*").alias("n")).where("n > 1").select("v", "key")
    candidates = tables.join(shared, ["v", "key"], "left_semi").select("fp").distinct()
    flips = [0] + [sum(1 << i for i in c) for n in range(1, radius // 2 + 1) for c in combinations(range(BITS), n)]
    balls = candidates.select("fp", F.explode(F.array(*(F.lit(_signed(x)) for x in flips))).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    met = balls.select("fp", F.min("fp").over(Window.partitionBy("value")).alias("b"))
    return met.where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 lowercase hexadecimal digits), component_id (smallest doc_id reachable).

    Null and empty texts have fingerprint 0 and are linked like any other. Equal rows share a component. Null ids are
    linked but never name a component, unless it has no other id; then component_id is null. An empty table gives no
    rows; other columns are not read.
    """
    prints = _scratch.materialise(fingerprints(docs, id_col=id_col, text_col=text_col, words=words), "fingerprints")
    classes = _classes(prints, F.col("doc_id"), radius)
    return prints.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("least").alias("component_id"))


def _classes(prints: DataFrame, key: Column, radius: int) -> DataFrame:
    """(fp, least): the least key in the component of each fingerprint."""
    distinct = _scratch.materialise(prints.groupBy("fp").agg(F.min(key).alias("least")), "distinct")
    roots = components(link(distinct.select("fp"), radius), "a", "b")
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = _scratch.materialise(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("least"))
    return rooted.select("fp", "root").join(named, "root").select("fp", "least")


def drop_near(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = 2) -> DataFrame:
    """One row of docs, all columns, of each component: that of the smallest id, null last, then of the smallest text hash."""
    sha = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
    prints = fingerprints(docs.withColumn("__ff_sha", sha), id_col=id_col, text_col=text_col, words=words, also="__ff_sha")
    prints = _scratch.materialise(prints, "fingerprints")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__ff_sha")
    marked = prints.join(_classes(prints, key, radius), "fp").select(F.col("doc_id").alias("__ff_id"), "__ff_sha", (key != F.col("least")).alias("goes"))
    marked = _scratch.materialise(marked, "near")
    same = docs[id_col].cast("long").eqNullSafe(F.col("__ff_id")) & (sha == F.col("__ff_sha"))
    rest = docs.join(marked.where("goes").select("__ff_id", "__ff_sha").distinct(), same, "left_anti")
    repeated = marked.where("not goes").groupBy("__ff_id", "__ff_sha").count().where("count > 1").select("__ff_id", "__ff_sha")
    if not repeated.head(1):
        return rest
    one = rest.join(repeated, same, "left_semi").withColumn("__ff_sha", sha).dropDuplicates([id_col, "__ff_sha"]).drop("__ff_sha")
    return rest.join(repeated, same, "left_anti").unionByName(one)
