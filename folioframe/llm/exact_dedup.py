"""Exact duplicates by deterministic block naming, in DataFrame functions only.

A text's UTF-8 bytes are cut into blocks of a fixed size. The distinct blocks of the corpus are counted, those that occur
again are sorted, and their place in that order is their integer name. A document with a block found nowhere else is
alone and leaves; the others become short sequences of names. Adjacent names are paired, the distinct pairs that occur
again are sorted and named in turn, and so on until each document has one name. With its number of blocks that name is
the document's identity; it is made by comparing whole blocks and pairs, so two texts share it only if they are equal.

To carry a block's name back to its documents without moving the text twice, occurrences are matched to the sorted
blocks by a 128-bit key. Every distinct block's key is checked against the whole blocks; should two blocks ever share
one, the keys are made anew with another salt. Equal blocks are summed before the shuffle, so a text with any number of
copies is moved once a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _scratch

BLOCK = 4096


def _blocks(raw: str, block: int) -> Column:
    """At least one block, the last one shorter."""
    return F.expr(f"transform(sequence(0, cast(greatest(0, (octet_length({raw}) - 1) div {block}) as int)), i -> substring({raw}, i * {block} + 1, {block}))")


def _key(x: Column, salt: int) -> list[Column]:
    return [F.xxhash64(F.lit(2 * salt), x).alias("h1"), F.xxhash64(F.lit(2 * salt + 1), x).alias("h2")]


def _sorted_names(distinct: DataFrame, by: list[str], deal: list[Column]) -> DataFrame:
    """A unique integer for each row, rising in the order of `by` within ranges of `deal`; fixed by being written.

    The ranges come from a sample that the driver sees, so `deal` has to be a few bytes a row.
    """
    return _scratch.materialise(distinct.repartitionByRange(*deal).sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id()), "names")


def _named(sequences: DataFrame, keys: list[str], names: DataFrame) -> DataFrame:
    """sequences (rid, k, pos, keys): each row's names in order, for those rows all of whose parts have one."""
    parts = sequences.join(names.select(*keys, "name"), keys)
    out = parts.groupBy("rid", "doc_id", "k").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("named"), F.max("parts").alias("parts"))
    return out.where(F.size("named") == F.col("parts")).select("rid", "doc_id", "k", F.transform("named", lambda x: x["name"]).alias("names"))


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null counts as the empty text. Of equal texts the row with the largest doc_id stays; of rows that share that id too,
    one of them (null ids come last; a group of null ids alone has a null keep_id). Documents of any length are cut by
    byte offsets. An empty table gives no rows; other columns are not read.
    """
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("raw")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), raw)
    salt = 0
    while True:
        # Whole blocks, each counted over all documents; those that occur again keep their bytes for the sort.
        whole = source.select(F.explode(_blocks("raw", block)).alias("block")).select(*_key(F.col("block"), salt), "block")
        counted = whole.groupBy("h1", "h2", "block").agg(F.count("*").alias("n"))
        counted = _scratch.materialise(counted.select("h1", "h2", (F.col("n") > 1).alias("again"), F.when(F.col("n") > 1, F.col("block")).alias("block")), "blocks")
        if not counted.groupBy("h1", "h2").count().where("count > 1").head(1):
            break
        salt += 1
    names = _sorted_names(counted.where("again").select("h1", "h2", "block"), ["block"], [F.substring("block", 1, 8), F.col("h1")]).drop("block")
    keyed = F.transform(_blocks("raw", block), lambda x: F.struct(*_key(x, salt)))
    rows = source.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.sha2("raw", 256).alias("text_sha256"), keyed.alias("blocks"))
    rows = _scratch.materialise(rows, "documents")
    parts = rows.select("rid", "doc_id", F.size("blocks").alias("k"), F.size("blocks").alias("parts"), F.posexplode("blocks").alias("pos", "b")).select("rid", "doc_id", "k", "parts", "pos", "b.h1", "b.h2")
    level = _scratch.materialise(_named(parts, ["h1", "h2"], names), "level")
    done = []
    while True:
        done.append(level.where(F.size("names") == 1).select("rid", "doc_id", "k", F.col("names")[0].alias("name")))
        level = level.where(F.size("names") > 1)
        if not level.head(1):
            break
        # An odd last name is paired with -1, which names nothing.
        pairs = F.expr("transform(sequence(0, (size(names) - 1) div 2), i -> struct(names[cast(2 * i as int)] as l, coalesce(get(names, cast(2 * i + 1 as int)), -1L) as r))")
        parts = level.select("rid", "doc_id", "k", pairs.alias("pairs")).select("rid", "doc_id", "k", F.size("pairs").alias("parts"), F.posexplode("pairs").alias("pos", "p")).select("rid", "doc_id", "k", "parts", "pos", "p.l", "p.r")
        again = parts.groupBy("l", "r").agg(F.count("*").alias("n")).where("n > 1").select("l", "r")
        level = _scratch.materialise(_named(parts, ["l", "r"], _sorted_names(again, ["l", "r"], [F.col("l"), F.col("r")])), "level")
    identity = done[0]
    for x in done[1:]:
        identity = identity.unionByName(x)
    # Written, so that the join below reads two plain shuffles and a group of very many copies can be split.
    groups = identity.groupBy("k", "name").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "rid")).alias("best")).where("n > 1")
    groups = _scratch.materialise(groups, "groups")
    member = identity.select("rid", "k", "name").join(groups, ["k", "name"]).select("rid", "n", F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("keep_rid"))
    return rows.select("rid", "doc_id", "text_sha256").join(member, "rid", "left").select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.coalesce("keep_rid", "rid") == F.col("rid")).alias("kept"),
        "text_sha256",
    )


def drop_exact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of docs, all columns, that stay; of rows that repeat an id and its text, one."""
    groups = _scratch.materialise(exact_groups(docs, id_col=id_col, text_col=text_col, block=block), "exact")
    gone = groups.where("not kept").select(F.col("doc_id").alias("__ff_id"), F.col("text_sha256").alias("__ff_sha"))
    both = groups.where("kept").select(F.col("doc_id").alias("__ff_id"), F.col("text_sha256").alias("__ff_sha"))
    repeated = gone.join(both.withColumnRenamed("__ff_id", "i").withColumnRenamed("__ff_sha", "s"), F.col("__ff_id").eqNullSafe(F.col("i")) & (F.col("__ff_sha") == F.col("s")), "left_semi").distinct()
    sha = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
    same_id, same_text = docs[id_col].cast("long").eqNullSafe(F.col("__ff_id")), sha == F.col("__ff_sha")
    if not repeated.head(1):
        return docs.join(gone, same_id & same_text, "left_anti")
    # Some rows that go have a twin that stays: of each such set one row, of the rest those that stay.
    simply = gone.join(repeated.withColumnRenamed("__ff_id", "i").withColumnRenamed("__ff_sha", "s"), F.col("__ff_id").eqNullSafe(F.col("i")) & (F.col("__ff_sha") == F.col("s")), "left_anti")
    rest = docs.join(simply, same_id & same_text, "left_anti")
    one = rest.join(repeated, same_id & same_text, "left_semi").withColumn("__ff_sha", sha).dropDuplicates([id_col, "__ff_sha"]).drop("__ff_sha")
    return rest.join(repeated, same_id & same_text, "left_anti").unionByName(one)
