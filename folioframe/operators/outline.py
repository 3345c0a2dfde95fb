"""Outlines: no blank titles, no jumps of level, pages within the document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import one_line


def sanitize(entries: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """doc_id, pos, level, title, page of entries (doc_id, pos, level, title, page); pages: doc_id, n_pages.

    The first kept entry has level 1 and each later one at most one more than the one before; as a window: with r the row's
    number and l its level, r + the least of l - r so far.
    """
    kept = entries.where("page is not null").withColumn("title", one_line(F.coalesce("title", F.lit("")))).where("title <> ''")
    order = Window.partitionBy("doc_id").orderBy("pos")
    kept = kept.withColumn("r", F.row_number().over(order))
    kept = kept.withColumn("l", F.when(F.col("r") == 1, F.lit(1)).otherwise(F.greatest(F.lit(1), F.coalesce("level", F.lit(1)))))
    level = F.col("r") + F.min(F.col("l") - F.col("r")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = kept.withColumn("level", level.cast("long"))
    if pages is None:
        return out.select("doc_id", "pos", "level", "title", F.greatest(F.lit(1), "page").cast("long").alias("page"))
    return out.join(pages, "doc_id").select("doc_id", "pos", "level", "title", F.greatest(F.lit(1), F.least("page", "n_pages")).cast("long").alias("page"))


def has_outline(entries: DataFrame) -> DataFrame:
    return entries.groupBy("doc_id").agg(F.max(one_line(F.coalesce("title", F.lit(""))) != "").alias("has_outline"))
