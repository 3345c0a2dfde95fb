"""Fuzzy search: score, an absolute floor, a margin below the best, and the top k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.similarity import round3, score
from ..functions.text import fold_text, search_key

THRESHOLD = 0.55
MARGIN = 0.15


def query_key(spark: SparkSession, query: str) -> str:
    return spark.range(1).select(search_key(F.lit(fold_text(query))).alias("k")).first().k


def scored(records: DataFrame, query: str, field: str = "both", *, native: bool = False) -> DataFrame:
    """records (id, title, authors_str) with `raw`, the score of the chosen field; `query` is normalised already.

    A map: each task scores a string it has met once, and nothing is shuffled to find equal ones.
    """
    df = records.select("id", "title", "authors_str", search_key(F.col("title"), native=native).alias("__t"), search_key(F.col("authors_str"), native=native).alias("__a"))
    forms = {"title": [F.col("__t")], "authors": [F.col("__a")]}.get(field, [F.col("__t"), F.col("__a"), F.concat_ws(" ", "__t", "__a")])
    return df.withColumn("raw", score(F.lit(query), *forms)).drop("__t", "__a")


def search(records: DataFrame, query: str, field: str = "both", limit: int = 10, threshold: float = THRESHOLD, margin: float = MARGIN, *, native: bool = False) -> DataFrame:
    """score, id, title, authors: the floor is on the raw score, order and margin are on the rounded one; a blank query finds nothing.

    The best score comes from an aggregate over the rows above the floor, so nothing meets in one task but the top `limit`.
    """
    key = query_key(records.sparkSession, query)
    found = (scored(records, key, field, native=native) if key else records.withColumn("raw", F.lit(None).cast("double"))).where(F.col("raw") >= threshold)
    rows = found.select(round3(F.col("raw")).alias("score"), "id", "title", F.col("authors_str").alias("authors"))
    best = rows.agg(F.max("score").alias("best"))  # one row
    kept = rows.join(F.broadcast(best), F.col("score") >= F.col("best") - margin).drop("best")
    return kept.orderBy(F.desc("score"), "id").limit(limit)
