"""The operators over their whole tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .oracles import ORACLES


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_read(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), capacity=4096, end_id=2)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import digest, mark

    return digest(mark(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), window=13, k=8), share=20)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(_read(spark, sf_dir, "documents"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import fit, score

    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    return score(docs, fit(docs, labels))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_groups

    return near_groups(_read(spark, sf_dir, "documents"), words=3, radius=2)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract, fit

    pages = _read(spark, sf_dir, "pages")
    return extract(pages, fit(pages))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, score

    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    return score(docs, fit(docs, labels), threshold=0.3)


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import repeats

    return repeats(_read(spark, sf_dir, "documents"), length=400, words=51).drop("spans")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import store_tokens

    return store_tokens(_read(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=2)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_count import count_tokens

    return count_tokens(_read(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), limit=1024)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_decontamination, op3_exact_dedup, op4_lm_score, op5_simhash, op6_html_extraction, op7_quality, op8_repeats, op9_token_store, op10_token_counts)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
