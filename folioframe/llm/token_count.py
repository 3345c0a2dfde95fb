"""Token counts by a map-side two-tier lookup: no pre-token is shuffled.

Tier one is a compact table of the most frequent pre-token chunks' lengths, counted in whole texts of a bounded sample by
hash, which covers every source in proportion, and broadcast (at most `frequent` entries). Tier two is each worker's own cache, which the library fills on a miss.
The sample decides only what is quick, never a count: every whole text is counted, and equals the library's result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokenizing as T
from ._workers import map_batches

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def count_tokens(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, frequent: int = 32_768, sample_rows: int = 1_000) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    tokenizer: path of a tokenizers file, needed on the driver only. A null text counts as empty (0 bytes, 0 tokens);
    a null id stays null; repeated rows give repeated rows; an empty table gives no rows; other columns are not read.
    sample_rows bounds what warms the broadcast table: whole texts, those of the smallest hash.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spec = T.read_tokenizer(tokenizer)
    key = hashlib.sha256(spec.encode()).hexdigest()
    sample = narrow.select(F.xxhash64("doc_id", "text").alias("h"), "doc_id").orderBy("h").limit(sample_rows)
    edge = sample.agg(F.max("h")).first()[0]
    texts = () if edge is None else (r.text for r in narrow.where(F.xxhash64("doc_id", "text") <= edge).select("text").limit(sample_rows).toLocalIterator())
    keys, lengths = T.encoder(spec, key).frequent(texts, frequent)
    table = spark.sparkContext.broadcast((spec, keys, lengths))

    def counted(batches):
        spec, keys, lengths = table.value
        enc = T.encoder(spec, key)
        enc.know(keys, lengths)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for at, part in T.in_parts(texts):
                n = enc.count(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, len(part)),
                        pa.array([len((x or "").encode()) for x in part], pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array([x > limit for x in n], pa.bool_()),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return map_batches(narrow, counted, SCHEMA)
