"""Packing documents into fixed-length sequences as a cutting-stock problem, solved by column generation.

Each document's ids (with its end id) are cut into full sequences, at most one piece whose length is a multiple of GRAIN,
and at most one tail shorter than GRAIN. So there are never more than capacity / GRAIN + GRAIN lengths, whatever the
corpus, and the driver plans on a histogram of that size: a restricted linear program over patterns (how many pieces of
each length fill one sequence) whose prices go to a knapsack dynamic program, which finds the pattern worth adding or
shows that there is none. Pattern counts are rounded down and the few pieces left over are filled greedily. The pieces
are then ranked within their length, and a piece's rank says which copy of which pattern it goes to.
"""

from __future__ import annotations

import hashlib
import logging
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _scratch
from . import tokenizing as T
from ._workers import map_batches

GRAIN = 128
#: Ranks within a length are counted in so many parts at least, and in one for each PART_ROWS pieces, so that a common length isn't one task's.
PARTS = 512
PART_ROWS = 1 << 22
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut(n: int, capacity: int, grain: int = GRAIN) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    full = n - n % capacity
    out = [(at, capacity) for at in range(0, full, capacity)]
    body = (n - full) // grain * grain
    if body:
        out.append((full, body))
    if n - full - body:
        out.append((full + body, n - full - body))
    return out


def _dearest(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern of largest total price, and that price."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(int(sizes[0]), capacity + 1):
        n = int(np.searchsorted(sizes, room, "right"))
        worth = best[room - sizes[:n]] + prices[:n]
        j = int(worth.argmax())
        if worth[j] > best[room - 1]:
            best[room], took[room] = worth[j], j
        else:
            best[room] = best[room - 1]
    pattern, room = np.zeros(len(sizes)), capacity
    while room >= sizes[0]:
        if took[room] < 0:
            room -= 1
            continue
        pattern[took[room]] += 1
        room -= int(sizes[took[room]])
    return float(best[capacity]), pattern


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, *, tolerance: float = 2e-4, rounds: int = 200) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often to use each, together covering the demand exactly.

    sizes rise. The program ends at its optimum, within tolerance of a lower bound (the material bound, or the one that
    the prices give), or after `rounds` columns; any of these leaves a valid plan.
    """
    sizes, demand = np.asarray(sizes, np.int64), np.asarray(demand, np.int64)
    if not len(sizes):
        return []
    columns = np.diag(np.maximum(1, np.minimum(capacity // sizes, demand)).astype(float))
    inverse = np.diag(1 / np.diag(columns))
    material = float((sizes * demand).sum()) / capacity
    for _ in range(rounds):
        used = inverse @ demand
        prices = inverse.sum(axis=0)
        total = float(used.sum())
        value, pattern = _dearest(sizes, prices, capacity)
        if value <= 1 + 1e-9 or total - max(material, total / value) <= max(0.5, tolerance * total):
            break
        step = inverse @ pattern
        rising = step > 1e-12
        if not rising.any():
            break
        ratio = np.full(len(step), np.inf)
        ratio[rising] = np.maximum(used[rising], 0) / step[rising]
        out = int(ratio.argmin())
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        columns[:, out] = pattern
    else:
        logging.getLogger(__name__).warning("column generation ended after %d rounds, before its bound was reached; the plan is valid", rounds)
    plan: list[tuple[np.ndarray, int]] = []
    left = demand.copy()
    used = inverse @ demand
    for k in np.argsort(-used, kind="stable"):
        pattern = np.rint(columns[:, k]).astype(np.int64)
        on = pattern > 0
        times = int(min(np.floor(used[k] + 1e-9), (left[on] // pattern[on]).min())) if on.any() else 0
        loose = capacity - int((pattern * sizes).sum()) > tolerance * capacity  # a program ended early keeps such columns
        if times > 0 and not loose:
            plan.append((pattern, times))
            left -= pattern * times
    while left.any():
        pattern, room = np.zeros(len(sizes), np.int64), capacity
        for j in range(len(sizes) - 1, -1, -1):
            n = min(int(left[j]), room // int(sizes[j]))
            pattern[j], room = n, room - n * int(sizes[j])
        on = pattern > 0
        times = int((left[on] // pattern[on]).min())
        plan.append((pattern, times))
        left -= pattern * times
    return plan


def _layout(sizes: list[int], plan: list[tuple[np.ndarray, int]]) -> list[tuple]:
    """(length, first rank, end rank, first sequence, pieces a sequence, offset): where the pieces of a length go, by rank."""
    given = [0] * len(sizes)
    rows, sequence = [], 0
    for pattern, times in plan:
        offset = 0
        for j in np.flatnonzero(pattern)[::-1]:
            n = int(pattern[j])
            rows.append((int(sizes[j]), given[j], given[j] + n * times, sequence, n, offset))
            given[j] += n * times
            offset += n * int(sizes[j])
        sequence += times
    return rows


def cut_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int | None = 2) -> DataFrame:
    """Every whole text's ids (null: empty) and end_id, cut into pieces: doc_id, start, length, ids_crc32, doc_tokens. No shuffle."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spec = T.read_tokenizer(tokenizer)
    key = hashlib.sha256(spec.encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def pieces(batches):
        enc = T.encoder(shared.value, key)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, some in T.in_parts(texts):
                rows = []
                for doc_id, ids in zip(doc_ids[at : at + len(some)], enc.encode(some), strict=True):
                    ids += end
                    n = len(ids) // 4
                    rows += [(doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n) for start, length in cut(n, capacity)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return map_batches(narrow, pieces, PIECES)


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int | None = 2) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Sequences hold at most `capacity` ids and are gapless from offset 0; each id is in exactly one piece. A null text
    is an empty document (its end id alone); null ids and repeated rows are packed like any other; an empty table
    gives no rows; other columns are not read. The pieces are written once to the shared folder. What the driver
    holds is the histogram (a row a length) and the layout, both bounded by GRAIN and capacity alone.
    """
    spark = docs.sparkSession
    made = _scratch.materialise(cut_documents(docs, tokenizer, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id), "pieces")
    parts = max(PARTS, math.ceil(made.count() / PART_ROWS))
    part = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)).cast("int")
    counts = made.groupBy("length", part.alias("part")).agg(F.count("*").alias("n"))
    first = _scratch.materialise(counts, "piece-counts")
    histogram = first.groupBy("length").agg(F.sum("n").alias("n")).orderBy("length").collect()
    sizes, demand = [r.length for r in histogram], [r.n for r in histogram]
    rows = _layout(sizes, solve(np.array(sizes), np.array(demand), capacity))
    layout = spark.createDataFrame(rows, "at_length long, lo long, hi long, first_sequence long, each long, first_offset long")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = first.select(F.col("length").alias("of_length"), F.col("part").alias("of_part"), F.coalesce(before, F.lit(0)).alias("before"))
    in_part = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = made.withColumn("part", part).withColumn("in_part", in_part)
    # Both sides of these joins are bounded by the number of lengths, times the parts for the first.
    ranked = ranked.join(F.broadcast(first), (F.col("length") == F.col("of_length")) & (F.col("part") == F.col("of_part"))).withColumn("rank", F.col("before") + F.col("in_part"))
    placed = ranked.join(F.broadcast(layout), (F.col("length") == F.col("at_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    k = F.col("rank") - F.col("lo")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first_sequence") + F.floor(k / F.col("each"))).cast("long").alias("sequence_id"), (F.col("first_offset") + (k % F.col("each")) * F.col("length")).cast("long").alias("offset"))
