"""Quality by compression: zstandard dictionaries of good and of bad text, and their calibrated size difference.

Two dictionaries are trained, one on texts labelled good and one on texts labelled bad. A text that is like one of them
compresses better with it. A text is compressed in pieces of PIECE bytes, so that its own repetition does not hide the
dictionary's part, and the difference of the two sizes is normalised twice: by the text's bytes and by its size when
compressed alone. A logistic regression on these two numbers, fitted on labelled texts that no dictionary has seen, makes
them a score. Nothing but the text is an input of a score.

The fit uses at most `dictionary_rows` and `calibration_rows` labelled rows of each class (those of the smallest hash of
the id), and their whole texts: the calibration's numbers are computed where the texts are. Scoring is a map over whole texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from ._workers import map_batches


PIECE = 1000
LEVEL = 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, float, float]
    constant: float | None = None  # the score of every text, where a class has no labelled rows


class Scorer:
    def __init__(self, model: Model):
        import zstandard as z

        self.model, self.both = model, []
        if model.constant is None:
            for raw in (model.good, model.bad):
                d = z.ZstdCompressionDict(raw)
                d.precompute_compress(level=LEVEL)
                self.both.append(z.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
            self.alone = z.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)

    def features(self, text: str | None) -> tuple[float, float]:
        raw = (text or "").encode()
        if not raw:
            return 0.0, 0.0
        good, bad = (sum(len(c.compress(raw[i : i + PIECE])) for i in range(0, len(raw), PIECE)) for c in self.both)
        return (bad - good) / len(raw), (bad - good) / len(self.alone.compress(raw))

    def score(self, text: str | None) -> float:
        if self.model.constant is not None:
            return self.model.constant
        a, b, c = self.model.weights
        x, y = self.features(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method; ridge keeps separable classes finite."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    design = np.column_stack([np.ones(len(x)), x / scale])
    w = np.zeros(design.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (y - p) - ridge * w
        curve = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w / np.concatenate([[1.0], scale])


def _dictionary(texts: list[str], size: int) -> bytes:
    import zstandard as z

    samples = [raw[i : i + 500] for t in texts for raw in [t.encode()] for i in range(0, len(raw), 500)]
    size = min(size, max(1024, sum(map(len, samples)) // 4))
    try:
        return z.train_dictionary(size, samples).as_bytes()
    except z.ZstdError:  # too few samples to train on: their own bytes
        return b"\n".join(samples)[-size:] or b" "


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", dictionary_rows: int = 4000, calibration_rows: int = 3000, dictionary_bytes: int = 112_640) -> Model:
    """Learn from labelled rows that are not held out; null or other labels and null ids are left out."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").where(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    each = dictionary_rows + calibration_rows
    chosen = known.where("y = 1").orderBy(F.xxhash64("id"), "id").limit(each).unionAll(known.where("y = 0").orderBy(F.xxhash64("id"), "id").limit(each))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").select(F.xxhash64("id").alias("h"), "id", "y", F.sha2("text", 256).alias("sha"), "text")
    # Bounded by the parameters: at most 2 * each rows, without their texts.
    keys = sorted({tuple(r) for r in rows.select("h", "id", "y", "sha").collect()})
    classes = [[r for r in keys if r[2] == y] for y in (0, 1)]
    if min(map(len, classes)) < 4:
        return Model(b"", b"", (0, 0, 0), (len(classes[1]) + 1) / (len(keys) + 2))
    share = dictionary_rows / each
    cuts = [int(len(x) * share) for x in classes]
    first = {r: None for x, n in zip(classes, cuts, strict=True) for r in x[:n]}
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(r[1], r[3], r in first) for r in keys], "id long, sha string, dictionary boolean")
    rows = rows.join(F.broadcast(wanted), ["id", "sha"])
    # The dictionaries' texts: at most dictionary_rows of each class.
    for r in rows.where("dictionary").select("h", "id", "y", "sha", "text").toLocalIterator():
        first[(r.h, r.id, r.y, r.sha)] = r.text
    bad, good = (_dictionary([first[r] for r in x[:n]], dictionary_bytes) for x, n in zip(classes, cuts, strict=True))
    shared = _Shared(spark, Model(good, bad, (0, 0, 0)))

    def measured(batches):
        scorer = _scorer(shared)
        for batch in batches:
            found = [scorer.features(t) for t in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array([f[k] for f in found], pa.float64()) for k in (0, 1))], names=["h", "id", "y", "sha", "a", "b"])

    rest = map_batches(rows.where("not dictionary").select("h", "id", "y", "sha", "text"), measured, "h long, id long, y int, sha string, a double, b double")
    rest = sorted({tuple(r) for r in rest.collect()})
    w = _logistic(np.array([r[4:] for r in rest]), np.array([r[2] for r in rest], float))
    return Model(good, bad, tuple(float(v) for v in w))


_scorers: dict[int, Scorer] = {}


def _scorer(model) -> Scorer:
    """One for each broadcast and worker."""
    if model.id not in _scorers:
        _scorers.clear()
        _scorers[model.id] = Scorer(model.value)
    return _scorers[model.id]


class _Shared:
    def __init__(self, spark, model: Model):
        self.of = spark.sparkContext.broadcast(model)
        self.id = hash((model.good, model.bad, model.weights, model.constant))

    @property
    def value(self) -> Model:
        return self.of.value


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold, else 0).

    Null counts as empty, and an empty text has the score of no evidence; a null id is never held out; repeated rows
    give repeated rows; an empty table gives no rows; other columns are not read.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col).cast("long")).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    shared = _Shared(docs.sparkSession, model)

    def scored(batches):
        scorer = _scorer(shared)
        for batch in batches:
            values = [scorer.score(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.float64()), pa.array([int(x >= threshold) for x in values], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return map_batches(narrow, scored, "doc_id long, held_out boolean, score double, predicted int")


def drop_poor(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, that are predicted good."""
    shared = _Shared(docs.sparkSession, model)
    place = docs.columns.index(text_col)

    def kept(batches):
        scorer = _scorer(shared)
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t) >= threshold for t in batch.column(place).to_pylist()], pa.bool_()))

    return map_batches(docs, kept, docs.schema)
