"""Cross-entropy difference: how much better a target model predicts a document than a background model does.

Both are bigram models over all words of the corpus, known by 64-bit hashes, and a boundary. The background model counts
every document, the target model every labelled document that meets the condition. They are matched: same vocabulary, same
smoothing, and background counts scaled to the target's number of tokens, so that neither is smoothed less for being larger.

All counts are exact and grow with the corpus, so no task may hold them all, and a table of one row a step would be many
times the text. Three readings of the text keep both small:

1. Words are counted, summed in the task before the shuffle. Words and pairs that may have a share of 2 / SHARE of all steps
   or more are found on the way: a pair with such a share has half of it in some part of the text, so at most SHARE of each
   are candidates, whatever the corpus.
2. The candidates' pairs are counted exactly. They and the frequent words are broadcast (at most 2 * SHARE rows). So the
   steps of a pair that a third of all documents hold are priced where they are read and never meet in one task.
3. All other steps are dealt by their second word (by the pair where that word is frequent) into buckets, as one block of
   sorted arrays for each part of the text and bucket. Whoever has a bucket has all steps of its pairs and words: it counts
   them, prices them, and sends back one sum a document.

Prices are whole numbers of 2^-22 bits, so sums do not depend on their order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _scratch
from . import tokenizing as T
from .decontaminate import _mix, word_hashes
from ._workers import map_batches

#: The boundary before and after a text; a word with this hash would be counted as the next one.
EDGE = -(1 << 63)
#: A task hands its sums on when it holds so many words.
HELD = 1 << 20
#: At most so many words, and so many pairs, are frequent.
SHARE = 1 << 17
#: Bytes of text that are hashed at a time, and whose steps are one block in a bucket.
PART = 4 << 20
#: Bytes of text whose steps go to one task.
TASK = 64 << 20
#: At most so many labelled target documents are sent to every task (8 bytes each); more are joined by a shuffle.
TARGETS = 1 << 20
#: A price's unit: this part of a bit.
UNIT = 1 << 22
_TURN = np.uint64(0x9E3779B97F4A7C15)


def _words(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lowered), and the text each is in."""
    raws = [(t or "").encode().lower() for t in texts]
    starts, hashes = word_hashes(b"\x00".join(raws))
    edges = np.cumsum([0] + [len(x) + 1 for x in raws])
    return hashes, np.searchsorted(edges, starts, "right") - 1


def _transitions(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(before, after, text) of every step: boundary, each word, boundary; texts without words have none."""
    hashes, of = _words(texts)
    if not len(hashes):
        return (np.empty(0, np.int64),) * 3
    ids = hashes.view(np.int64)
    ids = np.where(ids == EDGE, EDGE + 1, ids)
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    after = np.append(np.insert(ids, starts[1:], EDGE), EDGE)  # the end of the text before
    text = np.append(np.insert(of, starts[1:], of[starts[1:] - 1]), of[-1])
    return np.concatenate([[EDGE], after[:-1]]), after, text


def _summed(keys: list[np.ndarray], sums: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The distinct rows of keys, in order, and the sums over their rows."""
    if not len(keys[0]):
        return keys, sums
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    first = np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0)))
    return [k[first] for k in keys], [np.add.reduceat(x[order], first) for x in sums]


def _batch(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], names=list(columns))


def _marked(docs: DataFrame, target: DataFrame | None, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, y): y is 1 for the documents whose id is in target (distinct ids in column id)."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if target is None:
        return narrow.withColumn("y", F.lit(0).cast("long"))
    few = target.limit(TARGETS + 1).count() <= TARGETS
    chosen = target.select(F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("y"))
    return narrow.join(F.broadcast(chosen) if few else chosen, "doc_id", "left").select("doc_id", "text", F.coalesce("y", F.lit(0)).cast("long").alias("y"))


def _parts(batch: pa.RecordBatch):
    """(y by text, first, texts) of a batch's parts."""
    wanted = batch.column(2).to_numpy()
    for at, part in T.in_parts(batch.column(1).to_pylist(), PART):
        yield wanted[at : at + len(part)], at, part


PAIRS = "before long, after long, background long, target long"


def pair_counts(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(before, after, background, target): exact counts over all documents, and over those whose id is in target (column id)."""

    def counted(batches):
        for batch in batches:
            for y, _, part in _parts(batch):
                before, after, text = _transitions(part)
                keys, sums = _summed([before, after], [np.ones(len(text), np.int64), y[text]])
                yield _batch(dict(zip(("before", "after", "background", "target"), [*keys, *sums], strict=True)))

    rows = map_batches(_marked(docs, target, id_col, text_col), counted, PAIRS)
    return rows.groupBy("before", "after").agg(F.sum("background").alias("background"), F.sum("target").alias("target"))


def _word_counts(marked: DataFrame) -> DataFrame:
    """Counts of words (before is null), and of the pairs that have at least 1 / SHARE of the steps of a part, in those parts."""

    def counted(batches):
        have = [np.empty(0, np.int64)] * 3

        def out(before, after, background, target):
            return pa.RecordBatch.from_arrays([before, *(pa.array(x, pa.int64()) for x in (after, background, target))], names=["before", "after", "background", "target"])

        for batch in batches:
            for y, _, part in _parts(batch):
                before, after, text = _transitions(part)
                (words,), sums = _summed([after], [np.ones(len(text), np.int64), y[text]])
                have = [np.concatenate(x) for x in zip(have, [words, *sums], strict=True)]
                keys, sums = _summed([before, after], [np.ones(len(text), np.int64), y[text]])
                many = sums[0] * SHARE >= len(text)
                yield out(pa.array(keys[0][many], pa.int64()), keys[1][many], sums[0][many], sums[1][many])
                if len(have[0]) > HELD:
                    (words,), sums = _summed(have[:1], have[1:])
                    yield out(pa.nulls(len(words), pa.int64()), words, *sums)
                    have = [np.empty(0, np.int64)] * 3
        (words,), sums = _summed(have[:1], have[1:])
        yield out(pa.nulls(len(words), pa.int64()), words, *sums)

    rows = map_batches(marked, counted, PAIRS)
    return rows.groupBy("before", "after").agg(F.sum("background").alias("background"), F.sum("target").alias("target"))


def _turn(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return _mix(after.view(np.uint64) * _TURN + before.view(np.uint64))


def _place(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each key is in sorted_keys, -1 for others."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


@dataclass
class Frequent:
    """What every task has: the models' totals, and the frequent words' and pairs' counts (background, target)."""

    background: int
    target: int
    words: int
    mass: float
    word: np.ndarray  # sorted
    of_word: np.ndarray  # 2 x words
    turn: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))  # sorted
    before: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    after: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    of_pair: np.ndarray = field(default_factory=lambda: np.empty((2, 0), np.int64))

    def pair(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Places of frequent pairs, -1 for others."""
        at = _place(self.turn, _turn(before, after))
        return np.where((at >= 0) & (self.before[at] == before) & (self.after[at] == after), at, -1) if len(self.turn) else at

    def prices(self, pairs: np.ndarray, singles: np.ndarray) -> np.ndarray:
        """Prices of pairs by both models (background, target), from their counts and those of their second words.

        A pair costs log2(before + mass) - log2(pair + mass * alone). Over a text, what comes before is what comes after,
        so the first term is taken of `after` and the sum is the same; no pair has to meet the count of its first word.
        """
        total = max(1.0, float(self.target))
        out = []
        for pair, single, n in zip(pairs, singles, (self.background, self.target), strict=True):
            scale = total / max(1.0, float(n))
            after = single * scale
            out.append(np.log2(after + self.mass) - np.log2(pair * scale + self.mass * (after + 1.0) / (total + self.words + 2)))
        return np.rint(np.array(out) * UNIT).astype(np.int64)


@dataclass
class Models:
    """Both models' corpus and totals. singles: (word, background, target); pairs: counted when asked for."""

    docs: DataFrame
    chosen: DataFrame
    names: tuple[str, str]
    singles: DataFrame
    frequent: Frequent

    background = property(lambda self: self.frequent.background)
    target = property(lambda self: self.frequent.target)
    words = property(lambda self: self.frequent.words)

    @property
    def pairs(self) -> DataFrame:
        return pair_counts(self.docs, self.chosen, id_col=self.names[0], text_col=self.names[1])


def _exact(marked: DataFrame, shared) -> list[tuple]:
    """(place, background, target) of the frequent pairs' candidates."""

    def counted(batches):
        f = shared.value
        sums = np.zeros((2, len(f.turn)), np.int64)
        for batch in batches:
            for y, _, part in _parts(batch):
                before, after, text = _transitions(part)
                at = f.pair(before, after)
                mine = at >= 0
                sums[0] += np.bincount(at[mine], minlength=len(f.turn))
                sums[1] += np.bincount(at[mine], y[text][mine], len(f.turn)).astype(np.int64)
        there = np.flatnonzero(sums[0])
        yield _batch({"place": there, "background": sums[0][there], "target": sums[1][there]})

    rows = map_batches(marked, counted, "place long, background long, target long")
    return rows.groupBy("place").agg(F.sum("background"), F.sum("target")).collect()


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target: str = "quality = 1 and toxic = 0", vocabulary_size: int | None = None, mass: float = 50.0) -> Models:
    """Counts over all documents; target documents are all those whose labels meet `target`.

    vocabulary_size: what the caller holds the vocabulary to be at most. More words are an error; none is left out for it.
    """
    chosen = labels.where(target).select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    marked = _marked(docs, chosen, id_col, text_col)
    counts = _scratch.materialise(_word_counts(marked), "words")
    singles = counts.where("before is null").select(F.col("after").alias("word"), "background", "target")
    background, of_target, words = singles.agg(F.coalesce(F.sum("background"), F.lit(0)), F.coalesce(F.sum("target"), F.lit(0)), F.count(F.when(F.col("word") != EDGE, 1))).first()
    if vocabulary_size is not None and words > vocabulary_size:
        raise ValueError(f"{words} words, more than {vocabulary_size}")
    # At most SHARE words can have 1 / SHARE of all steps each, and at most SHARE pairs.
    many = F.col("background") * SHARE >= background
    word = sorted(tuple(r) for r in singles.where(many).collect())
    frequent = Frequent(background, of_target, words, mass, np.array([r[0] for r in word], np.int64), np.array([r[1:] for r in word], np.int64).reshape(-1, 2).T)
    pair = [tuple(r) for r in counts.where("before is not null").where(many).select("before", "after").collect()]
    if pair:
        before, after = (np.array(x, np.int64) for x in zip(*pair, strict=True))
        turn = _turn(before, after)
        # Of two candidates with one turn the buckets take care of the second, as of any other pair.
        frequent.turn, order = np.unique(turn, return_index=True)
        frequent.before, frequent.after = before[order], after[order]
        frequent.of_pair = np.zeros((2, len(order)), np.int64)
        shared = docs.sparkSession.sparkContext.broadcast(frequent)
        for place, *n in _exact(marked, shared):
            frequent.of_pair[:, place] = n
        shared.unpersist()
    return Models(docs, chosen, (id_col, text_col), singles, frequent)


BLOCK = "bucket int, base long, counted boolean, words binary, per_word binary, firsts binary, per_pair binary, docs binary, times binary, ids binary, steps binary, background binary, target binary"
_NAMES = [x.split()[0] for x in BLOCK.split(", ")]
_EMPTY = dict.fromkeys(_NAMES[3:], b"")


def _small(x: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes each as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max()))).tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int64) if n else np.empty(0, np.int64)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where sorted keys change."""
    return np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0)))


def _blocks(marked: DataFrame, shared, buckets: int, counted: bool, scored: bool) -> DataFrame:
    """BLOCK rows of all steps that are not of a frequent pair, and one a part with what the frequent ones of each text cost."""

    def made(batches):
        f = shared.value
        price = f.prices(f.of_pair, f.of_word[:, _place(f.word, f.after)]) if len(f.turn) else None
        row, part_of = TaskContext.get().partitionId() << 40, TaskContext.get().partitionId()
        for batch in batches:
            for y, at, part in _parts(batch):
                before, after, text = _transitions(part)
                rows = []
                sums = np.zeros((2, len(part)), np.int64)
                if scored:
                    base, row = row, row + len(part)
                    steps = np.bincount(text, minlength=len(part))
                else:
                    base = None
                if price is not None:
                    place = f.pair(before, after)
                    mine = place >= 0
                    sums = np.array([np.bincount(text[mine], p[place[mine]], len(part)) for p in price]).astype(np.int64)
                    before, after, text = before[~mine], after[~mine], text[~mine]
                if scored:
                    part_of += 1
                    ids = batch.column(0).slice(at, len(part))
                    null = np.packbits(ids.is_null().to_numpy(zero_copy_only=False)).tobytes()
                    rows.append(_EMPTY | {"bucket": part_of % buckets, "base": base, "counted": False, "ids": ids.fill_null(0).to_numpy().tobytes() + null, "steps": steps.tobytes(), "background": sums[0].tobytes(), "target": sums[1].tobytes()})
                if len(text):
                    key = np.where(_place(f.word, after) >= 0, _turn(before, after), after.view(np.uint64))
                    bucket = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                    # Texts rise, and the sort is stable.
                    order = np.lexsort((before, after, bucket))
                    before, after, text, bucket = before[order], after[order], text[order], bucket[order]
                    step = _runs(bucket, after, before, text)
                    times = np.diff(step, append=len(text))
                    before, after, text, bucket = before[step], after[step], text[step], bucket[step]
                    pair = _runs(bucket, after, before)
                    word = _runs(bucket[pair], after[pair])
                    here = _runs(bucket)
                    docs = text * 2 + y[text]
                    for a, b in zip(here, [*here[1:], len(text)], strict=True):
                        p = pair[np.searchsorted(pair, a) : np.searchsorted(pair, b)]
                        w = pair[word[np.searchsorted(pair[word], a) : np.searchsorted(pair[word], b)]]
                        rows.append(
                            _EMPTY
                            | {
                                "bucket": int(bucket[a]), "base": base, "counted": counted, "words": after[w].tobytes(), "per_word": _small(np.diff(np.searchsorted(p, w), append=len(p))),
                                "firsts": before[p].tobytes(), "per_pair": _small(np.diff(p, append=b)), "docs": _small(docs[a:b]), "times": _small(times[a:b]),
                            }
                        )
                kinds = [pa.int32(), pa.int64(), pa.bool_()] + [pa.binary()] * 10
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kind) for n, kind in zip(_NAMES, kinds, strict=True)], names=_NAMES)

    return map_batches(marked, made, BLOCK)


SUMS = "row long, doc_id long, n long, background long, target long"


def _priced(f: Frequent, group: list[dict]) -> pa.RecordBatch | None:
    """SUMS of the texts that a bucket's blocks have steps of."""
    pairs, steps, pairs_before = [], [], 0
    for r in group:
        words, firsts = np.frombuffer(r["words"], "<i8"), np.frombuffer(r["firsts"], "<i8")
        per_pair = _wide(r["per_pair"], len(firsts))
        n = int(per_pair.sum())
        docs, times = _wide(r["docs"], n), _wide(r["times"], n)
        row = np.full(n, -1) if r["base"] is None else r["base"] + docs // 2
        pairs.append((np.repeat(words, _wide(r["per_word"], len(words))), firsts))
        steps.append((np.repeat(np.arange(len(firsts)) + pairs_before, per_pair), row, times, times * r["counted"], times * (docs % 2) * r["counted"]))
        pairs_before += len(firsts)
    if not pairs_before:
        return None
    after, before = (np.concatenate(x) for x in zip(*pairs, strict=True))
    of, row, times, background, target = (np.concatenate(x) for x in zip(*steps, strict=True))
    order = np.lexsort((before, after))
    first = _runs(after[order], before[order])
    name = np.empty(len(order), np.int64)
    name[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(order)))
    after = after[order][first]
    count = np.array([np.bincount(name[of], x, len(first)) for x in (background, target)])
    word = _runs(after)
    single = np.repeat(np.add.reduceat(count, word, axis=1), np.diff(word, append=len(after)), axis=1)
    # Of a frequent word only some pairs are in this bucket.
    known = _place(f.word, after)
    single[:, known >= 0] = f.of_word[:, known[known >= 0]]
    price = f.prices(count, single)[:, name[of]] * times
    rows, back = np.unique(row, return_inverse=True)
    sums = [np.zeros(len(rows), np.int64) for _ in price]
    for total, x in zip(sums, price, strict=True):
        np.add.at(total, back, x)
    told = rows >= 0
    n = int(told.sum())
    return pa.RecordBatch.from_arrays([pa.array(rows[told]), pa.nulls(n, pa.int64()), pa.array(np.zeros(n, np.int64)), *(pa.array(x[told]) for x in sums)], names=[x.split()[0] for x in SUMS.split(", ")])


def score(docs: DataFrame, models: Models, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, target_loss, background_loss (bits a token), score (background less target).

    A higher score: more like the target. Null, empty and wordless texts have 0 in every column; null ids stay null and
    are no target documents; repeated rows give repeated rows; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(models.frequent)
    own = docs.sameSemantics(models.docs) and (id_col, text_col) == models.names
    size = sum(d.agg(F.coalesce(F.sum(F.octet_length(F.col(t).cast("string"))), F.lit(0))).first()[0] for d, t in ([(docs, text_col)] if own else [(docs, text_col), (models.docs, models.names[1])]))
    tasks = max(3 * spark.sparkContext.defaultParallelism, math.ceil(size / TASK))
    buckets = max(512, 4 * tasks)
    blocks = _blocks(_marked(models.docs, models.chosen, *models.names), shared, buckets, True, own)
    if not own:
        blocks = blocks.unionByName(_blocks(_marked(docs, None, id_col, text_col), shared, buckets, False, True))

    def priced(batches):
        f = shared.value
        group: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if r["ids"]:
                    steps = np.frombuffer(r["steps"], "<i8")
                    null = np.unpackbits(np.frombuffer(r["ids"], "u1", offset=8 * len(steps)))[: len(steps)].astype(bool)
                    ids = pa.array(np.frombuffer(r["ids"], "<i8", len(steps)), mask=null)
                    yield pa.RecordBatch.from_arrays([pa.array(r["base"] + np.arange(len(steps))), ids, pa.array(steps), *(pa.array(np.frombuffer(r[x], "<i8")) for x in ("background", "target"))], names=[x.split()[0] for x in SUMS.split(", ")])
                    continue
                if group and group[0]["bucket"] != r["bucket"]:
                    if (out := _priced(f, group)) is not None:
                        yield out
                    group = []
                group.append(r)
        if group and (out := _priced(f, group)) is not None:
            yield out

    rows = map_batches(blocks.repartition(tasks, "bucket").sortWithinPartitions("bucket"), priced, SUMS)
    each = rows.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *(F.sum(x).alias(x) for x in ("n", "background", "target")))
    loss = {x: F.col(x) / UNIT / F.greatest("n", F.lit(1)) for x in ("target", "background")}
    out = each.select("doc_id", F.greatest(F.col("n") - 1, F.lit(0)).alias("n_words"), loss["target"].alias("target_loss"), loss["background"].alias("background_loss"))
    return out.withColumn("score", F.col("background_loss") - F.col("target_loss"))
