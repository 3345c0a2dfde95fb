"""Benchmark decontamination by winnowing.

Of every `winnow` consecutive k-gram hashes the rightmost smallest one is kept. With k + winnow - 1 = window, any run of
`window` words that a document shares with a benchmark item holds one whole winnowing window, and both sides keep the
same k-gram of it; so the join of kept fingerprints misses no shared run. Each hit is then extended word by word against
the item (exact words, not hashes), and runs of at least `window` words count. An item of fewer words is one window of
its own length; those few lengths are winnowed with k as long as the item, which keeps every gram.

Benchmark texts go to the executors by broadcast, in blocks of about `block_bytes`; each worker indexes the block's
fingerprints itself. Documents are read once for each block and their texts are never shuffled; where there are several
blocks, the few rows with a hit meet their documents again by a join. Very long items are cut into pieces that overlap by
a window less a word, so that each window lies in one.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _scratch
from . import tokenizing as T
from ._workers import map_batches

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_SEGMENT = 1 << 19  # so that the arrays of one stay in a core's cache
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: bytes, inside: np.ndarray = _IN_WORD) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins, and a 64-bit hash of it; works through long texts piece by piece. inside: which bytes are in words."""
    a = np.frombuffer(raw, np.uint8)
    starts, hashes, at = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], 0
    while at < len(a):
        end = min(len(a), at + _SEGMENT)
        while end < len(a) and inside[a[end]]:
            out = np.flatnonzero(~inside[a[end : end + 65_536]])
            end = end + int(out[0]) if len(out) else min(len(a), end + 65_536)
        part = a[at:end]
        on = inside[part]
        edge = np.diff(on.astype(np.int8), prepend=0, append=0)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(first):
            size = last - first
            begin = np.cumsum(size) - size
            place = np.arange(int(size.sum())) - np.repeat(begin, size)
            power = np.cumprod(np.full(int(size.max()), _STEP))
            value = _mix(part[on].astype(np.uint64) + np.uint64(1)) * power[place]
            starts.append(first + at)
            hashes.append(_mix(np.add.reduceat(value, begin) + size.astype(np.uint64) * _STEP))
        at = end
    return np.concatenate(starts), np.concatenate(hashes)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _STEP + words[j : j + n]
    return _mix(out)


def winnow(grams: np.ndarray, of: np.ndarray, w: int) -> np.ndarray:
    """Positions of the kept grams; of: the text that each gram lies in (windows never cross texts, grams may not either)."""
    n = len(grams) - w + 1
    if n <= 0:
        return np.empty(0, np.int64)
    least, place = grams[:n].copy(), np.arange(n)
    for j in range(1, w):
        now = grams[j : j + n]
        lower = now <= least
        least[lower], place[lower] = now[lower], np.flatnonzero(lower) + j
    return np.unique(place[of[:n] == of[w - 1 :]])


class Index:
    """The fingerprints of one block of benchmark items."""

    def __init__(self, items: list[tuple], window: int, k: int):
        self.window, self.k = window, k
        self.ids = [x for x, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        self.words, kept = [], defaultdict(list)
        for i, (_, text) in enumerate(items):
            raw = (text or "").encode().lower()
            found = WORD.findall(raw)
            self.words.append(np.array([self.vocabulary.setdefault(x, len(self.vocabulary)) for x in found], np.int64))
            if not found:
                continue
            size = min(len(found), window)
            grams = gram_hashes(word_hashes(raw)[1], k if size == window else size)
            for q in winnow(grams, np.zeros(len(grams)), window - k + 1) if size == window else range(len(grams)):
                kept[size].append((int(grams[q]), i, int(q)))
        self.by_size = {}
        for size, rows in kept.items():
            rows.sort()
            values = np.array([r[0] for r in rows], np.uint64)
            self.by_size[size] = (*np.unique(values, return_index=True, return_counts=True), np.array([r[1:] for r in rows], np.int64))
        # All items' words one after the other, with a window of no words around each, so that extension needs no edge cases.
        gap = np.full(window, -2, np.int64)
        self.flat = np.concatenate([gap, *(y for x in self.words for y in (x, gap))])
        self.begin = np.cumsum([window] + [len(x) + window for x in self.words])[:-1]

    def match(self, words: np.ndarray, doc_of: np.ndarray, raw_of) -> dict[int, tuple[set, np.ndarray]]:
        """By document with a hit: the items' places, and the (start, end) word runs that are hit."""
        found: dict[int, list] = defaultdict(list)
        for size, (values, first, count, refs) in self.by_size.items():
            k = self.k if size == self.window else size
            grams = gram_hashes(words, k)
            if not len(grams):
                continue
            inside = doc_of[: len(grams)] == doc_of[k - 1 :]
            if size == self.window:
                # A gram over two texts takes a text of its own, so that no window has it.
                of = np.where(inside, doc_of[: len(grams)], -1 - np.arange(len(grams)))
                places = winnow(grams, of, self.window - self.k + 1)
            else:
                places = np.flatnonzero(inside)
            at = np.minimum(np.searchsorted(values, grams[places]), len(values) - 1)
            hit = values[at] == grams[places]
            places, at = places[hit], at[hit]
            for d in np.unique(doc_of[places]):
                mine = doc_of[places] == d
                found[int(d)].append((size, places[mine], first[at[mine]], count[at[mine]], refs))
        out = {}
        for d, parts in found.items():
            begin = int(np.searchsorted(doc_of, d))
            known = np.array([self.vocabulary.get(x, -1) for x in WORD.findall(raw_of(d))], np.int64)
            items, runs = self._extend(known, begin, parts)
            if items:
                out[d] = (items, runs)
        return out

    def _extend(self, known: np.ndarray, begin: int, parts: list) -> tuple[set, np.ndarray]:
        w = self.window
        padded = np.concatenate([np.full(w, -3), known, np.full(w, -3)])
        span = np.arange(-w + 1, w)
        items: set = set()
        runs = [np.empty((0, 2), np.int64)]
        for size, places, first, count, refs in parts:
            for at in range(0, len(places), 4096):
                c = count[at : at + 4096]
                p = np.repeat(places[at : at + 4096] - begin, c)
                j = np.repeat(first[at : at + 4096], c) + np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
                for lo in range(0, len(p), 65_536):
                    pp, (item, q) = p[lo : lo + 65_536], refs[j[lo : lo + 65_536]].T
                    same = padded[pp[:, None] + span + w] == self.flat[(self.begin[item] + q)[:, None] + span]
                    back = np.minimum.accumulate(same[:, w - 2 :: -1], axis=1).sum(axis=1) if w > 1 else 0
                    ahead = np.minimum.accumulate(same[:, w - 1 :], axis=1).sum(axis=1)
                    good = (back + ahead >= size) & (ahead > 0)
                    items.update(item[good].tolist())
                    runs.append(np.stack([(pp - back)[good], (pp + ahead)[good]], axis=1))
        return items, merge(np.concatenate(runs))


def merge(runs: np.ndarray) -> np.ndarray:
    """Sorted, disjoint runs that cover what the given ones cover."""
    if not len(runs):
        return runs
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    end = np.maximum.accumulate(runs[:, 1])
    new = np.concatenate([[True], runs[1:, 0] > end[:-1]])
    return np.stack([runs[new, 0], end[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(runs) - 1]])]], axis=1)


#: Words of an item in one piece.
PIECE = 200_000


def _pieces(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(item_id, text), long items cut."""

    def cut(batches):
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts = [text]
                if len(text) > PIECE and len(words := WORD.findall(text.encode().lower())) > PIECE:
                    texts = [b" ".join(words[i : i + PIECE + window - 1]).decode() for i in range(0, len(words), PIECE)]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(texts), pa.int64()), pa.array(texts, pa.string())], names=["item_id", "text"])

    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return map_batches(items, cut, "item_id long, text string")


class _Block:
    """A broadcast block of items; each worker makes its index once."""

    _made: dict[str, Index] = {}

    def __init__(self, spark, items: list[tuple], window: int, k: int):
        self.name, self.items, self.window, self.k = uuid.uuid4().hex, spark.sparkContext.broadcast(items), window, k

    def index(self) -> Index:
        if self.name not in self._made:
            self._made.clear()  # one is held at a time
            self._made[self.name] = Index(self.items.value, self.window, self.k)
        return self._made[self.name]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, k: int, block_bytes: int) -> list[_Block]:
    """Blocks of about block_bytes of text; the driver holds one at a time."""
    spark = benchmark.sparkSession
    items = _pieces(benchmark, item_col, text_col, window).distinct()
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    n = max(1, math.ceil(size / block_bytes))
    if n > 1:
        items = _scratch.materialise(items, "items")
    out = []
    for i in range(n):
        rows = (items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else items).collect()
        out.append(_Block(spark, sorted(((r.item_id, r.text) for r in rows), key=lambda r: (r[0] is None, r)), window, k))
    return out


def _match_texts(texts: list, index: Index) -> list[tuple[int, list, list]]:
    """(words, item ids, hit runs) of each text."""
    raws = [(t or "").encode().lower() for t in texts]
    buffer = b"\x00".join(raws)
    starts, words = word_hashes(buffer)
    edges = np.cumsum([0] + [len(x) + 1 for x in raws])
    doc_of = np.searchsorted(edges, starts, "right") - 1
    n_words = np.bincount(doc_of, minlength=len(texts)) if len(texts) else []
    found = index.match(words, doc_of, raws.__getitem__)
    none = set(), np.empty((0, 2), np.int64)
    return [(int(n_words[d]), _ordered({index.ids[i] for i in found.get(d, none)[0]}), found.get(d, none)[1].tolist()) for d in range(len(texts))]


def _ordered(ids: set) -> list:
    return sorted(ids, key=lambda x: (x is None, x))


MARKS = "doc_id long, n_words long, n_hit long, items array<long>, runs array<array<long>>"


def mark(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, k: int = 8, block_bytes: int = 32 << 20) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, items (ids of items that have a window in the document), runs (hit words, [start, end)).

    Null and empty texts have no words and are never hit; items without words match nothing; equal item rows count
    once, and items that share an id count once in `items`; an empty benchmark hits nothing; a null document id stays null.
    """
    blocks = _blocks(benchmark, item_col, item_text_col, window, k, block_bytes)
    text = F.col(text_col).cast("string")
    keys = [F.xxhash64(F.lit(i), text).alias(n) for i, n in enumerate(_KEYS)] if len(blocks) > 1 else []
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *keys)

    def marked(block):
        def made(batches):
            index = block.index()
            for batch in batches:
                for at, part in T.in_parts(batch.column(1).to_pylist(), 4 << 20):
                    rows = _match_texts(part, index)
                    also = [batch.column(i).slice(at, len(part)) for i in range(2, batch.num_columns)]
                    yield _mark_batch(batch.column(0).slice(at, len(part)), rows, also)

        return map_batches(narrow, made, MARKS + "".join(f", {n} long" for n in _KEYS if keys))

    if not keys:
        return marked(blocks[0])
    # Rows of one id and text have the same marks, so one of them says what the others have.
    base, hits = marked(blocks[0]), None
    for block in blocks:
        own = _scratch.materialise(marked(block).where("size(runs) > 0").dropDuplicates(["doc_id", *_KEYS]), "hits")
        hits = own if hits is None else hits.unionByName(own)
    all_of = hits.groupBy(F.col("doc_id").alias("of_id"), *(F.col(n).alias(f"of_{n}") for n in _KEYS)).agg(F.flatten(F.collect_list("items")).alias("all_items"), F.flatten(F.collect_list("runs")).alias("all_runs"))
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("a") == F.col("of_a")) & (F.col("b") == F.col("of_b"))
    joined = base.select("doc_id", "n_words", *_KEYS).join(all_of, same, "left").select("doc_id", "n_words", "all_items", "all_runs")

    def merged(batches):
        for batch in batches:
            rows = [(n, _ordered(set(i or ())), merge(np.array(r or [], np.int64).reshape(-1, 2)).tolist()) for n, i, r in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)]
            yield _mark_batch(batch.column(0), rows, [])

    return map_batches(joined, merged, MARKS)


_KEYS = ("a", "b")


def _mark_batch(ids: pa.Array, rows: list[tuple[int, list, list]], also: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([sum(b - a for a, b in r[2]) for r in rows], pa.int64()),
            pa.array([r[1] for r in rows], pa.list_(pa.int64())),
            pa.array([r[2] for r in rows], pa.list_(pa.list_(pa.int64()))),
            *also,
        ],
        names=["doc_id", "n_words", "n_hit", "items", "runs", *_KEYS[: len(also)]],
    )


def is_contaminated(n_words: int, n_hit: int, share: int = 20) -> bool:
    """At least one word in `share` is hit."""
    return n_hit > 0 and share * n_hit >= n_words


def digest(marked: DataFrame, share: int = 20) -> DataFrame:
    """The marks with the items as a count and a digest, and whether the document is contaminated."""
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", window: int = 13, k: int = 8, share: int = 20, block_bytes: int = 32 << 20) -> DataFrame:
    """The rows of docs, all columns, whose text is not contaminated."""
    blocks = _blocks(benchmark, "item_id", "text", window, k, block_bytes)
    if len(blocks) > 1:  # by text: what is contaminated does not hang on the id
        text = F.col(text_col).cast("string")
        texts = docs.select(F.xxhash64(text).alias("__ff_id"), text.alias("__ff_text"))
        marks = mark(texts, benchmark, id_col="__ff_id", text_col="__ff_text", window=window, k=k, block_bytes=block_bytes)
        gone = digest(marks, share).where("contaminated").select(F.col("doc_id").alias("__ff_id")).distinct()
        return docs.join(gone, F.xxhash64(text) == F.col("__ff_id"), "left_anti")
    place, block = docs.columns.index(text_col), blocks[0]

    def clean(batches):
        index = block.index()
        for batch in batches:
            keep = []
            for _, part in T.in_parts(batch.column(place).to_pylist(), 4 << 20):
                keep += [not is_contaminated(n, sum(b - a for a, b in runs), share) for n, _, runs in _match_texts(part, index)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_batches(docs, clean, docs.schema)
